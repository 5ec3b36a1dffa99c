"""Chat formatting: snapshots of growing conversations collapse to the longest one.

A log may hold a conversation several times, each time a few turns longer. Each
turn is hashed with its number; the exclusive-or of the hashes up to a turn is
the rolling hash of that prefix (two hashes of 64 bits). A conversation whose
whole hash is that of a proper prefix of another one is dropped by an anti
join; of equal conversations that of the least conv_id stays. The rest is
rendered, role by role.

Turns are numbered and hashed in chunks of ``CHUNK`` turn numbers, whose counts
and hashes are then carried forward, so that a conversation of any length is
spread over tasks. A rendering is one row, ``part`` 0, with the whole
conversation; where that is more than ``WHOLE`` characters, further rows go on
at chunks, and joined by part they are the conversation.

Defined results: repeated equal rows are one turn; turns of one number are
ordered by role and hash; a null role or text is empty; a null turn comes
first; rows without conv_id are left out; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almanac.llm.common import cut, table

CHUNK = 256
#: Characters of a rendering from which on a chunk begins a further row.
WHOLE = 64 << 20
#: Chunk of the turns without a number, before all others.
NO_TURN = -(1 << 62)


def _hash(seed: int, *columns: str) -> Column:
    return F.xxhash64(F.lit(seed), *(F.col(c) for c in columns))


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, part, turn, role, text, a, b (hashes of role and text), each turn once."""
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return rows.distinct().select("*", F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(NO_TURN)).cast("long").alias("part"), _hash(1, "role", "text").alias("a"), _hash(2, "role", "text").alias("b"))


def prefixes(rows: DataFrame) -> DataFrame:
    """conv_id, n (turns so far), p, q (rolling hashes), length of the conversation; a row a turn."""
    by = Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "role", "a", "b")
    inside = rows.select("conv_id", "part", "turn", "role", "a", "b").withColumn("k", F.row_number().over(by))
    sizes = inside.groupBy("conv_id", "part").agg(F.max("k").alias("size"))
    over = Window.partitionBy("conv_id").orderBy("part")  # a row for each chunk
    offsets = cut(sizes.select("conv_id", "part", (F.sum("size").over(over) - F.col("size")).alias("before")))
    numbered = inside.join(offsets, ["conv_id", "part"]).withColumn("n", F.col("before") + F.col("k"))
    hashed = numbered.select("conv_id", "part", "n", _hash(3, "n", "a", "b").alias("x"), _hash(4, "n", "a", "b").alias("y"))
    totals = hashed.groupBy("conv_id", "part").agg(F.bit_xor("x").alias("tx"), F.bit_xor("y").alias("ty"), F.max("n").alias("last"))
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("conv_id", "part", F.coalesce(F.bit_xor("tx").over(earlier), F.lit(0)).alias("cx"), F.coalesce(F.bit_xor("ty").over(earlier), F.lit(0)).alias("cy"), F.max("last").over(Window.partitionBy("conv_id")).alias("length"))
    rolling = Window.partitionBy("conv_id", "part").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return (
        hashed.select("conv_id", "part", "n", F.bit_xor("x").over(rolling).alias("x"), F.bit_xor("y").over(rolling).alias("y"))
        .join(carried, ["conv_id", "part"])
        .select("conv_id", "n", F.col("x").bitwiseXOR(F.col("cx")).alias("p"), F.col("y").bitwiseXOR(F.col("cy")).alias("q"), "length")
    )


def maximal(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_same of the conversations that no other one continues."""
    marked = cut(prefixes(rows))
    whole = marked.where("n = length").groupBy("n", "p", "q").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_same"))
    proper = marked.where("n < length").select("n", "p", "q").distinct()
    return whole.join(proper, ["n", "p", "q"], "left_anti").select("conv_id", F.col("n").cast("long").alias("n_turns"), "n_same")


def render(rows: DataFrame, kept: DataFrame, whole: int = WHOLE) -> DataFrame:
    """conv_id, part, n_turns, n_same, text: the kept conversations, a row each, or several beyond ``whole`` characters."""
    said = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>\n"))
    turn = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", "role", "a", "b", said.alias("said"))
    sizes = rows.groupBy("conv_id", "part").agg(F.sum(F.length("role") + F.length("text") + 14).alias("size"))  # a row for each chunk
    before = F.sum("size").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("size")
    where = sizes.select("conv_id", "part", F.floor(before / whole).alias("row")).join(kept, "conv_id")
    grouped = rows.join(where, ["conv_id", "part"]).groupBy("conv_id", "row").agg(F.first("n_turns").alias("n_turns"), F.first("n_same").alias("n_same"), F.array_sort(F.collect_list(turn)).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: t["said"]), "")
    return grouped.select("conv_id", F.col("row").cast("long").alias("part"), "n_turns", "n_same", text.alias("text"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maximal conversations, rendered."""
    rows = cut(turns(table(spark, sf_dir, "conversations")))  # the texts are shuffled for it once
    return render(rows, maximal(rows))


SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(role || chr(1) || text ORDER BY turn NULLS FIRST) AS l, string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '' ORDER BY turn NULLS FIRST) AS text FROM t GROUP BY conv_id),
w AS (SELECT len(l) AS n, md5(array_to_string(l, chr(2))) AS h, min(conv_id) AS conv_id, count(*) AS n_same FROM c GROUP BY ALL),
p AS (SELECT DISTINCT i AS n, md5(array_to_string(list_slice(l, 1, i), chr(2))) AS h FROM (SELECT l, unnest(generate_series(1, len(l) - 1)) AS i FROM c WHERE len(l) > 1))
SELECT w.conv_id AS conv_id, CAST(0 AS BIGINT) AS part, CAST(w.n AS BIGINT) AS n_turns, w.n_same AS n_same, c.text AS text
FROM w JOIN c ON w.conv_id = c.conv_id WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.n = w.n AND p.h = w.h)
"""

"""Text search: an index of entries, scores by term, top hits, groups."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions.text import fold_accents

#: Letters of a term by which entries are found.
PIECE = 3
#: Up to so many queries are sent to every task, so that the index stays where it is; beyond, the join shuffles.
BROADCAST_QUERIES = 10_000


def prepare_index(entries: DataFrame) -> DataFrame:
    """Entries (kind, id, title, subline, keywords) with their normalised forms and title words."""
    norm = lambda c: F.coalesce(fold_accents(F.col(c)), F.lit(""))
    return entries.withColumn("n_title", norm("title")).withColumn("n_subline", norm("subline")).withColumn("n_keywords", norm("keywords")).withColumn("words", F.filter(F.split("n_title", r"[^\p{L}\p{N}']+"), lambda w: w != ""))


def _pieces(text: Column, n: int) -> Column:
    """All runs of n letters of a text, each once."""
    at = F.sequence(F.lit(1), F.length(text) - n + 1)
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(at, lambda i: F.substr(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def term_score(term: Column) -> Column:
    """A term's score in an entry: 40 at the title's start, 30 at a word's, 20 inside; 8 subline, 4 keywords; 0 none."""
    title = F.when(F.startswith("n_title", term), 40).when(F.exists("words", lambda w: F.startswith(w, term)), 30).when(F.contains("n_title", term), 20).otherwise(0)
    return title + F.when(F.contains("n_subline", term), 8).otherwise(0) + F.when(F.contains("n_keywords", term), 4).otherwise(0)


def time_score(now: Column) -> Column:
    """25 for an event that is on, 15 for one that starts within three hours, -5 for one that is over (columns starts, ends)."""
    on = F.when((F.col("starts") <= now) & (now < F.col("ends")), 25).when((F.col("starts") > now) & (F.col("starts") < now + F.expr("INTERVAL 3 HOURS")), 15).when(F.col("ends") < now, -5)
    return F.when((F.col("kind") == "event") & F.col("starts").isNotNull() & F.col("ends").isNotNull(), on)


def score_search(index: DataFrame, queries: DataFrame, now: Column | None = None) -> DataFrame:
    """query_id, kind, id, title, score: hits of each query (query_id, terms, phrase).

    All terms must score. A phrase of two letters or more adds 100 as the whole
    title, 60 at its beginning, 30 inside; an area or region adds 3. With ``now``
    events (starts, ends) have their time's part. An entry meets the queries
    whose longest term begins with letters that it holds: an equi join on pieces
    of up to ``PIECE`` letters, so entries and queries may be any number; of an
    entry's pieces only those that some query begins with leave their row,
    where the queries are few enough to be sent to every task.
    """
    longest = F.array_max(F.transform("terms", lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    q = queries.withColumn("_piece", F.substring(longest, 1, PIECE))
    few = queries.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES
    sizes = [r.n for r in q.select(F.length("_piece").alias("n")).distinct().where("n > 0").collect()]  # 1 to PIECE
    own = F.flatten(F.array(*(_pieces(F.col("_all"), n) for n in sizes))) if sizes else F.array().cast("array<string>")
    if few:
        asked = [r._piece for r in q.select("_piece").distinct().where("_piece <> ''").collect()]  # a piece a query
        own, q = F.array_intersect(own, F.array(*map(F.lit, asked)).cast("array<string>")), F.broadcast(q)
    whole = F.concat_ws("\n", "n_title", "n_subline", "n_keywords")
    pairs = index.withColumn("_all", whole).withColumn("_piece", F.explode(own)).drop("_all").join(q, "_piece")
    scores = F.transform("terms", lambda t: term_score(t))
    phrase = F.col("phrase")
    extra = F.when(F.length(phrase) < 2, 0).when(F.col("n_title") == phrase, 100).when(F.startswith("n_title", phrase), 60).when(F.contains("n_title", phrase), 30).otherwise(0)
    total = F.aggregate(scores, F.lit(0), lambda a, s: a + s) + extra + F.when(F.col("kind").isin("area", "region"), 3).otherwise(0)
    if now is not None:
        total = total + F.coalesce(time_score(now), F.lit(0))
    return pairs.where(F.forall(scores, lambda s: s > 0)).select("query_id", "kind", "id", "title", total.alias("score"), ((F.length(phrase) > 1) & (F.col("n_title") == phrase)).alias("exact"))


def search_top(hits: DataFrame, n: int = 200) -> DataFrame:
    """The first n hits of each query, by score, title, kind, id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "title", "kind", "id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def group_hits(top: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """The first n of each kind with the kind's total; the kind of an exact first hit leads."""
    by = Window.partitionBy("query_id", "kind")
    at = F.array_position(F.array(*map(F.lit, order)), F.col("kind"))
    lead = F.max(F.when((F.col("rank") == 1) & F.col("exact"), 1).otherwise(0)).over(by)
    out = top.withColumn("total", F.count("*").over(by)).withColumn("in_kind", F.row_number().over(by.orderBy("rank"))).withColumn("kind_order", F.when(lead == 1, 0).otherwise(F.when(at == 0, 99).otherwise(at)))
    return out.where(F.col("in_kind") <= n)


def mark_spans(texts: DataFrame, terms: list[str]) -> DataFrame:
    """The rows of texts, one for each match, with ``start`` (from 1) and ``length``.

    Terms of one letter are left out; the longest term that begins first
    counts, and the search goes on behind it. A text whose length folding
    changes has no matches, so that none is misplaced. Matches are numbered by a
    running sum over a text's own pieces, so a text may hold any number.
    """
    told = sorted({t for t in terms if len(t) > 1}, key=lambda t: (-len(t), t))
    if not told:
        return texts.limit(0).select("*", F.lit(1).cast("long").alias("start"), F.lit(1).alias("length"))
    any_ = "|".join(re.escape(t) for t in told)
    folded = texts.withColumn("_row", F.monotonically_increasing_id()).withColumn("_folded", fold_accents(F.col("text"))).where(F.length("_folded") == F.length("text"))
    pieces = F.arrays_zip(F.split("_folded", any_).alias("between"), F.regexp_extract_all("_folded", F.lit(f"({any_})"), F.lit(1)).alias("hit"))
    each = folded.where(F.col("_folded").rlike(any_)).select("*", F.posexplode(pieces).alias("_at", "_piece")).drop("_folded")
    size = F.length(F.coalesce("_piece.hit", F.lit("")))
    done = F.sum(F.length("_piece.between") + size).over(Window.partitionBy("_row").orderBy("_at"))
    return each.withColumn("start", (done - size + 1).cast("long")).withColumn("length", size).where("_piece.hit is not null").drop("_row", "_at", "_piece")

"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A document is cut into blocks of ``BLOCK_WORDS`` words (the last one may be
shorter). A source's quota is the number of blocks that its target comes to;
beyond its number of blocks it goes on in further passes. The quotas are split
among the output shards by a binary tree: a node's vector of quotas is dealt to
its two children as a draw without replacement, sized by their numbers of shards,
so a shard gets whole blocks of each source and all shards together get the exact
quotas. A source's blocks are put in a permuted order (by a keyed hash), pass
after pass; each shard takes its own run of ranks, so the shards' draws are
disjoint, and orders its own blocks by another keyed hash. What the mix takes of
a document is what its shards have of it.

Ranks come from hash ranges: blocks are counted for each (source, range), the
ranges' offsets are summed, and only within a range rows are numbered. No step
needs a source's blocks together. The upper ``MAX_TOP`` nodes of the tree are
split on the driver; where there are more shards, each node's own tree is split by
the task that its blocks come to.

Defined results: a null or empty text has size 0, no blocks and is never taken;
a null source is a source of its own (last); repeated rows are documents of
their own; an empty table gives no rows. Columns other than ``doc_id``,
``text`` and ``source`` are not looked at. All draws depend on ``seed`` only.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log, log1p, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almanac.llm.common import cut, table, unused
from almanac.llm.textops import SPACED, word_slices

BLOCK_WORDS = 32
#: Words that a shard is to hold, about.
SHARD_WORDS = 1 << 20
#: Most shards whose split is made on the driver; and most sources (a row each is held there).
MAX_TOP = 1024
MAX_SOURCES = 10_000
#: Blocks in a hash range, about; most ranges of a source (the ranges grow then).
RANGE = 500
MAX_RANGES = 1 << 17
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0


def sized(docs: DataFrame) -> DataFrame:
    """row, doc_id, source and size (words) of every document; docs has row, doc_id, source, text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.zeros(batch.num_rows, np.int64)
            for lo, hi, w in word_slices(batch.column("text"), SPACED):
                size[lo:hi] = w.counts
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(size)], names=["row", "doc_id", "source", "size"])

    return docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")).mapInArrow(count, "row long, doc_id long, source string, size long")


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Each source's target words: shares by weight, at most ``most`` times its size."""
    weight = np.array([weights[k % len(weights)] for k in range(len(sizes))], float)
    size = np.array(sizes, float)
    limit, out, open_ = most * size, np.zeros(len(sizes)), np.ones(len(sizes), bool)
    left = share * size.sum()
    while open_.any():
        part = np.where(open_, left * weight / weight[open_].sum(), 0)
        above = open_ & (part > limit)
        if not above.any():
            out[open_] = part[open_]
            break
        out[above] = limit[above]
        left -= limit[above].sum()
        open_ &= ~above
    return out.tolist()


def _stirling(n: int) -> float:
    """log n! less Stirling's formula for it."""
    if n < 16:
        return lgamma(n + 1) - (n + 0.5) * log(n) + n - 0.5 * log(2 * pi) if n else 0.0
    return (1 / 12 - (1 / 360 - 1 / (1260 * n * n)) / (n * n)) / n


def _deviance(x: int, m: float) -> float:
    """x log(x / m) + m - x, without loss where x is near m."""
    if not x:
        return m
    d = (x - m) / m
    if abs(d) > 0.1:
        return x * log(x / m) + m - x
    # (1 + d) log(1 + d) - d as its series
    total, term, k = 0.0, d * d, 2
    while abs(term) > 1e-18 * max(total, 1e-300) and k < 60:
        total += term / (k * (k - 1)) * (1 if k % 2 == 0 else -1)
        term *= d
        k += 1
    return m * total


def _log_binomial(x: int, n: int, p: float, q: float) -> float:
    if not x or x == n:
        return n * (log1p(-p) if p < 0.5 else log(q)) if not x else n * (log1p(-q) if q < 0.5 else log(p))
    return _stirling(n) - _stirling(x) - _stirling(n - x) - _deviance(x, n * p) - _deviance(n - x, n * q) + 0.5 * (log(n) - log(2 * pi) - log(x) - log(n - x))


def log_hypergeometric(k: int, good: int, bad: int, n: int) -> float:
    """The log of the chance of k good ones in a draw of n, also for numbers far beyond 10^9."""
    p, q = n / (good + bad), (good + bad - n) / (good + bad)
    return _log_binomial(k, good, p, q) + _log_binomial(n - k, bad, p, q) - _log_binomial(n, good + bad, p, q)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Good ones in a draw of n without replacement; exact at any size.

    numpy's own generator ends at 10^9. Beyond, Devroye's rejection for log-concave
    laws: a flat middle and exponential tails around the mode hold the law below them.
    """
    if not n or not good:
        return 0
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    lo, hi = max(0, n - bad), min(good, n)
    if lo == hi:
        return lo
    mode = min(hi, max(lo, (n + 1) * (good + 1) // (good + bad + 2)))
    top = log_hypergeometric(mode, good, bad, n)
    p = exp(top)
    w = 1 + p / 2
    while True:
        y = rng.random() * w / p if rng.random() <= w / (1 + w) else (w + rng.exponential()) / p
        k = mode + round(y if rng.random() < 0.5 else -y)
        if lo <= k <= hi and log(1 - rng.random()) + min(0.0, w - p * y) <= log_hypergeometric(k, good, bad, n) - top:
            return k


def _draw(rng: np.random.Generator, quota: np.ndarray, n: int) -> np.ndarray:
    """n of the blocks of the given numbers, without replacement, by source."""
    out, left = np.zeros_like(quota), int(quota.sum())
    for k, q in enumerate(quota.tolist()):
        out[k] = n if left <= q else hypergeometric(rng, q, left - q, n)
        n -= int(out[k])
        left -= q
        if not n:
            break
    return out


def split(quota: list[int], shards: int, seed: int) -> np.ndarray:
    """Blocks of each source (rows) in each shard (columns)."""
    out = np.zeros((len(quota), shards), np.int64)

    def node(part: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[:, lo] = part
            return
        mid = (lo + hi) // 2
        total = int(part.sum())
        if not total:
            return
        left = _draw(np.random.default_rng([seed, lo, hi]), part, total * (mid - lo) // (hi - lo))
        node(left, lo, mid)
        node(part - left, mid, hi)

    if quota:
        node(np.array(quota, np.int64), 0, shards)
    return out


def _key(seed: int, salt: int, *columns: str) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(salt), *(F.col(c) for c in columns))


def mix(docs: DataFrame, seed: int = 20240917, shard_words: int = SHARD_WORDS, top: int = MAX_TOP, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, blocks).

    documents: row, doc_id, size, source_size, target. blocks: row, block (its
    number in the document), words, shard, place (its order in the shard) of each
    drawn block, once for each pass in which it is drawn. ``row`` tells documents
    apart: the column of docs that is named, else a new number of each row.
    """
    spark = docs.sparkSession
    # a row number that stays, as doc_id may repeat or be null
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    rows = cut(sized(docs.select(number.alias("row"), "doc_id", "source", "text")))
    per = rows.groupBy("source").agg(F.sum("size").alias("size"), F.sum(F.ceil(F.col("size") / BLOCK_WORDS)).alias("blocks")).limit(MAX_SOURCES + 1).collect()
    if len(per) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    per.sort(key=lambda r: (r.source is None, r.source or ""))
    target = targets([r["size"] for r in per])
    plan = [(k, r.source, r["size"], float(t), r.blocks, round(t / r["size"] * r.blocks) if r["size"] else 0, int(np.clip(r.blocks // RANGE, 1, MAX_RANGES))) for k, (r, t) in enumerate(zip(per, target, strict=True))]
    shards = int(max(1, -(-sum(target) // shard_words)))
    under = -(-shards // top)  # shards below each of the nodes that are split here
    ends = np.cumsum(split([p[5] for p in plan], -(-shards // under), seed), axis=1)
    small = F.broadcast(spark.createDataFrame(plan, "k int, source string, source_size long, target double, n long, quota long, ranges long"))  # MAX_SOURCES rows at most
    known = rows.join(small, rows.source.eqNullSafe(small.source)).drop(small.source)
    blocks = (
        known.where("size > 0 and quota > 0")
        .select("row", "doc_id", "k", "n", "quota", "ranges", "size", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("size") / BLOCK_WORDS) - 1).cast("int"))).alias("block"))
        .withColumn("order", _key(seed, 1, "doc_id", "size", "block"))
        .withColumn("range", F.pmod(F.shiftrightunsigned("order", 20), F.col("ranges")))
    )
    counts = cut(blocks.groupBy("k", "range").agg(F.count("*").alias("m")))
    before = counts.select("k", "range", (F.sum("m").over(Window.partitionBy("k").orderBy("range")) - F.col("m")).alias("before"))
    # ranges that the quota ends before are not needed; the others get their rows numbered
    ranked = (
        blocks.join(before, ["k", "range"])
        .where("before < quota")
        .withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("k", "range").orderBy("order", "row", "block")) - 1)
        .where("rank < quota")
        .withColumn("rank", F.explode(F.sequence(F.col("rank"), F.col("quota") - 1, F.col("n"))))  # its ranks in all passes
    )

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The node of each rank, and its rank within the node; ranks that no node has are drawn by none."""
        for batch in batches:
            k, rank = batch.column("k").to_numpy(), batch.column("rank").to_numpy()
            node, inside = np.zeros(len(k), np.int64), rank.copy()
            for s in np.unique(k):
                own = k == s
                node[own] = np.searchsorted(ends[s], rank[own], "right")
                inside[own] -= np.concatenate([[0], ends[s]])[node[own]]
            out = pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(inside), pa.array(node)], names=["row", "block", "words", "k", "rank", "shard"])
            yield out.filter(pa.array(node < ends.shape[1]))

    def deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shard of each rank of a node, by the tree of that node."""
        trees: dict[int, np.ndarray] = {}
        for batch in batches:
            k, rank, node = (batch.column(c).to_numpy() for c in ("k", "rank", "shard"))
            shard = np.zeros(len(k), np.int64)
            for t in np.unique(node).tolist():
                if t not in trees:
                    quota = (ends[:, t] - (ends[:, t - 1] if t else 0)).tolist()
                    trees = {t: np.cumsum(split(quota, min(under, shards - t * under), seed + 1 + t), axis=1)}  # one at a time: rows come by node
                for s in np.unique(k[node == t]):
                    own = (node == t) & (k == s)
                    shard[own] = t * under + np.searchsorted(trees[t][s], rank[own], "right")
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(shard)], schema=batch.schema)

    kinds = "row long, block int, words long, k int, rank long, shard long"
    drawn = ranked.select("row", "block", F.least(F.lit(BLOCK_WORDS), F.col("size") - BLOCK_WORDS * F.col("block")).cast("long").alias("words"), "k", "rank").mapInArrow(dealt, kinds)
    if under > 1:
        drawn = drawn.repartitionByRange("shard").sortWithinPartitions("shard").mapInArrow(deeper, kinds)
    return known.select("row", "doc_id", "size", "source_size", "target"), drawn.select("row", "block", "words", "shard", _key(seed, 2, "row", "block", "rank").alias("place"))


def taken(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """The documents with ``taken``, the words that the shards' blocks have of each."""
    drawn = blocks.groupBy("row").agg(F.sum("words").alias("drawn"))
    return documents.join(drawn, "row", "left").withColumn("taken", F.coalesce("drawn", F.lit(0).cast("long"))).drop("drawn")


def materialised(docs: DataFrame, seed: int = 20240917, shard_words: int = SHARD_WORDS) -> DataFrame:
    """shard, place, doc_id, source, text of every drawn block: the mix itself, in the shards' order.

    A block's text is its words, joined by a space. Write it by ``shard``.
    """
    rows = cut(docs.select("doc_id", "source", "text", F.monotonically_increasing_id().alias("row")))
    _, blocks = mix(rows, seed, shard_words, row="row")
    words = F.split(F.regexp_replace(F.col("text").cast("string"), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), r"[\x20\x09-\x0D]+")
    pieces = rows.select("row", "doc_id", "source", words.alias("w")).select("row", "doc_id", "source", F.posexplode(F.transform(F.sequence(F.lit(0), F.ceil(F.size("w") / BLOCK_WORDS).cast("int") - 1), lambda i: F.array_join(F.slice("w", i * BLOCK_WORDS + 1, BLOCK_WORDS), " "))).alias("block", "text"))
    found = blocks.select("row", "block", "shard", "place").join(pieces, ["row", "block"])
    return found.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place", "row", "block").select("shard", "place", "doc_id", "source", "text")


def mixed(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes words of, with size, source_size, target and taken.

    A name that the table has already gets an underscore and a number (``_size0``).
    """
    (row,) = unused(docs, "row")
    have = {c.lower() for c in docs.columns}
    new = {c: unused(docs, c)[0] if c in have else c for c in ("size", "source_size", "target", "taken")}
    rows = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    share = taken(*mix(rows, row=row)).where("taken > 0")
    share = share.select(F.col("row").alias(row), *(F.col(c).alias(n) for c, n in new.items()))
    return rows.join(share, row).select(*docs.columns, *new.values())


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's size, its source's size and target, the words taken."""
    return taken(*mix(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")

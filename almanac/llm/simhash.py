"""SimHash near-duplicates: fingerprints, vantage-point trees, components.

A pair within ``RADIUS`` = 3 of 64 bits is within 1 bit in one of both 32-bit
halves. So two vantage-point trees, one on each half, find all pairs with a
search radius of 1. A tree's upper part is built from a bounded sample of
fingerprints; it deals all distinct fingerprints out to shards. At a node, a
fingerprint at most a median distance from the vantage point goes to the near
side; a farther one goes to the far side and, by the triangle bound, also to
the near side if it is within the radius of the boundary. Each pair within the
radius thus meets in a shard. Within a shard the tree goes on in memory (up to
``MOST_BLOCK`` fingerprints of 8 bytes) down to small leaves, whose fingerprints
are compared on all 64 bits. Shards of more than twice the mean, or than that
bound, are split into blocks that meet pairwise.

A block returns links that join each found group (a spanning star), not all its
pairs. Components come from minimum labels that spread along the links in
rounds of joins and aggregations, each written to the shared folder.

Defined results: a null text is empty; empty texts have fingerprint zero and
are linked; identical texts share a fingerprint and so a component; a null
doc_id gets a row but never names a component, unless its component has no
other; repeated rows stay.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm.common import cut, discard, hashed_sample, shared_dir, table
from almanac.llm.textops import buffers

RADIUS = 3
SHINGLE = 3
#: Least and most fingerprints (8 bytes each) that the upper part of a tree is built from: a sixteenth of all between.
SAMPLE = 1 << 16
MOST_SAMPLE = 1 << 20
#: About so many fingerprints are aimed at in a shard; a part of a block has so many at least and at most.
SHARD = 1500
BLOCK = 1000
MOST_BLOCK = 1 << 20
#: Copies of a fingerprint that a level makes, about (those within 1 bit of a median of 16 bits).
COPIES = 1.14
#: A leaf that is compared pair by pair.
LEAF = 192
_HALF = np.uint64(0xFFFFFFFF)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    hashes = np.fromiter((xxhash.xxh64_intdigest(p, 42) for p in parts), np.uint64)
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[lo : lo + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and its fingerprint as a signed 64-bit number."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            out = np.fromiter((fingerprint(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)), np.uint64, len(offsets) - 1)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fp": out.view(np.int64)}, schema=pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())]))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(made, "doc_id long, fp long")


class Tree:
    """The upper part of a vantage-point tree on one half of the bits."""

    def __init__(self, sample: np.ndarray, shift: int, depth: int, radius: int):
        self.shift, self.radius, self.depth = np.uint64(shift), radius, depth
        self.nodes: dict[int, tuple[np.uint64, int]] = {}
        self._build(1, (sample >> self.shift) & _HALF, depth)

    def _build(self, node: int, part: np.ndarray, depth: int) -> None:
        if not depth or len(part) < 2:
            return
        vantage = part[0]
        distance = np.bitwise_count(part ^ vantage).astype(np.int64)
        median = int(np.median(distance[1:]))
        self.nodes[node] = (vantage, median)
        self._build(2 * node, part[1:][distance[1:] <= median], depth - 1)
        self._build(2 * node + 1, part[1:][distance[1:] > median], depth - 1)

    def deal(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of a fingerprint, shard) for all shards that it goes to."""
        out: list[tuple[np.ndarray, int]] = []
        half = (fps >> self.shift) & _HALF
        todo = [(1, np.arange(len(fps)))]
        while todo:
            node, index = todo.pop()
            if not len(index):
                continue
            if node not in self.nodes:
                out.append((index, node))
                continue
            vantage, median = self.nodes[node]
            distance = np.bitwise_count(half[index] ^ vantage)
            todo.append((2 * node, index[distance <= median + self.radius]))
            todo.append((2 * node + 1, index[distance > median]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([i for i, _ in out]), np.concatenate([np.full(len(i), n) for i, n in out])


def _join(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> None:
    """Join the groups of linked entries; each entry's label is its group's least one, before and after."""
    while True:
        p, q = label[a], label[b]
        low = np.minimum(p, q)
        if np.array_equal(p, q):
            return
        np.minimum.at(label, p, low)
        np.minimum.at(label, q, low)
        while not np.array_equal(further := label[label], label):
            label[:] = further


def _compare(fps: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all groups of both sides' pairs within the radius on all bits."""
    i, j = np.nonzero(np.bitwise_count(fps[left][:, None] ^ fps[right][None, :]) <= radius)
    both = np.concatenate([left, right])
    label = np.arange(len(both))
    _join(i, j + len(left), label)
    moved = np.flatnonzero(label != np.arange(len(both)))
    return both[moved], both[label[moved]]


def linked(fps: np.ndarray, shift: int, radius: int) -> np.ndarray:
    """For each of distinct fingerprints the index of the least one that it is linked to.

    The tree is on the 32 bits from ``shift`` on. Fingerprints that no vantage
    point parts there are as good as equal in them, so a pair is within half the
    radius in one of the other half's two quarters: they get a tree on each.
    """
    label = np.arange(len(fps))
    other = 32 - shift
    found: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0
    todo = [(np.arange(len(fps)), shift, 32)]
    while todo:
        part, at, bits = todo.pop()
        if len(part) > LEAF:
            own = (fps[part] >> np.uint64(at)) & np.uint64((1 << bits) - 1)
            distance = np.bitwise_count(own ^ own[len(part) // 2]).astype(np.int64)
            median = int(np.median(distance))
            inner, outer = distance <= median + radius // 2, distance > median
            if inner.sum() < 0.95 * len(part) and outer.any():
                todo += [(part[inner], at, bits), (part[outer], at, bits)]
                continue
            if bits == 32:
                todo += [(part, other, 16), (part, other + 16, 16)]
                continue
        for lo in range(0, len(part), LEAF):  # also what no vantage point parts
            for to in range(lo, len(part), LEAF):
                found.append(_compare(fps, part[lo : lo + LEAF], part[to : to + LEAF], radius))
                waiting += len(found[-1][0])
        if found and (waiting > len(fps) or not todo):
            _join(*map(np.concatenate, zip(*found, strict=True)), label)
            found, waiting = [], 0
    return label


def links(fps: DataFrame, radius: int = RADIUS, sample_size: int = SAMPLE, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """a, b: links that join all groups of distinct fingerprints ``fp``.

    A level halves a shard but for the copies, so the depth follows the number
    of fingerprints, as far as the sample can tell the medians.
    """
    n = fps.count()
    sample_size = int(np.clip(n // 16, sample_size, MOST_SAMPLE))
    sample = np.array([r.fp for r in hashed_sample(fps.select("fp"), F.col("fp"), sample_size, n).collect()], np.int64).view(np.uint64)  # bounded
    depth = int(np.clip(np.ceil(np.log(max(n, 1) / shard) / np.log(2 / COPIES)), 0, np.log2(sample_size) - 3))
    trees = [Tree(sample, shift, depth, radius // 2) for shift in (0, 32)]

    def deal(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(fingerprints, shards) of a batch, by tree."""
        own = batch.column("fp").to_numpy().view(np.uint64)
        for k, tree in enumerate(trees):
            i, node = tree.deal(own)
            yield own[i].view(np.int64), 2 * node + k

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, where in deal(batch):
                shards, n = np.unique(where, return_counts=True)
                yield pa.RecordBatch.from_pydict({"shard": shards, "n": n}, schema=pa.schema([("shard", pa.int64()), ("n", pa.int64())]))

    # parts of a shard, each a block with every other: no block gets more than two parts
    sizes = {r.shard: r.n for r in fps.mapInArrow(counted, "shard long, n long").groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row for each shard: fewer than sampled fingerprints
    block = int(np.clip(2 * sum(sizes.values()) // max(len(sizes), 1), block, MOST_BLOCK))
    big = {s: p for s, m in sizes.items() if (p := -(-m // block)) > 1}

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("fp", pa.int64()), ("shard", pa.int64()), ("i", pa.int64()), ("j", pa.int64())])
        for batch in batches:
            for fp, where in deal(batch):
                split = np.isin(where, np.fromiter(big, np.int64, len(big)))
                zero = np.zeros(int((~split).sum()), np.int64)
                yield pa.RecordBatch.from_pydict({"fp": fp[~split], "shard": where[~split], "i": zero, "j": zero}, schema=schema)
                for s in np.unique(where[split]).tolist():
                    own, p = fp[where == s], big[s]
                    part = (((own.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(p)).astype(np.int64)
                    for other in range(p):
                        yield pa.RecordBatch.from_pydict({"fp": own, "shard": np.full(len(own), s), "i": np.minimum(part, other), "j": np.maximum(part, other)}, schema=schema)

    def joined(key: tuple, rows: pa.Table) -> pa.Table:
        own = np.unique(rows.column("fp").to_numpy())
        label = linked(own.view(np.uint64), 32 * (key[0].as_py() % 2), radius)
        moved = np.flatnonzero(label != np.arange(len(own)))
        return pa.table({"a": own[moved], "b": own[label[moved]]})

    return fps.mapInArrow(blocks, "fp long, shard long, i long, j long").groupBy("shard", "i", "j").applyInArrow(joined, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node that it is linked to) of all ends of links a-b.

    Each round takes the least label among neighbours, then the label's own
    label, so that a path's length about halves or better with each round; labels
    only fall, so the rounds end. A round's table is deleted once the next is written.
    """
    spark = edges.sparkSession
    folder = f"{shared_dir(spark)}/components-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        """Written and read again: unlike a checkpoint, that also drops the plan's size estimate, which grows with each join."""
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    both = kept(edges.unionByName(edges.selectExpr("b a", "a b")).distinct(), "edges")
    labels = kept(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "0")
    for k in count(1):
        low = both.join(labels.selectExpr("node b", "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("low"))
        lower = labels.join(low, "node").select("node", F.least("label", "low").alias("label"), F.col("label").alias("was"))
        jump = labels.selectExpr("node label", "label further")
        step = lower.join(jump, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"), "was")
        labels = kept(step.select("node", "label", (F.col("label") < F.col("was")).alias("moved")), str(k))
        moved = labels.where("moved")
        discard(spark, f"{folder}/{k - 1}")
        labels = labels.select("node", "label")
        if moved.isEmpty():
            discard(spark, f"{folder}/edges")
            return labels


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id of every document."""
    marked = cut(fingerprints(docs))
    least = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = components(links(least.select("fp"), radius))
    grouped = least.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    named = cut(grouped.groupBy("label").agg(F.min("least").alias("component_id")))
    # both sides of these joins are tables of their own, so the rows of a large component or fingerprint can be split
    return marked.join(grouped.select("fp", "label").join(named, "label").select("fp", "component_id"), "fp")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

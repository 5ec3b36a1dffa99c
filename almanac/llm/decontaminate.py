"""Benchmark decontamination with a generalised suffix automaton.

The benchmark's items are split into lower-cased words and put into one suffix
automaton (suffixes never run from one item into the next). Training texts are
streamed through it word by word; the state and the longest matching length say
which windows of ``window`` item words end at a word. An item of fewer words is
one window.

Automata are built by tasks, for blocks of distinct item texts of about
``BLOCK_BYTES`` each, and written to the shared folder as sorted arrays (some 7
bytes for each byte of text). A scanning task holds one of them. With one block
the documents are marked as they pass; with more, each block's pass returns its
hits only, which are brought together by document before anything is counted or
cut, so the blocks make no difference to the result.

Runs of known words are followed side by side, in pieces that overlap by a window
less one word.

Defined results: a null text has no words; an item without words is ignored;
repeated items count once (by item_id); repeated documents each get their row;
an empty benchmark hits nothing; columns other than ``doc_id``/``text`` and
``item_id``/``text`` are never looked at.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm.common import cut, shared_dir, table, unused
from almanac.llm.textops import ALNUM, Words, word_slices

#: About so many bytes of benchmark text go into one automaton (its task needs some 120 times that while it builds).
BLOCK_BYTES = 2 << 20
#: Words of a run that are followed at a time.
PIECE = 256

SPANS = "array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>"


class Builder:
    """Generalised suffix automaton over word numbers, as it is built."""

    def __init__(self, items: list[tuple[list[str], np.ndarray]], window: int):
        """items: (item ids, the hashes of their words)."""
        items = [(ids, words) for ids, words in items if len(words)]
        self.vocabulary = np.unique(np.concatenate([words for _, words in items])) if items else np.zeros(0, np.uint64)
        self.link, self.length, self.next = [-1], [0], [{}]
        coded = [(ids, np.searchsorted(self.vocabulary, words).tolist()) for ids, words in items]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        n = len(self.link)
        by_length = sorted(range(1, n), key=self.length.__getitem__)
        #: The state that holds the suffix of ``window`` words, for longer matches.
        self.anchor = [0] * n
        for v in by_length:
            self.anchor[v] = v if self.length[self.link[v]] < window else self.anchor[self.link[v]]
        #: State -> items with the window that ends there; state -> short items.
        self.items: dict[int, set[str]] = {}
        own: dict[int, dict[int, set[str]]] = {}
        self.shortest = window
        for ids, codes in coded:
            v = 0
            for i, c in enumerate(codes):
                v = self.next[v][c]
                if i >= window - 1:
                    self.items.setdefault(self.anchor[v], set()).update(ids)
            if len(codes) < window:
                self.shortest = min(self.shortest, len(codes))
                while self.length[self.link[v]] >= len(codes):
                    v = self.link[v]
                own.setdefault(v, {}).setdefault(len(codes), set()).update(ids)
        self.short: dict[int, list[tuple[int, list[str]]]] = {}
        for v in by_length:
            if found := [*((k, sorted(ids)) for k, ids in own.get(v, {}).items()), *self.short.get(self.link[v], [])]:
                self.short[v] = found

    def packed(self) -> bytes:
        """The automaton as arrays; edges are sorted by (state, word)."""
        keys = np.array([v << 32 | c for v, edges in enumerate(self.next) for c in edges], np.int64)
        to = np.array([q for edges in self.next for q in edges.values()], np.int32)
        order = np.argsort(keys)
        said = json.dumps({"shortest": self.shortest, "items": {v: sorted(ids) for v, ids in self.items.items()}, "short": self.short})
        out = io.BytesIO()
        np.savez(out, vocabulary=self.vocabulary, link=np.array(self.link, np.int32), length=np.array(self.length, np.int32), anchor=np.array(self.anchor, np.int32), keys=keys[order], to=to[order], said=np.frombuffer(said.encode(), np.uint8))
        return out.getvalue()

    def _add(self, length: int, link: int, edges: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(edges)
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state of the longest string of p followed by c, taken out of q."""
        clone = self._add(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:  # another item has this far been the same
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new = self._add(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new


class Automaton:
    """A built automaton, followed by many runs of words at a time."""

    def __init__(self, data: bytes, window: int):
        with np.load(io.BytesIO(data)) as held:
            self.vocabulary, self.link, self.length, self.anchor, self.keys, self.to = (held[c] for c in ("vocabulary", "link", "length", "anchor", "keys", "to"))
            said = json.loads(held["said"].tobytes())
        self.window, self.shortest = window, said["shortest"]
        self.items = {int(v): ids for v, ids in said["items"].items()}
        self.short = {int(v): found for v, found in said["short"].items()}
        self.has_short = np.zeros(len(self.link), bool)
        self.has_short[list(self.short)] = True

    def _pieces(self, words: Words, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, last + 1) of the pieces of runs of known words of a row, longest first."""
        step = np.diff(known.astype(np.int8), prepend=0, append=0)
        cuts = words.first[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(known))]
        cuts = np.unique(cuts[known[cuts] & known[cuts - 1]])
        starts = np.sort(np.concatenate([np.flatnonzero(step == 1), cuts]))
        ends = np.sort(np.concatenate([np.flatnonzero(step == -1), cuts]))
        long = ends - starts >= self.shortest
        starts, ends = starts[long], ends[long]
        size = PIECE + self.window
        n = np.maximum(1, -(-(ends - starts - self.window + 1) // (PIECE + 1)))  # each begins with the window - 1 words before what is its own
        which = np.repeat(np.arange(len(starts)), n)
        first = starts[which] + (np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)) * (PIECE + 1)
        last = np.minimum(first + size, ends[which])
        order = np.argsort(first - last, kind="stable")
        return first[order], last[order]

    def scan(self, words: Words) -> tuple[list[tuple[int, int]], dict[int, set[str]]]:
        """(first, last + 1) of hit words of a slice, in order and disjoint; row -> its items."""
        items: dict[int, set[str]] = {}
        if not len(self.vocabulary) or not len(words):
            return [], items
        h = words.hash
        code = np.searchsorted(self.vocabulary, h)
        first, last = self._pieces(words, self.vocabulary[np.minimum(code, len(self.vocabulary) - 1)] == h)
        size = last - first
        state, length = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []  # last words of windows, anchors
        short: list[tuple[int, int]] = []
        for t in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -t, "left"))
            at = first[:n] + t
            open_ = np.arange(n)
            while len(open_):
                key = (state[open_] << 32) | code[at[open_]]
                k = np.searchsorted(self.keys, key)
                ok = self.keys[np.minimum(k, len(self.keys) - 1)] == key
                done, open_ = open_[ok], open_[~ok]
                state[done] = self.to[k[ok]]
                length[done] += 1
                state[open_] = self.link[state[open_]]  # a known word goes on from the root at the latest
                length[open_] = self.length[state[open_]]
                # a state that was reached is not looked at again
            hit = np.flatnonzero(length[:n] >= self.window)
            if len(hit):
                found.append((at[hit], self.anchor[state[hit]]))
            for lane in np.flatnonzero(self.has_short[state[:n]]).tolist():
                short.append((int(at[lane]), lane))
                for m, ids in self.short[int(state[lane])]:
                    if m <= length[lane]:
                        items.setdefault(int(words.doc[at[lane]]), set()).update(ids)
                        found.append((np.array([at[lane]]), np.array([-m])))
        if not found:
            return [], items
        end, anchor = (np.concatenate(x) for x in zip(*found, strict=True))
        full = anchor >= 0
        for row, v in set(zip(words.doc[end[full]].tolist(), anchor[full].tolist(), strict=True)):
            items.setdefault(row, set()).update(self.items[v])
        return _cover(end + 1 - np.where(full, self.window, -anchor), end + 1), items


def _cover(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint spans, in order, that cover the given ones; those that touch are one."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > ends[:-1]]))
    return list(zip(starts[new].tolist(), ends[np.append(new[1:], len(starts)) - 1].tolist(), strict=True))


def automata(benchmark: DataFrame, window: int, block_bytes: int = BLOCK_BYTES) -> list[str]:
    """Build the blocks' automata; their files in the shared folder."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    texts = cut(items.groupBy("text").agg(F.collect_set("item_id").alias("ids")))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    folder = f"{shared_dir(benchmark.sparkSession)}/automata-{uuid.uuid4().hex}"

    def build(group: pa.Table) -> pa.Table:
        found: list[tuple[list[str], np.ndarray]] = []
        ids = group.column("ids").to_pylist()
        for lo, hi, words in word_slices(group.column("text").combine_chunks(), ALNUM, lower=True):
            found += [(ids[k], words.hash[words.first[k - lo] : words.first[k - lo + 1]]) for k in range(lo, hi)]
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.npz"  # of a task that runs again, the committed attempt's file is named
        with store.open_output_stream(f"{root}/{name}", compression=None) as out:
            out.write(Builder(found, window).packed())
        return pa.table({"name": [name]})

    placed = texts.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(max(1, blocks))))
    names = cut(placed.groupBy("block").applyInArrow(build, "name string"))
    return [f"{folder}/{r.name}" for r in names.orderBy("name").collect()]  # a row for each block


_held: dict[str, Automaton] = {}


def _load(path: str, window: int) -> Automaton:
    """A block's automaton; a worker keeps the last one."""
    if path not in _held:
        _held.clear()
        store, where = fs.FileSystem.from_uri(path)
        with store.open_input_stream(where, compression=None) as file:
            _held[path] = Automaton(file.read(), window)
    return _held[path]


def _by_row(words: Words, spans: list[tuple[int, int]]) -> dict[int, list[tuple[int, int]]]:
    """Row -> its spans of hit words; a merged span that runs over rows is cut at them."""
    out: dict[int, list[tuple[int, int]]] = {}
    for a, b in spans:
        while a < b:
            row = int(words.doc[a])
            to = min(b, int(words.first[row + 1]))
            out.setdefault(row, []).append((a, to))
            a = to
    return out


def _places(words: Words, row: int, spans: list[tuple[int, int]]) -> list[dict]:
    """A row's spans as its own words [first, last) and code points [start, end)."""
    text, o = words.data[words.offsets[row] : words.offsets[row + 1]], words.offsets[row]
    points = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
    first = int(words.first[row])
    return [{"first": s - first, "last": e - first, "start": int(points[words.starts[s] - o]), "end": int(points[words.ends[e - 1] - o])} for s, e in spans]


def _merged(spans: list[dict]) -> list[dict]:
    """Spans of words as disjoint ones, in order."""
    out: list[dict] = []
    for x in sorted(spans, key=lambda x: (x["first"], x["last"])):
        if out and x["first"] <= out[-1]["last"]:
            if x["last"] > out[-1]["last"]:
                out[-1] |= {"last": x["last"], "end": x["end"]}
        else:
            out.append(dict(x))
    return out


#: What becomes of a slice's rows, given their spans and numbers of words.
Then = Callable[[pa.RecordBatch, pa.Array, pa.Array], pa.RecordBatch]


def _slices(docs: DataFrame, names: list[str], found: Callable[[Words, pa.RecordBatch], tuple[list, list]], then: Then | None) -> DataFrame:
    """The documents with the spans, items and numbers of words that ``found`` gives, or what ``then`` makes of them."""
    spans_at, items_at, words_at = names
    own = [c for c in docs.columns if c not in names]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = {f.name: f.type for f in batch.schema}
            for lo, hi, w in word_slices(batch.column("text"), ALNUM, lower=True):
                part = batch.slice(lo, hi - lo)
                spans, items = found(w, part)
                spans, words = pa.array(spans, kinds[spans_at]), pa.array(w.counts, pa.int64())
                if then:
                    yield then(part.select(own), spans, words)
                else:
                    new = {spans_at: spans, items_at: pa.array(items, kinds[items_at]), words_at: words}
                    yield pa.RecordBatch.from_arrays([new[c] if c in new else part.column(c) for c in kinds], schema=batch.schema)

    return docs.mapInArrow(scan, docs.select(own).schema if then else docs.schema)


def _scanned(docs: DataFrame, path: str, window: int, names: list[str], then: Then | None = None) -> DataFrame:
    """The documents with what a block hits."""

    def found(w: Words, part: pa.RecordBatch) -> tuple[list, list]:
        covered, items = _load(path, window).scan(w)
        spans: list = [[]] * part.num_rows
        which: list = [[]] * part.num_rows
        for row, own in _by_row(w, covered).items():
            spans[row], which[row] = _places(w, row, own), sorted(items.get(row, ()))
        return spans, which

    return _slices(docs, names, found, then)


def spanned(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int = BLOCK_BYTES, then: Then | None = None) -> tuple[DataFrame, list[str]]:
    """The documents with three more columns, and their names: spans of hit words, items hit, number of words.

    A span has the words [first, last) and the code points [start, end). With
    ``then``, what it makes of each slice of documents instead.
    """
    names = unused(docs, "spans", "items", "words")
    spans_at, items_at, words_at = names
    empty = {spans_at: F.array().cast(SPANS), items_at: F.array().cast("array<string>"), words_at: F.lit(0).cast("long")}
    blocks = automata(benchmark, window, block_bytes)
    if len(blocks) == 1:
        return _scanned(docs.withColumns(empty), blocks[0], window, names, then), names
    (row,) = unused(docs, "row")
    rows = cut(docs.withColumn(row, F.monotonically_increasing_id())) if blocks else docs.withColumns(empty)
    if blocks:
        texts = rows.select(row, "text").withColumns(empty)
        hits = [_scanned(texts, path, window, names).where(F.size(spans_at) > 0).select(row, spans_at, items_at) for path in blocks]
        together = reduce(DataFrame.unionByName, hits).groupBy(row).agg(F.flatten(F.collect_list(spans_at)).alias(spans_at), F.array_sort(F.array_distinct(F.flatten(F.collect_list(items_at)))).alias(items_at))
        rows = rows.join(together, row, "left").select(*docs.columns, *(F.coalesce(c, empty[c]).alias(c) for c in (spans_at, items_at)), empty[words_at].alias(words_at))

    def found(w: Words, part: pa.RecordBatch) -> tuple[list, list]:
        return [_merged(x) for x in part.column(spans_at).to_pylist()], part.column(items_at).to_pylist()

    return _slices(rows, names, found, then), names


def mark(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids), spans of hit words, of each document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out, (spans, items, words) = spanned(texts, benchmark, window, block_bytes)
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"])
    return out.select("doc_id", F.col(words).alias("n_words"), hit.alias("n_hit"), F.col(items).alias("items"), F.col(spans).alias("spans"))


def remove(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without benchmark passages; all columns stay.

    Hit spans are cut out of the text, each leaving one newline; a document of
    whose words more than ``max_coverage`` are hit is dropped. All blocks of the
    benchmark look at the original text, and their spans count and are cut out
    together. Documents without a hit, also empty ones, are returned as they
    are. ``n_chars``, if there, is the new text's length.
    """

    def trimmed(batch: pa.RecordBatch, spans: pa.Array, n_words: pa.Array) -> pa.RecordBatch:
        rows = np.flatnonzero(np.asarray(pc.list_value_length(spans))).tolist()
        if not rows:
            return batch
        columns, keep = batch.columns, np.ones(len(batch), bool)
        at, size = batch.schema.get_field_index("text"), batch.schema.get_field_index("n_chars")
        texts, lengths = columns[at].to_pylist(), columns[size].to_pylist() if size >= 0 else []
        for row in rows:
            pieces, last, hit = [], 0, 0
            for x in spans[row].as_py():
                pieces.append(texts[row][last : x["start"]])
                last = x["end"]
                hit += x["last"] - x["first"]
            keep[row] = hit <= max_coverage * n_words[row].as_py()
            texts[row] = "\n".join([*pieces, texts[row][last:]])
            if size >= 0:
                lengths[row] = len(texts[row])
        columns[at] = pa.array(texts, batch.schema.field(at).type)
        if size >= 0:
            columns[size] = pa.array(lengths, batch.schema.field(size).type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep))

    return spanned(docs, benchmark, window, block_bytes, trimmed)[0]


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: its words, those hit, the items hit."""
    found = mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k)),
hits AS (SELECT doc_id, dw.k AS k, i, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM (SELECT DISTINCT doc_id, k, i FROM hits)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id AS doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""

"""Quality rules: countable base rules and an n-gram log-likelihood ratio.

Words and word pairs are hashed into ``BUCKETS`` counters. The raw multinomial
counts every document of the corpus; the trusted one counts documents labelled
as good (quality 1, not toxic) from a sample of at most ``FIT_ROWS`` labelled
rows. A document's score is the mean, over its n-grams, of the log of the ratio
of both probabilities (add-one smoothed), so it does not depend on its length.
The threshold is fixed on labelled rows that the trusted counts have not seen,
and then applied to every document.

Defined results: a null or empty text has no words and fails the base rules;
without labels (or without trusted ones) the method keeps all that passes the
base rules; repeated documents each get their row; a repeated label row counts
by its worst values. Columns other than those named are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm.common import hashed_sample, table
from almanac.llm.textops import SPACED, Words, hash_windows, word_slices

#: Counters of the hashed multinomials: what is sent to the driver is bounded by it.
BUCKETS = 1 << 16
#: Most labelled rows that the trusted multinomial and the threshold are fitted on.
FIT_ROWS = 8000
#: Base rules.
MIN_WORDS = 50
MAX_REPEATED = 0.5

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True

FEATURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"


def _ngrams(words: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of each word and each pair of neighbouring words of a row."""
    pairs = hash_windows(h, 2)
    inside = words.doc[1:] == words.doc[:-1]
    found = np.concatenate([h, pairs[inside]])
    return (found % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([words.doc, words.doc[1:][inside]])


def _repeated(key: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Whether each entry's (key, row) is there twice or more; and, below, the later ones."""
    order = np.lexsort((key, row))
    k, r = key[order], row[order]
    same = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _features(w: Words, h: np.ndarray) -> dict[str, np.ndarray]:
    rows = len(w.offsets) - 1
    per_row = lambda flags: np.add.reduceat(np.append(flags, 0), w.offsets[:-1]) * (np.diff(w.offsets) > 0) if rows else np.zeros(0, np.int64)
    point = ((w.data & 0xC0) != 0x80).astype(np.int64)
    # windows of three words of one row
    three = hash_windows(h, 3)
    inside = np.flatnonzero(w.doc[2:] == w.doc[:-2]) if len(three) else np.zeros(0, np.int64)
    twice = inside[_repeated(three[inside], w.doc[inside])]
    covered = np.zeros(len(h), bool)
    for k in range(3):
        covered[twice + k] = True
    # lines with a word
    newline = np.flatnonzero(w.data == 0x0A)
    begin = np.unique(np.concatenate([w.offsets[:-1], newline + 1]))
    begin = begin[begin < len(w.data)]
    line_end = np.minimum(np.append(newline, len(w.data))[np.searchsorted(newline, begin)], w.offsets[np.searchsorted(w.offsets, begin, "right").clip(max=rows)])
    has_word = np.searchsorted(w.starts, line_end) > np.searchsorted(w.starts, begin)
    begin, line_end = begin[has_word], line_end[has_word]
    line_row = np.searchsorted(w.offsets, begin, "right") - 1
    key = w.span_hash(begin, line_end)
    order = np.lexsort((begin, key, line_row))
    later = np.zeros(len(key), np.int64)
    later[order[1:]] = (key[order][1:] == key[order][:-1]) & (line_row[order][1:] == line_row[order][:-1])
    return {
        "n_words": w.counts,
        "word_chars": per_row(point * w.member),
        "n_symbols": per_row(_SYMBOLS[w.data].astype(np.int64)),
        "n_dup_lines": np.bincount(line_row, later, rows).astype(np.int64),
        "n_repeat_words": np.bincount(w.doc, covered, rows).astype(np.int64),
    }


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's n-gram counts: over all rows, and over those with ``trusted``."""
    raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        trusted = batch.column("trusted").to_numpy(zero_copy_only=False).astype(bool)
        for lo, hi, w in word_slices(batch.column("text"), SPACED):
            bucket, row = _ngrams(w, w.hash)
            raw += np.bincount(bucket, minlength=BUCKETS)
            if trusted[lo:hi].any():
                good += np.bincount(bucket[trusted[lo:hi][row]], minlength=BUCKETS)
    used = np.flatnonzero(raw)
    yield pa.RecordBatch.from_pydict({"bucket": used, "n_raw": raw[used], "n_good": good[used]}, schema=pa.schema([("bucket", pa.int64()), ("n_raw", pa.int64()), ("n_good", pa.int64())]))


def measure(docs: DataFrame, ratio: np.ndarray | None) -> DataFrame:
    """The base features and the score (0 without a ratio) of every document."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, w in word_slices(batch.column("text"), SPACED):
                h = w.hash
                score = np.zeros(hi - lo)
                if ratio is not None:
                    bucket, row = _ngrams(w, h)
                    n = np.bincount(row, minlength=hi - lo)
                    score = np.bincount(row, ratio[bucket], hi - lo) / np.maximum(n, 1)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(lo, hi - lo), **_features(w, h), "score": score}, schema=pa.schema([("doc_id", pa.int64()), *((x, pa.int64()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("score", pa.float64())]))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(measured, FEATURES)


def threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """The score from which on a document is kept.

    Of the cuts between labelled scores, the one that gets the largest sum of
    kept good and rejected bad shares, a lost good row weighing ten bad ones;
    half way between its neighbours. Without bad rows nothing is rejected.
    """
    if not len(good) or not len(bad):
        return -np.inf
    scores = np.unique(np.concatenate([good, bad]))
    cuts = np.concatenate([[-np.inf], (scores[1:] + scores[:-1]) / 2])
    lost = np.searchsorted(np.sort(good), cuts) / len(good)
    caught = np.searchsorted(np.sort(bad), cuts) / len(bad)
    return float(cuts[np.argmax(caught - 10 * lost)])


class Model:
    """The log ratio of each bucket and the threshold."""

    def __init__(self, ratio: np.ndarray | None, cut: float):
        self.ratio, self.cut = ratio, cut


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Counts over all documents, trusted counts and threshold from the labelled sample."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") == 1).alias("good"), F.coalesce(F.max("toxic"), F.lit(0)).alias("toxic"))
    sample = hashed_sample(known, F.col("doc_id"), fit_rows, known.count()).select("doc_id", (F.col("good") & (F.col("toxic") == 0)).alias("good"), (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0).alias("seen"), "toxic")
    sample = F.broadcast(docs.sparkSession.createDataFrame(sample.collect(), sample.schema))  # at most fit_rows rows
    counts = (
        docs.join(sample, "doc_id", "left")
        .select("text", F.coalesce(F.col("good") & F.col("seen"), F.lit(False)).alias("trusted"))
        .mapInArrow(_counted, "bucket long, n_raw long, n_good long")
        .groupBy("bucket")
        .agg(F.sum("n_raw").alias("n_raw"), F.sum("n_good").alias("n_good"))
        .toPandas()  # a row for each bucket at most
    )
    raw, good = np.ones(BUCKETS), np.ones(BUCKETS)
    raw[counts.bucket] += counts.n_raw
    good[counts.bucket] += counts.n_good
    if not counts.n_good.sum():
        return Model(None, -np.inf)
    ratio = np.log(good / good.sum()) - np.log(raw / raw.sum())
    held = measure(docs.join(sample.where("not seen"), "doc_id", "left_semi"), ratio).where(f"n_words >= {MIN_WORDS}").select("doc_id", "score")
    scored = held.join(sample.where("toxic = 0"), "doc_id").select("good", "score").toPandas()  # at most fit_rows rows
    return Model(ratio, threshold(scored.score[scored.good].to_numpy(), scored.score[~scored.good].to_numpy()))


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """The features, ``base_failed`` and the verdict ``kept`` of every document."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 100 * MAX_REPEATED * F.col("n_words"))
    return measure(docs, model.ratio).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(model.cut)))


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that pass, with all their columns; the text is not shuffled."""

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, w in word_slices(batch.column("text"), SPACED):
                h = w.hash
                f = _features(w, h)
                good = (f["n_words"] >= MIN_WORDS) & (f["n_repeat_words"] <= MAX_REPEATED * f["n_words"])
                if model.ratio is not None:
                    bucket, row = _ngrams(w, h)
                    good &= np.bincount(row, model.ratio[bucket], hi - lo) / np.maximum(np.bincount(row, minlength=hi - lo), 1) >= model.cut
                yield batch.slice(lo, hi - lo).filter(pa.array(good))

    return docs.mapInArrow(passed, docs.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))

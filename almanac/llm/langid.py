"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read a word's bytes (A-Z lower-cased, the two
boundary bytes included) forwards and backwards; at each position both states
give the position's language probabilities. The states start anew at each word,
so a word's positions are labelled once for all its occurrences in a slice. A
document's probabilities pool those of all its positions (the geometric mean).
The network is trained in numpy by back-propagation through time.

Training reads a sample of at most ``FIT_DOCS`` documents a language, out of
those that are not held out and have a language; everything else runs over all
documents and whole texts. Of the sample's words, about ``MAX_WORDS`` are
trained on: the languages share them alike (what one does not need goes to the
others), each takes its most frequent words, and among words of its last count
a share of their hashes. So each language with words in its sample is in the
model.

Defined results: a null text, or one without letters, is ``und`` with score 0;
without training documents every document is ``und``; repeated documents each
get their row; lang, source and doc_id are no inputs of a prediction.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm.common import cut, table
from almanac.llm.textops import SPACED, Words, word_slices

#: Most training documents of a language; most languages.
FIT_DOCS = 300
MAX_LANGS = 200
#: About so many (word, language) rows of the sample are trained on, shared out by language.
MAX_WORDS = 60_000
#: Bytes of a word that the network reads at a time; longer words are cut into such pieces.
PIECE = 24
#: Bytes of text whose distinct words are scored together.
TOGETHER = 4 << 20
HIDDEN = 10
EMBED = 12
STEPS = 700
BATCH = 384


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + np.float32(0.5)


class Network:
    """Parameters and passes. Inputs are (time, batch) byte numbers, 0 = outside."""

    def __init__(self, langs: list[str], seed: int = 11):
        self.langs = langs
        rng = np.random.default_rng(seed)
        init = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"E": init(257, EMBED), "O": init(2 * HIDDEN, len(langs)), "o": np.zeros(len(langs), np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": init(EMBED, 3 * HIDDEN), f"U{d}": init(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}

    def _run(self, x: np.ndarray, inside: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """The states after each position; outside a word the state stays."""
        H, U = HIDDEN, self.p[f"U{d}"]
        gate_in = (self.p["E"] @ self.p[f"W{d}"] + self.p[f"c{d}"])[x]
        h = np.zeros((x.shape[1], H), np.float32)
        out, memo = np.zeros((*x.shape, H), np.float32), []
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            zr = _sigmoid(gate_in[t][:, : 2 * H] + h @ U[:, : 2 * H])
            z, r = zr[:, :H], zr[:, H:]
            n = np.tanh(gate_in[t][:, 2 * H :] + (r * h) @ U[:, 2 * H :])
            m = inside[t][:, None]
            new = h + m * z * (n - h)
            if keep:
                memo.append((t, h, z, r, n, m))
            out[t] = h = new
        return out, memo

    def logits(self, x: np.ndarray, keep: bool = False):
        inside = (x > 0).astype(np.float32)
        f, mf = self._run(x, inside, "f", keep)
        b, mb = self._run(x, inside, "b", keep)
        both = np.concatenate([f, b], axis=2)
        y = both @ self.p["O"] + self.p["o"]
        y -= y.max(axis=2, keepdims=True)
        y -= np.log(np.exp(y).sum(axis=2, keepdims=True))
        return y, inside, both, (mf, mb)

    def gradients(self, x: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
        """Loss of the positions' labels against truth (batch, langs), and its gradients."""
        y, inside, both, memos = self.logits(x, keep=True)
        w = (inside * weight)[:, :, None]
        w = w / w.sum()
        loss = float(-(w * truth * y).sum())
        dy = w * (np.exp(y) - truth)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["O"] = np.einsum("tbh,tbl->hl", both, dy)
        g["o"] = dy.sum((0, 1))
        dboth = dy @ self.p["O"].T
        H = HIDDEN
        for d, memo, part in (("f", memos[0], dboth[:, :, :H]), ("b", memos[1], dboth[:, :, H:])):
            U, W = self.p[f"U{d}"], self.p[f"W{d}"]
            dh = np.zeros((x.shape[1], H), np.float32)
            for t, h, z, r, n, m in reversed(memo):
                dh = dh + part[t]
                dz = dh * m * (n - h) * z * (1 - z)
                dn = dh * m * z * (1 - n * n)
                drh = dn @ U[:, 2 * H :].T
                dr = drh * h * r * (1 - r)
                dgate = np.concatenate([dz, dr, dn], axis=1)
                g[f"U{d}"][:, : 2 * H] += h.T @ dgate[:, : 2 * H]
                g[f"U{d}"][:, 2 * H :] += (r * h).T @ dn
                dh = dh * (1 - m * z) + drh * r + dgate[:, : 2 * H] @ U[:, : 2 * H].T
                g[f"c{d}"] += dgate.sum(0)
                e = self.p["E"][x[t]]
                g[f"W{d}"] += e.T @ dgate
                np.add.at(g["E"], x[t], dgate @ W.T)
        return loss, g

    def train(self, words: list[bytes], truth: np.ndarray, weight: np.ndarray, steps: int = STEPS, seed: int = 5) -> None:
        """Adam over random batches of distinct words, drawn by how often they occur."""
        rng = np.random.default_rng(seed)
        x, where = pieces(words)
        share = weight[where] / weight[where].sum()
        state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            pick = rng.choice(x.shape[1], min(BATCH, x.shape[1]), p=share)
            _, g = self.gradients(x[: max(2, int((x[:, pick] > 0).sum(0).max())), pick], truth[where[pick]], np.ones(len(pick), np.float32))
            rate = 0.02 * min(1, 2 * (1 - step / (steps + 1)))
            for k, v in g.items():
                a, b = state[k]
                a *= 0.9
                a += 0.1 * v
                b *= 0.99
                b += 0.01 * v * v
                self.p[k] -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)

    def word_scores(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Sums of each word's positions' log probabilities, and its number of positions."""
        x, where = pieces(words)
        sums = np.zeros((len(words), len(self.langs)))
        size = np.zeros(len(words))
        length = (x > 0).sum(0)
        order = np.argsort(length, kind="stable")
        for lo in range(0, len(order), 4096):
            pick = order[lo : lo + 4096]
            part = x[: length[pick].max(), pick]
            y, inside, _, _ = self.logits(part)
            np.add.at(sums, where[pick], (y * inside[:, :, None]).sum(0))
            np.add.at(size, where[pick], inside.sum(0))
        return sums, size


def pieces(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(PIECE, pieces) byte numbers from 1 on, 0 outside; the word of each piece."""
    parts: list[bytes] = []
    where: list[int] = []
    for k, word in enumerate(words):
        word = b" " + word + b" "
        for lo in range(0, len(word), PIECE):
            parts.append(word[lo : lo + PIECE])
            where.append(k)
    x = np.frombuffer(b"".join(p.ljust(PIECE, b"\0") for p in parts), np.uint8).reshape(-1, PIECE).astype(np.int32)
    length = np.array([len(p) for p in parts])
    x = np.where(np.arange(PIECE)[None, :] < length[:, None], x + 1, 0)
    return np.ascontiguousarray(x.T), np.array(where, np.int64)


def _distinct(w: Words) -> tuple[list[bytes], np.ndarray]:
    """A slice's distinct words, and each word's number among them."""
    _, first, which = np.unique(w.hash, return_index=True, return_inverse=True)
    raw = w.data.tobytes()
    return [raw[a:b] for a, b in zip(w.starts[first].tolist(), w.ends[first].tolist(), strict=True)], which


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def shares(sizes: dict[str, int], total: int) -> dict[str, int]:
    """The total dealt out evenly, to each as much as its size at most and one at least."""
    out: dict[str, int] = {}
    for k, (name, size) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        out[name] = min(size, max(1, (total - sum(out.values())) // (len(sizes) - k)))
    return out


def _frequent(counted: DataFrame, max_words: int) -> list:
    """Rows (word, lang, n): the most frequent of each language, about max_words in all."""
    kinds = counted.groupBy("lang", "n").agg(F.count("*").alias("rows")).collect()  # the different counts of a bounded sample
    sizes = Counter()
    for r in kinds:
        sizes[r.lang] += r.rows
    wanted, last = shares(sizes, max_words), {}
    for r in sorted(kinds, key=lambda r: -r.n):
        if r.lang not in last and wanted[r.lang] <= r.rows:
            last[r.lang] = (r.n, -(-wanted[r.lang] * (1 << 30) // r.rows))
        wanted[r.lang] -= r.rows
    if not last:
        return []
    least = lambda k: F.element_at(F.create_map(*(F.lit(x) for lang, v in last.items() for x in (lang, v[k]))), F.col("lang"))
    order = F.pmod(F.xxhash64("word"), F.lit(1 << 30))
    return counted.where((F.col("n") > least(0)) | ((F.col("n") == least(0)) & (order < least(1)))).collect()


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS, max_words: int = MAX_WORDS) -> Network | None:
    """The network, trained on a bounded sample of each language's documents and words."""
    seen = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(F.coalesce(~held_out(), F.lit(False)))
    counts = {r.lang: r.n for r in seen.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(MAX_LANGS + 1).collect()}
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not counts:
        return None
    # a share of each language's hashes, so that about the wanted number is left of any number of documents
    share = F.element_at(F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, (1.5 * fit_docs + 50) / n) * (1 << 30)) + 1))), F.col("lang"))
    order = F.xxhash64("doc_id")
    rows = seen.where(F.pmod(order, F.lit(1 << 30)) < share).select("doc_id", "lang", order.alias("order")).distinct().orderBy("order", "doc_id").limit(3 * MAX_LANGS * fit_docs).collect()  # bounded
    chosen, taken = [], Counter()
    for r in rows:
        taken[r.lang] += 1
        if taken[r.lang] <= fit_docs:
            chosen.append(r)
    spark = docs.sparkSession
    sample = seen.join(F.broadcast(spark.createDataFrame([(r.doc_id,) for r in chosen], "doc_id long").distinct()), "doc_id", "left_semi")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A document's distinct words with counts; punctuation stays part of them."""
        for batch in batches:
            lang = batch.column("lang").to_pylist()
            for lo, hi, w in word_slices(batch.column("text"), SPACED, lower=True):
                words, which = _distinct(w)
                number = {x: k for k, x in enumerate(sorted(set(lang[lo:hi])))}
                code = np.array([number[x] for x in lang[lo:hi]], np.int64)[w.doc] if len(w) else np.zeros(0, np.int64)
                pair, n = np.unique(which * len(number) + code, return_counts=True)
                names = list(number)
                yield pa.RecordBatch.from_pydict({"word": [words[p // len(names)] for p in pair.tolist()], "lang": [names[p % len(names)] for p in pair.tolist()], "n": n}, schema=pa.schema([("word", pa.binary()), ("lang", pa.string()), ("n", pa.int64())]))

    rows = _frequent(cut(sample.select("lang", "text").mapInArrow(counted, "word binary, lang string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))), max_words)
    langs = sorted({r.lang for r in rows})
    if not rows:
        return None
    total = Counter()
    for r in rows:
        total[r.lang] += r.n
    words = sorted({bytes(r.word) for r in rows})
    number, lang = {w: k for k, w in enumerate(words)}, {x: k for k, x in enumerate(langs)}
    share = np.zeros((len(words), len(langs)), np.float32)
    for r in rows:
        share[number[bytes(r.word)], lang[r.lang]] += r.n / total[r.lang]  # every language weighs alike
    net = Network(langs)
    weight = share.sum(1)
    net.train(words, share / weight[:, None], np.sqrt(weight))
    return net


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(held_out(), F.lit(False)).alias("held_out"))

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            letters = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            for lo, hi, w in word_slices(column, SPACED, lower=True, limit=TOGETHER):
                name, score = np.full(hi - lo, "und", object), np.zeros(hi - lo)
                if net is not None and len(w):
                    words, which = _distinct(w)
                    sums, size = net.word_scores(words)
                    pooled = np.stack([np.bincount(w.doc, s[which], hi - lo) for s in sums.T], axis=1)
                    pooled /= np.maximum(np.bincount(w.doc, size[which], hi - lo), 1)[:, None]
                    p = np.exp(pooled - pooled.max(axis=1, keepdims=True))
                    p /= p.sum(axis=1, keepdims=True)
                    known = letters[lo:hi]
                    name[known] = np.array(net.langs, object)[p.argmax(1)][known]
                    score[known] = p.max(1)[known]
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(lo, hi - lo), "held_out": batch.column("held_out").slice(lo, hi - lo), "lang_pred": name, "score": score}, schema=pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())]))

    return rows.mapInArrow(predicted, "doc_id long, held_out boolean, lang_pred string, score double")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))

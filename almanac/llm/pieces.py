"""SentencePiece encoding with the source's byte spans, and decoding.

A text is normalised first: at each place the longest prefix that the model's
compiled character map knows is replaced (``CharMap``), and beside every
normalised byte stands the source byte it came from. Spaces are then escaped and
the dummy prefix added by the same record, so a piece, which is a run of
normalised bytes, is projected to ``[start, end)`` in the source's UTF-8.

Merging is local: two characters can only come together if some piece holds
them side by side. A text is therefore worked on in chunks of about ``CHUNK``
characters, each cut at the first pair after that which no piece holds (before
a space, mostly), and a chunk's merges are those of the whole text. They are the
library's, on a copy of the model whose normaliser is empty. Beside the text
itself a task holds a chunk's arrays, whatever the text's length; only a run in
which every pair is in some piece is merged whole. All is one map over the rows:
nothing is shuffled, and a lost executor costs its tasks.

Defined results: a null text is an empty one, which has no pieces; every row
gives a row, in any number of copies; other columns are not looked at. A piece
of byte fallback spans its one source byte where its character was not replaced
(the library gives the whole character to the last of them); the dummy prefix
spans nothing. Models without byte fallback or with space marks as suffixes are refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as messages

from almanac.llm.common import table, unused

MODEL = "piece_bpe_32k.model"
#: Characters of a text that are worked on at a time.
CHUNK = 1 << 16

MARK = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


class CharMap:
    """A compiled character map: a double array of byte prefixes and the replacements they point to.

    The map is a little-endian count of the array's bytes, the array of 32-bit
    units, and the replacements, each ended by a zero byte.
    """

    def __init__(self, compiled: bytes):
        size = int.from_bytes(compiled[:4], "little")
        self.units = np.frombuffer(compiled[4 : 4 + size], "<u4").tolist()
        self.texts = compiled[4 + size :]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(length of the longest known prefix at a place, its replacement)."""
        if not self.units:
            return None
        found, node = None, self._offset(self.units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            unit = self.units[node] if node < len(self.units) else 0
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            if unit & 0x100:
                value = self.units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.texts[value : self.texts.index(b"\0", value)]
        return found

    def starts(self) -> np.ndarray:
        """Whether a known prefix may start with each byte."""
        root = self._offset(self.units[0]) if self.units else 0
        return np.array([root ^ b < len(self.units) and self.units[root ^ b] & 0x800000FF == b for b in range(256)])

    def apply(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """(normalised bytes, the source place of each and the source's end)."""
        raw = np.frombuffer(data, np.uint8)
        out, places, done = [], [], 0
        for at in np.flatnonzero(self.starts()[raw] & (raw & 0xC0 != 0x80)).tolist() if len(raw) else []:
            if at < done:
                continue
            if found := self.longest(data, at):
                length, text = found
                out += [data[done:at], text]
                places += [np.arange(done, at), np.full(len(text), at)]
                done = at + length
        return b"".join([*out, data[done:]]), np.concatenate([*places, np.arange(done, len(data) + 1)])


def normalised(text: str, spec: messages.NormalizerSpec) -> tuple[str, np.ndarray, int]:
    """(the text by the map, its spaces still spaces; the source byte of each normalised byte, and the end; that of the prefix)."""
    data = text.encode()
    table_ = CharMap(spec.precompiled_charsmap)
    normal, place = table_.apply(data)
    if not spec.remove_extra_whitespaces:
        return normal.decode(), place, 0
    lead = 0
    while lead < len(data):
        length, shown = table_.longest(data, lead) or (1, data[lead : lead + 1])
        if shown != b" ":
            break
        lead += length
    raw = np.frombuffer(normal, np.uint8)
    space = raw == 0x20
    kept = ~(space & np.append(True, space[:-1])) if len(raw) else space  # not the leading ones, nor those after the first of a run
    last = len(normal)
    while last and normal.endswith((b" ", MARK.encode()), 0, last):  # a mark at the end goes like a space
        last -= 1 if normal[last - 1] == 0x20 else 3
    kept[last:] = False
    return raw[kept].tobytes().decode(), np.append(place[:-1][kept], place[last]), lead


class Encoder:
    """A model: its merges, and what its pieces stand for."""

    def __init__(self, serialized: bytes):
        model = messages.ModelProto.FromString(serialized)
        self.spec, pieces = model.normalizer_spec, model.pieces
        if not model.trainer_spec.byte_fallback or model.trainer_spec.treat_whitespace_as_suffix or not self.spec.escape_whitespaces:
            raise ValueError("only models with byte fallback and space marks as prefixes")
        self.pairs = {p.piece[i : i + 2] for p in pieces for i in range(len(p.piece) - 1)}
        bare = messages.ModelProto.FromString(serialized)
        bare.normalizer_spec.CopyFrom(messages.NormalizerSpec(name="identity", add_dummy_prefix=False, remove_extra_whitespaces=False, escape_whitespaces=False))
        self.merges = sentencepiece.SentencePieceProcessor(model_proto=bare.SerializeToString())
        self.decimal = laid_out([b",%d" % i for i in range(len(pieces))])
        self.byte = np.array([p.type == _BYTE for p in pieces])
        self.silent = np.array([p.type == _CONTROL for p in pieces])
        self.unknown = next(i for i, p in enumerate(pieces) if p.type == _UNKNOWN)
        unknown = model.trainer_spec.unk_surface
        shown = [bytes([int(p.piece[3:5], 16)]) if p.type == _BYTE else b"" if p.type == _CONTROL else unknown.encode() if p.type == _UNKNOWN else p.piece.replace(MARK, " ").encode() for p in pieces]
        self.surface, self.shown = shown, laid_out(shown)
        self.marked = [p.type == _NORMAL and p.piece.startswith(MARK) for p in pieces]
        self.length = np.array([1 if p.type == _BYTE else len(p.piece.encode()) for p in pieces])

    def chunks(self, text: str) -> Iterator[tuple[str, bool]]:
        """(part, whether it is the first) of a text, cut where no piece can reach across."""
        at = 0
        while at < len(text):
            to = at + CHUNK
            while to < len(text) and text[to - 1 : to + 1].replace(" ", MARK) in self.pairs:
                to += 1
            yield text[at:to], at == 0
            at = to

    def encode(self, text: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, starts, ends) of a text, chunk by chunk; starts and ends are bytes of the source."""
        plain, place, lead, base = text, None, 0, 0
        if self.spec.precompiled_charsmap or self.spec.remove_extra_whitespaces:
            plain, place, lead = normalised(text, self.spec)
        bare = text and not plain and self.spec.add_dummy_prefix and not self.spec.remove_extra_whitespaces
        for part, first in [("", True)] if bare else self.chunks(plain):
            raw = np.frombuffer(part.encode(), np.uint8)
            width = np.where(raw == 0x20, 3, 1)  # a space's mark has three bytes
            prefix = 3 * (first and self.spec.add_dummy_prefix)
            source = np.append(np.repeat(np.arange(len(raw)), width), len(raw)) + base
            if place is not None:
                source = place[source]
            source = np.append(np.full(prefix, lead), source)
            ids = np.array(self.merges.encode(MARK * bool(prefix) + part.replace(" ", MARK)), np.int32)
            end = np.cumsum(self.length[ids])
            yield ids, source[end - self.length[ids]], source[end]
            base += len(raw)

    def decoder(self) -> Decoder:
        return Decoder(self)


def laid_out(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(all rows' bytes, the place where each begins and the end)."""
    return np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)])


def gathered(flat: np.ndarray, first: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The entries of the given rows, one row after the other."""
    begin = first[rows]
    size = first[rows + 1] - begin
    ends = np.cumsum(size)
    return flat[np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


class Decoder:
    """The text of ids that come in several arrays; a run of byte pieces must not be parted between two of them."""

    def __init__(self, encoder: Encoder):
        self.e, self.begun = encoder, False

    def decode(self, ids: np.ndarray) -> bytes:
        e, out = self.e, []
        rest = ids
        strip = e.spec.add_dummy_prefix or e.spec.remove_extra_whitespaces
        while len(rest) and not self.begun:  # at a text's begin a space mark is dropped (all of them, if the model removes spaces)
            shown, i = e.surface[rest[0]], int(rest[0])
            dropped = strip and e.marked[i]
            if dropped:
                shown = shown[1:]
            if dropped and e.spec.remove_extra_whitespaces:
                self.begun = bool(shown)
            else:
                self.begun = dropped or bool(shown)
            if e.byte[i]:
                break  # with its run, below
            out.append(shown)
            rest = rest[1:]
        joined = gathered(*e.shown, rest).tobytes()
        if e.byte[rest].any():
            try:
                joined.decode()
                broken = e.silent[rest].any()  # shows nothing, but ends a run
            except UnicodeDecodeError:
                broken = True
            if broken:
                joined = self._by_runs(rest)
        return b"".join([*out, joined])

    def _by_runs(self, ids: np.ndarray) -> bytes:
        """Byte pieces are read as UTF-8 run by run, each byte that is no part of a character as U+FFFD."""
        out, run = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at : at + n]).decode().encode())
                        at += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�".encode())
                    at += 1
            run.clear()

        for i in ids.tolist():
            if self.e.byte[i]:
                run += self.e.surface[i]
            else:
                flush()
                out.append(self.e.surface[i])
        flush()
        return b"".join(out)


@lru_cache(maxsize=2)
def _encoder(serialized: bytes) -> Encoder:
    return Encoder(serialized)


def read_model(path: str) -> bytes:
    """A model's bytes, on the driver; executors get them with the tasks, so they need no such file."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes, text: str = "text", into: str = "pieces") -> DataFrame:
    """The rows with a column ``into``: an array of (id, start, end) for each text. A column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a vocabulary: of fixed size
    (own,) = unused(docs, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(shared.value)
        for batch in batches:
            at = batch.schema.names.index(own)
            rest = [i for i in range(batch.num_columns) if i != at]
            for k in range(batch.num_rows):
                found = list(e.encode(batch.column(at)[k].as_py() or "")) or [(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))]
                columns = [np.concatenate(c) for c in zip(*found, strict=True)]
                spans = pa.StructArray.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["id", "start", "end"])
                arrays = [batch.column(i).slice(k, 1) for i in rest] + [pa.ListArray.from_arrays(pa.array([0, len(spans)], pa.int32()), spans)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*(batch.schema.names[i] for i in rest), into])

    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != into.lower()], F.col(f"`{text}`").cast("string").alias(own))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != own), f"`{into}` array<struct<id: int, start: bigint, end: bigint>>"])
    return kept.mapInArrow(run, schema)


def digest(docs: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, bytes_spanned) of each text, from the pieces as they are made."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(shared.value)
        for batch in batches:
            counts, hashes, decoded, spanned = [], [], [], []
            for k in range(batch.num_rows):
                n, covered, ids_hash, text_hash, decoder = 0, 0, hashlib.sha256(), hashlib.sha256(), e.decoder()
                for ids, start, end in e.encode(batch.column("text")[k].as_py() or ""):
                    ids_hash.update(gathered(*e.decimal, ids)[0 if n else 1 :])
                    text_hash.update(decoder.decode(ids))
                    n += len(ids)
                    covered += int((end - start).sum())
                counts.append(n)
                hashes.append(ids_hash.hexdigest())
                decoded.append(text_hash.hexdigest())
                spanned.append(covered)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(hashes, pa.string()), "decoded_sha256": pa.array(decoded, pa.string()), "bytes_spanned": pa.array(spanned, pa.int64())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, bytes_spanned long")


def op12_pieces(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """Digests of every text's ids and of what they decode to; ``model`` is a model file's path."""
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path(MODEL)
    return digest(table(spark, sf_dir, "documents"), read_model(model))

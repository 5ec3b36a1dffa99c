"""Whitening, centroid clustering and pieces against plain versions."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as messages

from almanac.llm import centroids, pieces, whitening

public_tokenizers = pytest.importorskip("public_tokenizers")

ROWS = "vec_id long, embedding array<float>, label int, cluster string, n string"


def plain_vectors(rows, dims=None):
    good = [(i, [float(x) for x in v]) for i, v, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    return [(i, v) for i, v in good if dims is None or len(v) == dims]


def saved(spark, rows, where, schema=ROWS, name="embeddings"):
    spark.createDataFrame(rows, schema).write.parquet(f"{where}/{name}.parquet")
    return str(where)


def odd(n, dims, seed=0):
    r = np.random.default_rng(seed)
    rows = [(i, r.normal(size=dims).astype(np.float32).tolist(), 1, "c", None) for i in range(n)]
    rows += [(n, None, 1, None, None), (n + 1, [None] * dims, 1, None, None), (n + 2, [float("nan")] * dims, 1, None, None), (n + 3, [float("inf")] + [0.0] * (dims - 1), 1, None, None)]
    rows += [(None, [0.25] * dims, None, None, None), (3, rows[3][1], 1, None, None), (3, rows[4][1], 1, None, None), (n + 5, [-0.015625] * dims, 1, None, None)]
    return rows


# Whitening


@pytest.mark.parametrize("spread", [3, 2**30, 2**61])
def test_scatter_is_exact(spread):
    z = np.random.default_rng(1).integers(-spread, spread + 1, (131, 5))
    sums, products = whitening.scatter(z)
    big = z.astype(object)
    assert sums.tolist() == big.sum(axis=0).tolist()
    full = (big.T @ big).tolist()
    assert all(products[i, j] == full[i][j] for i in range(5) for j in range(i, 5))


def test_planes_hold_the_numbers():
    y = np.random.default_rng(2).integers(0, 1000, (70, 3)).astype(np.uint64)
    bits, dimension, place = whitening.bit_planes(y)
    for d in range(3):
        back = sum(np.unpackbits(b.view(np.uint8))[:70].astype(np.int64) << p for b, k, p in zip(bits, dimension, place, strict=True) if k == d)
        assert back.tolist() == y[:, d].tolist()


def test_whitening_against_a_plain_one(spark, tmp_path):
    rows = odd(300, 6) + [(900, [1.0, 2.0], 1, None, None)]
    found = whitening.op11_whitening(spark, saved(spark, rows, tmp_path)).collect()
    kept = [(i, v + [0.0] * (6 - len(v))) for i, v in plain_vectors(rows)]
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in kept]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    mean = [Fraction(a, n) for a in s]
    v = np.array([[float(sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in x) / n) for j in range(6)] for i in range(6)])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(found) == 6 * n
    deviation = sorted((str(i), sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True))) for (i, _), r in zip(kept, x, strict=True))
    assert sorted((str(r.vec_id), r.deviation) for r in found if r.component == 1) == deviation
    assert all(r.deviation == int(r.deviation_exact) and r.n == n and r.identity_error < 1e-9 for r in found)
    for c in range(6):
        mine = sorted(r.whitened for r in found if r.component == c + 1)
        want = np.array([[float(a - m) for a, m in zip(r, mean, strict=True)] for r in x]) @ vectors[:, c] / math.sqrt(values[c])
        assert np.allclose(mine, np.sort(want), atol=1e-8) or np.allclose(mine, np.sort(-want), atol=1e-8)
        assert all(math.isclose(r.explained, values[c] / values.sum(), rel_tol=1e-9) for r in found if r.component == c + 1)


def test_whitening_without_variance_or_rows(spark, tmp_path):
    assert whitening.op11_whitening(spark, saved(spark, [(1, None, 0, None, None)], tmp_path / "none")).collect() == []
    assert whitening.op11_whitening(spark, saved(spark, [], tmp_path / "empty")).collect() == []
    same = whitening.op11_whitening(spark, saved(spark, [(i, [1.0, 2.0], 0, None, None) for i in range(3)], tmp_path / "same")).collect()
    assert len(same) == 6 and all(r.whitened is None and r.deviation == 0 and r.explained == 0 and r.identity_error == 0 for r in same)
    line = whitening.op11_whitening(spark, saved(spark, [(i, [float(i), 2.0 * i], 0, None, None) for i in range(4)], tmp_path / "line")).collect()
    assert all((r.whitened is None) == (r.component == 2) and r.identity_error < 1e-9 for r in line)
    empty = whitening.op11_whitening(spark, saved(spark, [(1, [], 0, None, None)], tmp_path / "nothing")).collect()
    assert empty == []


def test_whitening_beyond_longs(spark, tmp_path):
    rows = [(1, [1e30, 1.0], 0, None, None), (2, [-1e30, 2.0], 0, None, None), (3, [0.0, 3.0], 0, None, None)]
    found = whitening.op11_whitening(spark, saved(spark, rows, tmp_path)).collect()
    assert len(found) == 6 and all(r.deviation is None for r in found if r.vec_id < 3)
    assert {int(r.deviation_exact) for r in found if r.vec_id == 3} == {64**2 * 3**2}


# Centroid clustering


def plain_clusters(rows):
    kept = [(i, [math.floor(256 * c) for c in v], v) for i, v in plain_vectors(rows, 64)]
    order = sorted(range(len(kept)), key=lambda r: (hashlib.sha256(f"2:{'null' if kept[r][0] is None else kept[r][0]}".encode()).hexdigest(), kept[r][2]))
    middle = [kept[r][1] for r in order[:40]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), k) for k, m in enumerate(middle))
    for _ in range(5):
        groups = {}
        for _, v, _ in kept:
            groups.setdefault(near(v)[1], []).append(v)
        middle = [[sum(c) // len(groups[k]) for c in zip(*groups[k], strict=True)] if k in groups else m for k, m in enumerate(middle)]
    last = [(i, *near(v)) for i, v, _ in kept]
    inertia = {}
    for _, d, k in last:
        inertia[k] = inertia.get(k, 0) + d
    return sorted((str(i), k, d, inertia[k], sum(inertia.values()), hashlib.sha256(",".join(map(str, middle[k])).encode()).hexdigest()) for i, d, k in last)


@pytest.mark.parametrize("n", [7, 150])
def test_clusters_against_plain_ones(spark, tmp_path, n):
    rows = odd(n, 64) + [(800, [1.0] * 63, 0, None, None), (801, [1.0] * 65, 0, None, None), (802, [], 0, None, None)]
    rows += [(900 + i, [0.5] * 64, 0, None, None) for i in range(60)]  # a hot group of copies
    found = centroids.op13_centroids(spark, saved(spark, rows, tmp_path)).collect()
    assert sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in found) == plain_clusters(rows)


def test_clusters_of_far_vectors(spark, tmp_path):
    rows = [(i, [float(np.float32(10.0 ** (i % 39 - 1)))] + [float(i)] * 63, 0, None, None) for i in range(50)]
    found = {r.vec_id: r for r in centroids.op13_centroids(spark, saved(spark, rows, tmp_path)).collect()}
    for i, k, d, c, total, digest in plain_clusters(rows):
        r = found[int(i)]
        fits = lambda v: v if v < 2**63 else None
        assert (r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) == (k, fits(d), fits(c), fits(total), digest)


def test_no_vectors_no_clusters(spark, tmp_path):
    assert centroids.op13_centroids(spark, saved(spark, [], tmp_path / "a")).collect() == []
    assert centroids.op13_centroids(spark, saved(spark, [(1, [1.0], 1, None, None)], tmp_path / "b")).collect() == []


def test_distances_are_the_squares():
    r = np.random.default_rng(3)
    x, m = r.integers(-500, 500, (50, 64)), r.integers(-500, 500, (9, 64))
    assert (centroids.distances(x, m) == ((x[:, None] - m[None]) ** 2).sum(axis=2)).all()
    assert centroids.nearest(np.zeros((1, 64), np.int64), np.array([[1] * 64, [-1] * 64, [1] * 64]))[0].tolist() == [0]


# Pieces

MODEL = pieces.read_model(public_tokenizers.path(pieces.MODEL))
LETTERS = [*"ab e▁\n\t.,0123é你好ñ🦙ÿ<>ж  ", "​", "　", "the ", "of", " the", "  ", "\x00", "<s>", "<0x0A>", "ing"]


def texts(n, seed, size=50):
    r = random.Random(seed)
    return ["".join(r.choice(LETTERS) for _ in range(r.randint(0, size))) for _ in range(n)]


@pytest.mark.parametrize("chunk", [1, 7, 1 << 16])
def test_pieces_are_the_librarys(monkeypatch, chunk):
    monkeypatch.setattr(pieces, "CHUNK", chunk)
    e, library = pieces.Encoder(MODEL), sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    for text in [*texts(400, chunk), "", " ", "  ", "▁", " a", "a" * 300, "你" * 300]:
        found = list(e.encode(text))
        ids, start, end = ([int(x) for part in found for x in part[k]] for k in range(3))
        proto = library.encode(text, return_type="proto").pieces
        assert ids == [p.id for p in proto]
        spans = [(p.begin, p.end) for p in proto]
        assert [s for s, i in zip(spans, ids, strict=True) if not e.byte[i]] == [s for s, i in zip(zip(start, end, strict=True), ids, strict=True) if not e.byte[i]]
        assert start[1:] == end[:-1] and (not ids or (start[0], end[-1]) == (0, len(text.encode())))
        raw = text.encode()
        assert all(raw[a:b] == e.surface[i] for i, a, b in zip(ids, start, end, strict=True) if e.byte[i])
        decoder = e.decoder()
        assert b"".join(decoder.decode(part[0]) for part in found).decode() == library.decode(ids)


def test_any_ids_decode_like_the_library():
    e, library, r = pieces.Encoder(MODEL), sentencepiece.SentencePieceProcessor(model_proto=MODEL), random.Random(5)
    for _ in range(3000):
        ids = [r.choice([0, 1, 2, 3 + r.randrange(256), 3 + r.randrange(128, 256), r.randrange(32000)]) for _ in range(r.randint(0, 9))]
        assert e.decoder().decode(np.array(ids, np.int64)).decode() == library.decode(ids), ids


def compiled(rules: dict[bytes, bytes]) -> bytes:
    """A compiled character map: each node's children stand at its place, crossed with a block of its own."""
    units, texts_, block = {}, b"", [1]
    children: dict[bytes, set[int]] = {b"": set()}
    for key in rules:
        for i in range(len(key)):
            children.setdefault(key[:i], set()).add(key[i])
            children.setdefault(key[: i + 1], set())

    def place(prefix: bytes, at: int, label: int) -> None:
        nonlocal texts_
        base = block[0] * 256  # children and leaf in 256 places, so that no two nodes meet
        block[0] += 1
        offset = at ^ base
        leaf = prefix in rules
        units[at] = label | (leaf << 8) | ((offset << 10) if offset < 1 << 21 else (offset >> 8 << 10) | 0x200)
        if leaf:
            units[base] = 0x80000000 | len(texts_)
            texts_ += rules[prefix] + b"\0"
        for c in children[prefix]:
            place(prefix + bytes([c]), base ^ c, c)

    place(b"", 0, 0)
    array = np.zeros(block[0] * 256, "<u4")
    for at, unit in units.items():
        array[at] = unit
    return len(array.tobytes()).to_bytes(4, "little") + array.tobytes() + texts_


RULES = {"ﬁ": "fi", "é": "e", "é你": "xyz", "…": "...", "　": " ", "🦙": "", "b ": "c", "\n": " ", "ab": "é", "ñ": "n"}


@pytest.mark.parametrize("extra", [False, True])
@pytest.mark.parametrize("prefix", [False, True])
def test_compiled_map_and_spaces(extra, prefix):
    model = messages.ModelProto.FromString(MODEL)
    model.normalizer_spec.name = "own"
    model.normalizer_spec.precompiled_charsmap = compiled({k.encode(): v.encode() for k, v in RULES.items()})
    model.normalizer_spec.remove_extra_whitespaces, model.normalizer_spec.add_dummy_prefix = extra, prefix
    own = model.SerializeToString()
    e, library, r = pieces.Encoder(own), sentencepiece.SentencePieceProcessor(model_proto=own), random.Random(9)
    for _ in range(1500):
        text = "".join(r.choice([*RULES, *LETTERS]) for _ in range(r.randint(0, 14)))
        found = list(e.encode(text))
        ids, start, end = ([int(x) for part in found for x in part[k]] for k in range(3))
        proto = library.encode(text, return_type="proto").pieces
        assert ids == [p.id for p in proto], text
        assert [(p.begin, p.end) for p in proto if not e.byte[p.id]] == [(a, b) for i, a, b in zip(ids, start, end, strict=True) if not e.byte[i]], text
        decoder = e.decoder()
        assert b"".join(decoder.decode(part[0]) for part in found).decode() == library.decode(ids)


def test_models_that_are_refused():
    model = messages.ModelProto.FromString(MODEL)
    model.trainer_spec.byte_fallback = False
    with pytest.raises(ValueError):
        pieces.Encoder(model.SerializeToString())


DOCS = "doc_id long, text string, pieces string, _text0 string"


def test_query_and_operator_on_odd_rows(spark, tmp_path):
    long = " ".join(texts(3000, 8, 80))
    rows = [(1, None, "p", "q"), (2, "", "p", "q"), (None, "no id", "p", "q"), (3, long, None, None), (3, long, None, None), (3, "other", None, None), (4, "a" * 200_000, None, None)]
    rows += [(10 + i, t, None, None) for i, t in enumerate(texts(50, 3))]
    where = saved(spark, rows, tmp_path, DOCS, "documents")
    library = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((str(i), len(ids := library.encode(t or "")), sha(",".join(map(str, ids))), sha(library.decode(ids)), len((t or "").encode())) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), *r[1:]) for r in pieces.op12_pieces(spark, where).collect()) == want
    docs = spark.read.parquet(f"{where}/documents.parquet")
    found = pieces.encode(docs, MODEL)
    assert found.columns == ["doc_id", "text", "_text0", "pieces"]
    for r in found.collect():
        raw = (r.text or "").encode()
        assert [p.id for p in r.pieces] == library.encode(r.text or "") and b"".join(raw[p.start : p.end] for p in r.pieces) == raw
    empty = saved(spark, [], tmp_path / "empty", DOCS, "documents")
    assert pieces.op12_pieces(spark, empty).collect() == [] and pieces.encode(spark.read.parquet(f"{empty}/documents.parquet"), MODEL).collect() == []

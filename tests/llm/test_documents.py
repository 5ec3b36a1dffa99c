"""Operators on documents, against brute force on small odd tables."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from almanac.llm import decontaminate, langid, minhash, mixing, pii, quality, simhash, substrings

LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(30_000))
PASSAGE = " ".join(f"passage{k}" for k in range(60))
NEAR = " ".join(f"near{k}" for k in range(300))
TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "One TWO three",
    "é Ü \U0001f600 ok\x00x",
    "a b a b a b a b " * 20,
    "same line here\nsame line here\n\nother # * $ line",
    LONG,
    PASSAGE,
    "before it stands " + PASSAGE + " and after it too",
    "other words first " + PASSAGE.replace("passage30", "changed") + " at the end",
    NEAR,
    NEAR + " tail",
    NEAR,
    "mail a@b.c_d@e.f or +1 (415) 555-0100, 4111 1111 1111 1111, 1.2.3.4 and 256.1.1.1",
    "the quick brown fox item text has exactly ten words in it now",
    "x" * 20_000,
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, fp string, score string, row string, key string, spans string, n_words string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, ["en", "fr", None][k % 3], ["s1", None, "s0"][k % 3], len(t or "")) for k, t in enumerate(TEXTS)]
    rows += [rows[9], (None, "no id here", "en", "s0", 10), (None, None, None, None, None)]
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x", "x", "x") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_fingerprints_and_components(spark, docs, empty):
    def brute(text):
        w = words(lower(text))
        if not w:
            return 0
        shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [" ".join(w)]
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    rows = simhash.near_duplicates(docs).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == docs.count()
    found = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in rows if r.doc_id is not None}
    fps = {d: brute(t) for d, t in text.items() if d is not None}
    assert {d: f for d, (f, _) in found.items()} == fps
    label = {d: d for d in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 3:
                    label[a] = label[b] = min(label[a], label[b])
    assert {d: c for d, (_, c) in found.items()} == label
    assert simhash.near_duplicates(empty).count() == 0
    assert minhash.keep_one(docs).columns == docs.columns


def test_vantage_point_trees_lose_no_pair(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    flips = [np.uint64(0)] * 900
    for k in range(900):
        for b in rng.choice(64, rng.integers(1, 5), replace=False):
            flips[k] ^= np.uint64(1) << np.uint64(b)
    fps = np.unique(np.concatenate([base, base[:900] ^ np.array(flips), base[0] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))]))
    table = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    edges = simhash.links(table, sample_size=512, shard=60, block=50)
    found = {r.node: r.label for r in simhash.components(edges).collect()}
    label = fps.view(np.int64).copy()
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    for _ in range(20):
        label = np.where(near, label[None, :], np.iinfo(np.int64).max).min(1)
    assert {int(f): found.get(int(f), int(f)) for f in fps.view(np.int64)} == dict(zip(fps.view(np.int64).tolist(), label.tolist(), strict=True))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501)], "a long, b long")
    found = {r.node: r.label for r in simhash.components(edges).collect()}
    assert set(found.values()) == {0, 500} and len(found) == 203
    assert simhash.components(edges.limit(0)).count() == 0


def test_quality_features(spark, docs, empty):
    rows = quality.measure(docs, None).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id is None:
            continue
        t = text[r.doc_id] or ""
        w = words(t)
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered))
    assert quality.measure(empty, None).count() == 0


def test_quality_verdict(spark, empty):
    good = [" ".join(f"good{(k * 7 + j) % 50}" for j in range(60)) for k in range(40)]
    bad = [" ".join(f"junk{(k * 7 + j) % 50}" for j in range(60)) for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 40), 0) for k in range(80) if k % 4 < 2] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    verdict = {r.doc_id: r.kept for r in quality.judge(docs, model).collect()}
    assert all(verdict[k] == (k < 40) for k in range(80))
    kept = quality.keep(docs, model)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(40)) and kept.columns == docs.columns
    unknown = quality.fit(docs, labels.limit(0))
    assert all(r.kept for r in quality.judge(docs, unknown).collect())
    assert quality.judge(empty, quality.fit(empty, labels)).count() == 0


def test_pii_base_spans(spark, docs, empty):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    def brute(t):
        out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(re.sub(r"\D", "", m[0])) <= 19 and luhn(re.sub(r"\D", "", m[0]))]
        return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]

    odd = ["a@b.c..foo@bar.com", "x@y.", "..a@b.co.uk.", "1.2.3.4.5.6.7.8", "0001.2.3.4", "\U0001f600 4111 1111 1111 1111 é", "-4111111111111111-", "4111-1111-1111-1111 4111", "+1 (415) 555-0100. +12", "+1234567890123", "￿a@b.c￿", "a.b.@c.d", "5 4111111111111111 3", "1 2 3 4 5 6 7 8 9 0 " * 300, "a." * 3000 + "@b.c", "a@" + "b." * 3000, "7" * 5000, "line\n4111111111111111\nline"]
    table = spark.createDataFrame([(r.doc_id, r.text) for r in docs.collect()] + [(1000 + k, t) for k, t in enumerate(odd)], "doc_id long, text string")
    text = {r.doc_id: r.text for r in table.collect()}
    rows = pii.extract(table).collect()
    assert len(rows) == table.count()
    for r in rows:
        if r.doc_id is not None:
            assert [tuple(s) for s in r.base] == brute(text[r.doc_id] or ""), r.doc_id
    assert pii.extract(empty).count() == 0
    shown = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert shown[15] == "mail <EMAIL><EMAIL> or <PHONE>, <CARD>, <IP> and 256.1.1.1"
    assert shown[0] is None and shown[8] == LONG and pii.mask(docs).columns == docs.columns


def test_pii_patterns_find_unseen_identifiers(spark):
    rows = [(k, f"please write to user{k:04d}@example.org today") for k in range(12)] + [(99, "please write to acct-20240817-77 today"), (100, "room number 20240817-77 is free")]
    found = {r.doc_id: r.added for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(s) for s in found[99]] == [("id", 16, 32)]
    assert found[100] == [] and found[3] == []


def test_language(spark, empty):
    rng = np.random.default_rng(0)
    stems = {"en": ["the", "thing", "with", "shower"], "fr": ["élan", "eaux", "quoi", "leçon"]}
    rows = [(k, " ".join(rng.choice(stems[lang]) + rng.choice(["", "s", "er"]) for _ in range(40)), lang) for k in range(80) for lang in [("en", "fr")[k % 2]]]
    rows += [(500, None, "en"), (501, "123 !!", "fr"), (502, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.fit(docs)
    got = {r.doc_id: r for r in langid.predict(docs, net).collect()}
    assert all(got[k].lang_pred == lang for k, _, lang in rows[:80]) and all(0 <= r.score <= 1 for r in got.values())
    assert {got[k].lang_pred for k in (500, 501, 502)} == {"und"}
    assert langid.predict(empty, langid.fit(empty)).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}


def test_network_gradients():
    net = langid.Network(["a", "b"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, _ = langid.pieces([b"hello", b"wo", b"xyzzy!"])
    truth, weight = np.array([[1, 0], [0.3, 0.7], [0, 1.0]]), np.ones(3)
    _, g = net.gradients(x, truth, weight)
    for k, v in net.p.items():
        at = np.unravel_index(np.abs(g[k]).argmax(), v.shape)
        was = v[at]
        v[at] = was + 1e-3
        up = net.gradients(x, truth, weight)[0]
        v[at] = was - 1e-3
        down = net.gradients(x, truth, weight)[0]
        v[at] = was
        assert abs((up - down) / 2e-3 - g[k][at]) < 1e-4


def test_mixing(spark, docs, empty):
    rows = mixing.taken(*mixing.mix(docs)).collect()
    assert len(rows) == docs.count()
    total = sum(r["size"] for r in rows)
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        by.setdefault((r.source_size, r.target), []).append(r)
    assert abs(sum(t for _, t in by) - 1.5 * total) < 1e-6 * total
    for (size, target), own in by.items():
        assert sum(r["size"] for r in own) == size and target <= 2 * size + 1e-9
        assert abs(sum(r.taken for r in own) - target) <= 2 * mixing.BLOCK_WORDS
    again = {(r.row, r.taken) for r in mixing.taken(*mixing.mix(docs)).collect()}
    assert again == {(r.row, r.taken) for r in rows}
    assert mixing.taken(*mixing.mix(empty)).count() == 0


def test_splitting_tree_is_exact():
    quota = [1000, 0, 17, 3]
    out = mixing.split(quota, 7, seed=3)
    assert out.sum(1).tolist() == quota and (out >= 0).all()
    assert abs(out.sum(0) - sum(quota) / 7).max() <= 3
    assert mixing.targets([100, 100, 100]) == pytest.approx([200, 250 / 3, 500 / 3])
    assert mixing.targets([10, 1000]) == pytest.approx([20, 1495])


def test_blocks_are_disjoint(spark):
    docs = spark.createDataFrame([(k, "w " * (k % 300), f"s{k % 3}") for k in range(400)], "doc_id long, text string, source string")
    documents, blocks = mixing.mix(docs, shard_words=4096)
    rows = blocks.collect()
    assert len({(r.row, r.block, r["shard"], r.place) for r in rows}) == len(rows)
    assert len({r["shard"] for r in rows}) == -(-round(1.5 * documents.agg({"size": "sum"}).first()[0]) // 4096)


@pytest.mark.parametrize("window", [3, 10])
def test_decontamination(spark, docs, empty, window):
    items = [(1, "The QUICK brown fox, item text has exactly ten words! in it"), (2, "brown fox"), (3, None), (4, "..."), (5, PASSAGE), (5, PASSAGE), (6, "a b a"), (None, "ok")]
    benchmark = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    grams = {}
    for item, t in items:
        w = cut(t)
        n = min(len(w), window)
        for k in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[k : k + n]), set()).add("" if item is None else str(item))
    sizes = {len(g) for g in grams}
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = decontaminate.mark(docs, benchmark, window).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id is None:
            continue
        w = cut(text[r.doc_id])
        hit, which = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if found := grams.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    which |= found
        assert (r.n_words, r.n_hit, r["items"]) == (len(w), len(hit), sorted(which)), r.doc_id
    assert decontaminate.mark(empty, benchmark).count() == 0
    assert {r.n_hit for r in decontaminate.mark(docs, benchmark.limit(0)).collect()} == {0}


def test_decontamination_in_blocks_and_removal(spark, docs):
    benchmark = spark.createDataFrame([(1, PASSAGE), (2, "the quick brown fox item text has exactly ten words in it now")], "item_id long, text string")
    parts = list(decontaminate.automata(benchmark, 10, block_bytes=200))
    assert len(parts) > 1
    left = {r.doc_id: r for r in decontaminate.remove(docs, benchmark).collect()}
    assert 16 not in left and 9 not in left and left[0].text is None and left[8].text == LONG
    kept = {r.doc_id: r.text for r in decontaminate.remove(docs, benchmark, max_coverage=1.0).collect()}
    assert kept[10] == "before it stands \n and after it too"


def test_passages(spark, docs, empty):
    found = {(r.doc_id, r.ref_doc_id): r for r in substrings.passages(docs).collect()}
    a = found[10, 9]
    assert (a.start, a.end, a.ref_start, a.ref_end, a.identity) == (3, 63, 0, 60, 1.0)
    b = found[11, 9]
    assert (b.start, b.end, b.n_words) == (3, 63, 60) and round(b.identity, 3) == round(59 / 60, 3)
    assert found[13, 12].n_words == 300 and found[14, 12].n_words == 300
    assert {d for d, _ in found} == {10, 11, 13, 14}
    assert substrings.passages(empty).count() == 0


def test_chains_prefer_collinear_segments():
    parts = substrings.segments(np.array([0, 10, 20, 60, 70, 80, 90]), np.array([100, 110, 120, 161, 171, 181, 5]))
    best = substrings.chains(parts)[0]
    assert [parts[k][:2] for k in best] == [(0, 100), (60, 161)]
    tree = substrings.Fenwick(5)
    tree.put(2, (1.0, 7))
    tree.put(4, (3.0, 8))
    assert tree.get(2) == (-np.inf, -1) and tree.get(3) == (1.0, 7) and tree.get(5) == (3.0, 8)


def test_op6_digest(spark, tmp_path):
    spark.createDataFrame([(1, "a@b.cd 1.2.3.4"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in pii.op6_pii(spark, str(tmp_path)).collect()}
    assert got[1].base_sha256 == hashlib.sha256(b"email:0:6,ip:7:14").hexdigest() and got[1].spans == "email:0:6,ip:7:14"
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (1, 1, 0, 0)
    assert got[2].base_sha256 == hashlib.sha256(b"").hexdigest()

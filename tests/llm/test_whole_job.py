"""What small or plain tables do not show: each test failed on a version that did less than the whole job."""

import random
import re
from collections import Counter
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from almanac.llm import decontaminate, langid, minhash, mixing, pii, simhash, substrings
from almanac.llm.common import table
from almanac.llm.textops import ALNUM, word_slices

VOCABULARY = [f"v{k}" for k in range(4000)]


def _shingles(text, size=5):
    w = (text or "").lower().split()
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def _components(texts):
    """doc_id -> least doc_id of its component, by all pairs."""
    sets = {k: _shingles(t) for k, t in texts.items()}
    label = {k: k for k in texts}
    pairs = [(a, b) for a in sets for b in sets if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))]
    while any(label[a] != label[b] for a, b in pairs):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_near_duplicates_by_similarity(spark):
    rng = np.random.default_rng(3)
    texts = {900: None, 901: "", 902: "three words only", 903: "Three Words only", 904: "three words too", 905: "w " * 40}
    for k in range(0, 240, 4):
        base = rng.choice(VOCABULARY, 200).tolist()
        for j in range(4):  # each text differs from the one before it, in up to 6 places
            for at in rng.choice(200, rng.integers(0, 7) if j else 0, replace=False):
                base[at] = str(rng.choice(VOCABULARY))
            texts[k + j] = " ".join(base)
    want = _components(texts)
    assert len(set(want.values())) < 150
    other = " ".join(VOCABULARY[:90])
    rows = [*texts.items(), (None, "no id"), (None, "no id"), (None, texts[0]), (0, texts[0]), (0, other), (8, texts[8])]
    docs = spark.createDataFrame([(d, t, k) for k, (d, t) in enumerate(rows)], "doc_id long, text string, _key0 int")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).where("doc_id is not null").collect()} == want
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    got = [r.doc_id for r in kept]
    assert got.count(None) == 1 and got.count(0) == 2 and {r.text for r in kept if r.doc_id == 0} == {texts[0], other}
    assert sorted(k for k in got if k) == sorted(set(want.values()) - {0})
    assert all(rows[r["_key0"]] == (r.doc_id, r.text) for r in kept)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_languages_of_rare_words_stay(spark):
    rng = np.random.default_rng(4)
    draw = lambda letters, n: "".join(rng.choice(list(letters), n))
    rows = [(k, " ".join(str(rng.choice(["the", "thing", "with", "shower", "house"])) + str(k % 7) for _ in range(60)), "en") for k in range(60)]
    rows += [(100 + k, " ".join(draw("\u6f22\u5b57\u4e2d\u6587\u8a9e\u8a00\u5b78\u7fd2\u66f8", 9) for _ in range(12)), "zh") for k in range(60)]  # hardly a word twice
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.fit(docs, max_words=30)  # en alone has 35 words that are more frequent
    assert net.langs == ["en", "zh"]
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, net).collect()}
    assert all(got[k] == lang for k, _, lang in rows)
    assert langid.shares({"a": 5, "b": 100, "c": 100}, 45) == {"a": 5, "b": 20, "c": 20}


def test_removal_looks_at_the_original_text(spark):
    run = lambda name, a, b: " ".join(f"{name}{k}" for k in range(a, b))
    items = [(1, run("w", 0, 14)), (2, run("w", 5, 19)), (3, run("x", 0, 10)), (4, run("y", 0, 40)), (5, run("z", 0, 40))]
    texts = {
        1: f"before {run('w', 0, 19)} after",
        2: f"{run('y', 0, 40)} {run('clean', 0, 20)} {run('z', 0, 40)}",
        3: f"{run('x', 0, 5)} {run('w', 0, 14)} {run('x', 5, 10)} {run('clean', 0, 20)}",
        4: f"\u00e9\U0001f600 {run('x', 0, 10)} \u00fc {run('clean', 0, 20)}",
        5: None,
    }
    docs = spark.createDataFrame([(k, "keep", t, len(t or "")) for k, t in texts.items()], "doc_id long, _spans0 string, text string, n_chars long")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = {3: f"{run('x', 0, 5)} \n {run('x', 5, 10)} {run('clean', 0, 20)}", 4: f"\u00e9\U0001f600 \n \u00fc {run('clean', 0, 20)}", 5: None}
    for block_bytes in (1 << 20, 120, 60):  # 1, 5 and 10 blocks
        assert block_bytes > 1000 or len(decontaminate.automata(benchmark, 10, block_bytes)) > 1
        rows = decontaminate.remove(docs, benchmark, block_bytes=block_bytes).collect()
        assert {r.doc_id: r.text for r in rows} == want, block_bytes
        assert all(r.n_chars == len(r.text or "") and r._spans0 == "keep" for r in rows)
        whole = {r.doc_id: r.text for r in decontaminate.remove(docs, benchmark, max_coverage=1.0, block_bytes=block_bytes).collect()}
        assert whole[1] == "before \n after" and whole[2] == f"\n {run('clean', 0, 20)} \n"


def test_fingerprints_with_one_equal_half():
    rng = np.random.default_rng(6)
    low = rng.integers(0, 1 << 32, 1500, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 32, (3, 1500), dtype=np.uint64)
    for shift in (0, 32):
        fps = np.unique(np.concatenate([low, low ^ flips[0] ^ flips[1] ^ flips[2], low[:9]]) << np.uint64(32 - shift))
        label = simhash.linked(fps, shift, 3)
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
        want = np.arange(len(fps))
        for _ in range(20):
            want = np.where(near, want[None, :], len(fps)).min(1)
        assert np.array_equal(label, want)


def test_pattern_scores_by_brute_force(spark):
    rng = np.random.default_rng(8)
    edges, totals = {}, {}
    for context in range(12):
        for value in rng.choice(60, rng.integers(2, 12), replace=False).tolist():
            edges[context, value] = (int(rng.integers(1, 4)), value < 25 + 3 * (context % 2), value > 52)
        totals[context] = sum(n for (c, _), (n, _, _) in edges.items() if c == context) + int(rng.integers(0, 3))
    accepted = {}
    for _ in range(4):
        value_score = {}
        for (c, v), (_, seed, bad) in edges.items():
            doubt = np.prod([1 - min(0.999, accepted[d]) for d in accepted if (d, v) in edges])
            value_score[c, v] = 0.0 if bad else max(float(seed), 1 - doubt if accepted else 0.0)
        conf = {c: sum(n * value_score[c, v] for (d, v), (n, _, _) in edges.items() if d == c) / (totals[c] + 1) for c in totals}
        support = {c: sum(value_score[c, v] >= 0.5 for d, v in edges if d == c) for c in totals}
        accepted = {c: conf[c] for c in totals if conf[c] >= 0.4 and support[c] >= 3}
    table = spark.createDataFrame([(c, 100 + c, v, n, s, b) for (c, v), (n, s, b) in edges.items()], "context long, words long, value long, n long, seed boolean, bad boolean")
    said = spark.createDataFrame([(100 + c, n) for c, n in totals.items()], "words long, total long")
    got = {r.context: r.confidence for r in pii.patterns(table, said, 4, 0.4, 3).collect()}
    assert got.keys() == accepted.keys() and 0 < len(got) < 12 and np.allclose([got[c] for c in got], [accepted[c] for c in got])


def test_bootstrapped_patterns_are_no_common_words(spark):
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    token = lambda: "".join(rng.choice(list("0123456789abcdef"), 40))
    rows = []
    for k in range(60):
        filler = " ".join(["the " + word() for _ in range(40)])
        rows.append(f'{filler} the {k}4351183771781{k:03d} and token = "{token()}" the end the user{k}@mail.org {filler}')  # the first: no card
    rows += [f'{"the "  + word()} token = "short-{k}9z" the {word()} Id:abc{k}99 {word()}' for k in range(5)]
    rows += [f"call 555 {k} 4567 {word()}" for k in range(100, 104)] + [f"call +1 555 {k} 4567 {word()}" for k in range(200, 260)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r.doc_id: [rows[r.doc_id][s.start : s.end] for s in r.added] for r in pii.extract(docs).collect()}
    assert [k for k in range(60) if [len(x) for x in found[k]] != [40]] == []
    assert all(found[60 + k] == [f"short-{k}9z"] for k in range(5))
    assert all(found[65 + k] == [f"555 {100 + k} 4567"] for k in range(4)) and not any(found[69 + k] for k in range(60))


def test_masking_many_spans_and_clashing_columns(spark):
    n = 3000
    texts = [" ".join(f"é{k} user{k}@mail{k}.org" for k in range(n)), "a@b.org@c.de 1.2.3.4 \U0001f600 +49 (030) 1234567.", None, ""]
    docs = spark.createDataFrame([(k, t, f"s{k}", f"k{k}") for k, t in enumerate(texts)], "_row0 long, text string, _spans0 string, _key string").withColumn("doc_id", F.lit(1))
    got = {r["_row0"]: r for r in pii.mask(docs).collect()}
    assert got[0].text == " ".join(f"é{k} <EMAIL>" for k in range(n))
    assert got[1].text == "<EMAIL>@c.de <IP> \U0001f600 <PHONE>." and got[2].text is None and got[3].text == ""
    assert all(r["_spans0"] == f"s{k}" and r["_key"] == f"k{k}" for k, r in got.items())
    assert pii.mask(docs.limit(0)).count() == 0


def test_mix_against_a_plain_one(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rows = [(k, " ".join(f"w{j}" for j in range(int(rng.integers(0, 300)))), "abc"[k % 3] if k % 7 else None) for k in range(90)]
    docs = spark.createDataFrame([*rows, rows[5]], "doc_id long, text string, source string").repartition(3)
    documents, blocks = mixing.mix(docs, shard_words=1500)
    owner = {r.row: r for r in documents.collect()}
    drawn = blocks.collect()
    quota = {}
    for r in owner.values():
        quota.setdefault((r.source_size, r.target), []).append(r["size"])
    per = sorted(quota, key=lambda x: next(min(str(s or "z") for d, t, s in rows if d == r.doc_id) for r in owner.values() if (r.source_size, r.target) == x))
    want = [round(t / n * sum(-(-m // mixing.BLOCK_WORDS) for m in quota[n, t])) for n, t in per]
    shards = max(1, -(-sum(t for _, t in per) // 1500))
    ends = mixing.split(want, int(shards), 20240917)
    got = np.zeros_like(ends)
    for b in drawn:
        o = owner[b.row]
        got[per.index((o.source_size, o.target)), b.shard] += 1
        assert b.words == min(mixing.BLOCK_WORDS, o["size"] - mixing.BLOCK_WORDS * b.block)
    assert np.array_equal(got, ends) and max(Counter((b.row, b.block) for b in drawn).values()) == 2
    # a tree below each node of the upper one
    deep = mixing.mix(docs, shard_words=1500, top=3)[1].collect()
    assert sorted((b.row, b.block) for b in deep) == sorted((b.row, b.block) for b in drawn) and {b.shard for b in deep} == set(range(int(shards)))
    text = mixing.materialised(docs, shard_words=1500).collect()
    assert Counter((r.doc_id, r.text) for r in text) == Counter((owner[b.row].doc_id, " ".join(f"w{j}" for j in range(32 * b.block, 32 * b.block + b.words))) for b in drawn)
    monkeypatch.setattr(mixing, "split", lambda quota, shards, seed: np.zeros((len(quota), shards), np.int64))
    assert all(r.taken == 0 for r in mixing.taken(*mixing.mix(docs)).collect())


def test_exact_draws_beyond_numpys_limit():
    rng = np.random.default_rng(13)
    for good, bad, n in ((7, 9, 6), (40, 25, 30), (3, 200, 50)):
        chance = np.array([comb(good, k) * comb(bad, n - k) / comb(good + bad, n) for k in range(max(0, n - bad), min(good, n) + 1)])
        assert np.allclose(np.exp([mixing.log_hypergeometric(k, good, bad, n) for k in range(max(0, n - bad), min(good, n) + 1)]), chance, rtol=1e-9)
    good, bad, n = 3 * 10**12, 5 * 10**12, 10**11
    got = np.array([mixing.hypergeometric(rng, good, bad, n) for _ in range(3000)], float)
    sd = (n * 3 / 8 * 5 / 8 * (good + bad - n) / (good + bad - 1)) ** 0.5
    z = (got - n * 3 / 8) / sd
    assert abs(z.mean()) < 0.07 and abs(z.std() - 1) < 0.05 and abs((z < -1).mean() - 0.1587) < 0.025 and abs((z > 1).mean() - 0.1587) < 0.025
    small = np.array([mixing.hypergeometric(rng, 4, 2 * 10**9, 10**9) for _ in range(3000)])
    assert np.allclose(np.bincount(small, minlength=5) / 3000, [1 / 16, 4 / 16, 6 / 16, 4 / 16, 1 / 16], atol=0.04)


def test_mixed_keeps_clashing_columns_and_repeats(spark):
    text = " ".join(f"w{j}" for j in range(400))
    docs = spark.createDataFrame([(1, text, "a", "x", 1), (1, text, "a", "y", 2), (None, text, None, "z", 3), (2, None, "b", "n", 4)], "doc_id long, text string, source string, size string, row int")
    got = mixing.mixed(docs).collect()
    assert sorted((r["size"], r.row) for r in got) == [("x", 1), ("y", 2), ("z", 3)] and all(r["_size0"] == 400 and 0 < r.taken <= 800 for r in got)
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_automaton_in_pieces_by_brute_force(monkeypatch):
    rng = np.random.default_rng(14)
    split = lambda t: list(word_slices(pa.array(t), ALNUM))
    items = [" ".join(rng.choice(list("abc"), n)) for n in (3, 2, 5, 9, 30, 31)]
    texts = [" ".join(rng.choice(list("abcd"), n, p=[0.35, 0.3, 0.3, 0.05])) for n in (0, 1, 40, 300)] + [f"d {items[4]} d", items[5]]
    hashed = [w.hash[w.first[k] : w.first[k + 1]] for _, _, w in split(items) for k in range(len(items))]
    for piece in (1, 4, 256):
        monkeypatch.setattr(decontaminate, "PIECE", piece)
        automaton = decontaminate.Automaton(decontaminate.Builder([([str(k)], h) for k, h in enumerate(hashed)], 5).packed(), 5)
        for _, _, w in split(texts):
            spans, found = automaton.scan(w)
            rows = decontaminate._by_row(w, spans)
            for row, text in enumerate(texts):
                own, hit, which = text.split(), set(), set()
                for k, item in enumerate(map(str.split, items)):
                    n = min(5, len(item))
                    windows = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)}
                    for i in range(len(own) - n + 1):
                        if tuple(own[i : i + n]) in windows:
                            hit |= set(range(i, i + n))
                            which.add(str(k))
                assert {x - w.first[row] for a, b in rows.get(row, []) for x in range(a, b)} == hit and found.get(row, set()) == which


def test_pipeline_on_an_odd_table(spark, tmp_path):
    rng = np.random.default_rng(15)
    prose = [" ".join(rng.choice(VOCABULARY, 120)) for _ in range(40)]
    item = " ".join(f"item{k}" for k in range(12))
    rows = [(k, t, "en", "ab"[k % 2], len(t), "x") for k, t in enumerate(prose)]
    rows += [(100, prose[0], "en", "a", 0, "copy"), (0, prose[0], "en", "a", len(prose[0]), "row again"), (101, None, None, None, 0, None), (102, "", "en", "a", 0, "y"), (None, prose[1] + " more", "en", None, 0, "no id")]
    rows += [(103, f"{prose[2][::-1]} {item} mail me@here.org", "en", "b", 0, "hit"), (3, "another text of this id " + prose[5][::-1], "fr", "b", 0, "id again")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row0 string"
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, item), (2, None)], "item_id long, text string")
    for name, table in (("documents", docs), ("labels", labels), ("benchmark", benchmark)):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    plain = corpus_pipeline.quality_rules(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()
    assert all(r.text in {t for _, t, *_ in rows} for r in plain)
    left = {r["_row0"] for r in plain}
    assert len(out) > 10 and {"copy", "no id", "row again"} & {r["_row0"] for r in out} <= {"row again"}  # 0 and 1 stay for them
    assert all(r.taken > 0 and r["size"] == len(r.text.split()) for r in out)
    if "hit" in left:
        text = next(r.text for r in out if r["_row0"] == "hit")
        assert "item3" not in text and "<EMAIL>" in text and "me@here.org" not in text
    assert out[0].asDict().keys() >= set(docs.columns)
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_common_words_of_gaps():
    rng = np.random.default_rng(16)

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for v in a:
            last = 0
            for j, w in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if v == w else max(row[j], row[j - 1])
        return row[-1]

    for _ in range(60):
        a, b = (rng.integers(0, 6, rng.integers(0, 40)).astype("<u4") for _ in range(2))
        assert substrings._common(a, b) == plain(a.tolist(), b.tolist())
    a = np.arange(200, dtype="<u4")
    assert substrings._common(a, np.concatenate([[999], a[:150], a[151:]]).astype("<u4")) == 199  # one word put in, one left out


def test_passages_whose_parts_are_elsewhere(spark):
    r = random.Random(3)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    rows = []
    for g in range(30):
        passage, k = words(120), 10 * g
        rows += [(k + j, " ".join(words(20) + passage[40 * j : 40 * j + 40] + words(20))) for j in range(3)]
        rows += [(k + j, " ".join(words(15) + passage + words(25))) for j in (3, 4)]
    found = substrings.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {(x.doc_id, x.ref_doc_id): (x.start, x.end) for x in found}
    assert all(abs(got[10 * g + 4, 10 * g + 3][0] - 15) <= 2 and abs(got[10 * g + 4, 10 * g + 3][1] - 135) <= 2 for g in range(30))
    assert len(got) == 30  # the parts are too short


def test_passages_cover_what_all_runs_cover(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    texts = {x.doc_id: [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in x.text or "")) if w] for x in docs.collect()}
    first, want = {}, {}
    for doc in sorted(texts):
        for k in range(len(texts[doc]) - 49):
            run = tuple(texts[doc][k : k + 50])
            if first.setdefault(run, doc) < doc:
                want.setdefault(doc, set()).update(range(k, k + 50))
    covered = {}
    for x in substrings.passages(docs).collect():
        covered.setdefault(x.doc_id, set()).update(range(x.start, x.end))
    total = sum(map(len, want.values()))
    assert total and sum(len(want[d] & covered.get(d, set())) for d in want) >= 0.98 * total


def _links(found, n=50):
    """Pairs that are linked by a passage, or by passages that hold the same n words of one document."""
    spans = [(x.doc_id, x.ref_doc_id, x.ref_start, x.ref_end) for x in found]
    out = {tuple(sorted(x[:2])) for x in spans}
    for a in spans:
        out |= {tuple(sorted((a[0], b[0]))) for b in spans if a[1] == b[1] and a[0] != b[0] and min(a[3], b[3]) - max(a[2], b[2]) >= n}
    return out


def test_passages_link_every_pair(spark):
    r = random.Random(5)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    head, tail, line, once = words(29), words(29), words(26), words(60)
    texts = [words(20) + once[:40] + words(9), *(words(5 + k) + once + words(30) for k in range(5))]  # every holder, not the first only
    texts += [words(9) + head + words(70) for _ in range(40)] + [words(4) + tail + words(70) for _ in range(40)] + [words(k) + head + tail + words(k) for k in (7, 12, 30)]  # all seeds are elsewhere, many times
    texts += [words(10) + head + line + words(10), words(25) + head + line + words(11), words(90) + line + words(8)]
    two = words(60), words(60)
    texts += [words(3) + two[0] + words(90) + two[1] + words(3), words(6) + two[0] + words(80) + two[1] + words(9)]  # too far apart for one passage
    one = words(55)
    texts += [words(20) + one + words(20), words(2) + one[:18] + words(30) + one[20:38] + words(8) + one + words(5)]  # its seeds come before, apart
    runs = {}
    for doc, t in enumerate(texts):
        for k in range(len(t) - 49):
            runs.setdefault(tuple(t[k : k + 50]), set()).add(doc)
    want = {(a, b) for docs in runs.values() for a in docs for b in docs if a < b}
    found = substrings.passages(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert len(want) == 16 and want <= _links(found)
    assert {(x.doc_id, x.ref_doc_id) for x in found} >= {(b, a) for a in range(1, 6) for b in range(a + 1, 6)}
    k = next(k for k, t in enumerate(texts) if t[3:63] == two[0])
    assert sorted((x.start, x.end) for x in found if (x.doc_id, x.ref_doc_id) == (k + 1, k)) == [(6, 66), (146, 206)]
    copies = substrings.passages(spark.createDataFrame([(k, " ".join(one) if k else "x") for k in range(50)], "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.ref_doc_id, x.start, x.end) for x in copies) == [(k, 1, 0, 55) for k in range(2, 50)]


def test_stretches_by_all_windows():
    rng = np.random.default_rng(2)
    for _ in range(60):
        same = rng.random(rng.integers(0, 90)) < rng.choice([0.6, 0.75, 0.9])
        any_ = any(same[a] and same[b - 1] and same[a:b].mean() >= 0.8 for a in range(len(same)) for b in range(a + 20, len(same) + 1))
        got = substrings.stretches(same, 20, 0.8)
        assert bool(got) == any_ and all(b - a >= 20 and same[a:b].mean() >= 0.8 for a, b in got)


def test_near_duplicates_in_large_bands_of_unlike_texts(spark):
    rng = np.random.default_rng(12)
    draw = lambda k: rng.choice(VOCABULARY, k).tolist()
    base, texts = draw(176), {}
    for k in range(0, 120, 2):  # any two of these differ too much, but for the pairs k, k + 1 of every sixth
        own = draw(26)
        texts[k] = " ".join(base + own)
        texts[k + 1] = " ".join(base + (own[:16] + draw(10) if k % 12 == 0 else draw(26)))
    want = _components(texts)
    assert len(set(want.values())) == 110
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == want
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs.where("doc_id < 30").repartition(2)).collect()} == {k: v for k, v in want.items() if k < 30}

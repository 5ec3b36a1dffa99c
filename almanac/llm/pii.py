"""Personal data: base patterns, and bootstrapped contextual extraction.

Only DataFrame functions are used. The base patterns find e-mail and IP
addresses, card and phone numbers. A document is cut at a pattern's matches;
the lengths of the pieces and of the matches add up to the places. The patterns
are written without repeated groups, so that a long run of characters takes
linear time and no deep recursion; each is equal to its plain form.

The method then learns from the corpus itself. Candidates are words with a digit
or an @ of ``MIN_LENGTH`` characters at least, with the number groups that follow
them. Their contexts are the lexical patterns: on the left the word before them
on their line (two, if the last one has no letter), or a label that is joined to
them by = or :, and on the right the word after them. Lower case, digits as 0.
Seeds are the candidates that overlap a base match, and machine-made strings: 20
or more letters and digits, with five of each at least. Candidates that look like
a base kind but fail its check are known to be none: they score 0 for good.

In the graph of patterns and instances (values), a pattern's confidence is the
sum of its instances' scores over all words that stand in its context anywhere
in the corpus, candidates or not, and one more. So a word that comes before all
sorts of words is no pattern, however many seeds it has. A pattern of at least
``MIN_CONFIDENCE`` and ``MIN_SUPPORT`` distinct instances of score 0.5 or more is
accepted; an instance's score is the noisy-or over its accepted patterns, seeds
stay at 1. After ``ROUNDS`` rounds the accepted patterns' candidates are the
further spans, of kind ``id``, where no base span is, or
where a machine-made string goes on beyond one.

Matches of a text are summed up in steps of ``STEP``, so that the arrays of places
are not copied once for each match.

Defined results: a null or empty text has no spans; repeated rows each get a
row; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm.common import cut, table, unused

ROUNDS = 3
MIN_CONFIDENCE = 0.8
MIN_SUPPORT = 3
MIN_LENGTH = 6
STEP = 256
#: Up to so many contexts (8 bytes each), or documents with added spans, are broadcast; beyond, joins shuffle.
BROADCAST_ROWS = 200_000
KINDS = ("email", "ip", "card", "phone")

SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"


PIECE = "struct<start:bigint,end:bigint,value:string>"


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def _steps(items: Column) -> Column:
    """An array, not empty, as arrays of ``STEP`` entries."""
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(items) / STEP).cast("int") - 1), lambda i: F.slice(items, i * STEP + 1, STEP))


def _running(items: Column, kind: str, step: Callable[[Column, Column], Column]) -> Column:
    """What step(acc, item) puts in acc.out (array of ``kind``) along an array; acc.at (bigint) is carried from 0."""
    none = F.array().cast(f"array<{kind}>")

    def further(acc: Column, chunk: Column) -> Column:
        own = F.aggregate(chunk, F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return _with(own, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    def whole(it: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.when(F.size(it) > 0, F.flatten(F.aggregate(_steps(it), start, further)["out"])).otherwise(none)

    return _with(items, whole)


def _pieces(text: Column, pattern: str) -> Column:
    """(start, end, value) of the matches of a pattern that never matches nothing."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    paired = _with(found, lambda m: F.zip_with(F.slice(gaps, F.lit(1), F.size(m)), m, lambda g, x: F.struct(F.length(g).alias("gap"), x.alias("value"))))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["value"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("out"))

    return _running(paired, PIECE, step)


def _spans(kind: str, found: Column) -> Column:
    return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].cast("bigint").alias("start"), x["end"].cast("bigint").alias("end")))


def _none() -> Column:
    return F.array().cast(f"array<{PIECE}>")


def emails(text: Column) -> Column:
    r"""Matches of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+`.

    A dot that no label follows is set to U+FFFF first, so that the labels and
    their dots are one run of characters.
    """
    plain = F.regexp_replace(F.translate(text, "\uffff", "!"), r"\.(?![A-Za-z0-9-])", "\uffff")
    pattern = r"(?:\G|(?<![A-Za-z0-9._%+\uFFFF-]))[A-Za-z0-9._%+\uFFFF-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++"
    return F.when(F.contains(text, F.lit("@")), _pieces(plain, pattern)).otherwise(_none())


def ips(text: Column) -> Column:
    """Four dotted numbers of at most 255 each."""
    pattern = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
    part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
    found = F.when(text.rlike(r"[0-9]\.[0-9]"), _pieces(text, pattern)).otherwise(_none())
    return F.filter(found, lambda x: x["value"].rlike(rf"^{part}\.{part}\.{part}\.{part}$"))


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum."""
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda acc, k: acc + F.element_at(F.when((n - k) % 2 == 0, F.array(*map(F.lit, range(10)))).otherwise(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)))), F.substr(digits, k, F.lit(1)).cast("int") + 1),
    )
    return total % 10 == 0


def cards(text: Column) -> Column:
    """Runs of digits with single spaces or hyphens between, 13 to 19 digits, check sum right.

    The runs are what is left between everything that cannot be in one.
    """
    other = r"[^0-9]{2,}|[^0-9 -]|^[^0-9]|[^0-9]$"
    between = F.regexp_extract_all(text, F.lit(r"(?s)" + other.replace("$", r"\z")), F.lit(0))
    runs = F.split(text, r"(?s)" + other.replace("$", r"\z"), -1)
    paired = F.zip_with(runs, between, lambda r, g: F.struct(r.alias("value"), F.length(F.coalesce(g, F.lit(""))).alias("gap")))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x["value"])
        one = F.struct(acc["at"].alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct((end + x["gap"]).alias("at"), F.when(F.length(x["value"]) >= 13, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    def right(x: Column) -> Column:
        digits = F.regexp_replace(x["value"], "[^0-9]", "")
        return F.length(digits).between(13, 19) & _luhn(digits)

    return F.filter(F.when(text.rlike(r"[0-9][0-9 -]{11,}[0-9]"), _running(paired, PIECE, step)).otherwise(_none()), right)


def phones(text: Column) -> Column:
    """A plus sign, digits and their separators, 9 to 15 digits."""
    found = F.when(text.rlike(r"\+[0-9]"), _pieces(text, r"\+[0-9][\x20().0-9-]+[0-9]")).otherwise(_none())
    return F.filter(found, lambda x: F.length(F.regexp_replace(x["value"], "[^0-9]", "")).between(9, 15))


def base(text: Column) -> Column:
    """kind, start, end (code points, end exclusive) of all base spans, by kind."""
    return F.concat(*(_spans(k, f(text)) for k, f in zip(KINDS, (emails, ips, cards, phones), strict=True)))


CANDIDATE = "struct<before:string,word:string,after:string,start:bigint>"
_EDGE = r"[^\p{L}0-9]*"
_GLUED = r"^(?:[^\s=:@]*[=:])?"


def _candidates(text: Column) -> Column:
    """before, word, after, start of the words with a digit or an @, and the number groups that follow them.

    before and after are up to two words, on the same line.
    """
    pattern = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?: [0-9(][0-9().-]*+(?!\S))*+"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def around(both: Column) -> Column:
        before = lambda g: F.substring_index(F.substring_index(F.rtrim(g), "\n", -1), " ", -2)
        after = lambda g: F.substring_index(F.substring_index(F.ltrim(g), "\n", 1), " ", 2)
        return F.transform(both["m"], lambda m, i: _with(F.struct(F.get(both["g"], i).alias("l"), F.get(both["g"], i + 1).alias("r")), lambda g: F.struct(before(g["l"]).alias("before"), m.alias("word"), after(g["r"]).alias("after"), F.length(g["l"]).alias("gap"))))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        one = F.struct(x["before"], x["word"], x["after"], start.alias("start"))
        long = F.length(x["word"]) >= MIN_LENGTH  # the others can be no value
        return F.struct((start + F.length(x["word"])).alias("at"), F.when(long, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    paired = _with(F.struct(found.alias("m"), gaps.alias("g")), around)
    return F.when(text.rlike("[0-9@]"), _running(paired, CANDIDATE, step)).otherwise(F.array().cast(f"array<{CANDIDATE}>"))


def _plain(words: Column) -> Column:
    """Words as contexts: lower case, digits as 0."""
    return F.regexp_replace(F.lower(words), "[0-9]+", "0")


def _context(side: str, words: Column) -> Column:
    """A pattern's number, and that of its words on either side."""
    return F.struct(F.xxhash64(F.lit(side), words).alias("context"), F.xxhash64(words).alias("words"))


def candidates(rows: DataFrame) -> DataFrame:
    """row, value, start, end, base, seed, bad, contexts of the candidates of all documents.

    The value is what is left of a candidate without a joined label and
    punctuation around it.
    """
    at = rows.select("row", "spans", F.explode("candidates").alias("c"))
    label = F.regexp_extract("c.word", _GLUED, 0)
    rest = F.regexp_replace("c.word", _GLUED, "")
    core = F.regexp_replace(F.regexp_replace(rest, rf"^{_EDGE}+", ""), rf"(?<![^\p{{L}}0-9]){_EDGE}$", "")
    start = F.col("c.start") + F.length(label) + F.length(F.regexp_extract(rest, rf"^{_EDGE}+", 0))
    last, first = F.substring_index("c.before", " ", -1), F.substring_index("c.after", " ", 1)
    left = F.when(label != "", label).when(last.rlike(r"\p{L}"), last).when(F.col("c.before").contains(" "), F.col("c.before"))
    right = F.when(first.rlike(r"\p{L}"), first).when(F.col("c.after").contains(" "), F.col("c.after"))
    sides = F.array(*(F.when(side != "", _context(name, _plain(side))) for name, side in (("left", left), ("right", right))))
    out = at.select("row", "spans", F.array_compact(sides).alias("contexts"), core.alias("value"), start.alias("start"), (start + F.length(core)).alias("end")).where(rf"length(value) >= {MIN_LENGTH} and value rlike '[0-9@]'")
    over = F.exists("spans", lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("start")))
    covered = F.exists("spans", lambda s: (s["start"] <= F.col("start")) & (s["end"] >= F.col("end")))  # a base span may be part of a longer string
    digits, letters = F.length(F.regexp_replace("value", "[^0-9]", "")), F.length(F.regexp_replace("value", r"[^\p{L}]", ""))
    machine = F.col("value").rlike("^[A-Za-z0-9_+/-]{20,}=*$") & (digits >= 5) & (letters >= 5)
    failed = (letters == 0) & ((digits >= 13) | F.col("value").rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"))
    return out.select("row", F.xxhash64(F.lower("value")).alias("value"), "start", "end", (over & ~(machine & ~covered)).alias("base"), (over | machine).alias("seed"), (~over & failed).alias("bad"), "contexts")


def background(docs: DataFrame, pool: DataFrame) -> DataFrame:
    """words, total: how often the words of each context in ``pool`` (words) stand in all texts."""
    split = F.split(_plain(F.coalesce(F.col("text").cast("string"), F.lit(""))), r"\s+")

    def said(w: Column) -> Column:
        lone = F.transform(w, lambda t, i: F.when(~t.rlike(r"\p{L}"), F.array(F.concat_ws(" ", F.get(w, i - 1), t), F.concat_ws(" ", t, F.get(w, i + 1)))))
        labels = F.transform(F.filter(w, lambda t: t.contains("=") | t.contains(":")), lambda t: F.regexp_extract(t, _GLUED, 0))
        return F.concat(w, labels, F.flatten(F.filter(lone, lambda x: x.isNotNull())))

    small = pool.count() <= BROADCAST_ROWS
    words = docs.select(F.explode(_with(split, said)).alias("word")).select(F.xxhash64("word").alias("words"))
    if small:
        return words.join(F.broadcast(pool), "words", "left_semi").groupBy("words").agg(F.count("*").alias("total"))
    return words.groupBy("words").agg(F.count("*").alias("total")).join(pool, "words", "left_semi")


def patterns(edges: DataFrame, totals: DataFrame, rounds: int = ROUNDS, min_confidence: float = MIN_CONFIDENCE, min_support: int = MIN_SUPPORT) -> DataFrame:
    """context, confidence, support of the patterns that are accepted after the rounds.

    edges: context, words, value, n (occurrences), seed, bad; one for each
    distinct pattern and value. totals: words, total. What many values or
    patterns share is summed in parts before a shuffle.
    """
    known = cut(edges.join(totals, "words").select("context", "total", "value", "n", "seed", "bad"))
    accepted = None
    for _ in range(rounds):
        scored = known.withColumn("score", F.col("seed").cast("double"))
        if accepted is not None:
            doubt = known.join(accepted.select("context", "confidence"), "context").groupBy("value").agg(F.exp(F.sum(F.log1p(-F.least(F.lit(0.999), F.col("confidence"))))).alias("doubt"))
            scored = known.join(doubt, "value", "left").withColumn("score", F.when(F.col("bad"), 0.0).otherwise(F.greatest(F.col("seed").cast("double"), 1 - F.coalesce("doubt", F.lit(1.0)))))
        conf = scored.groupBy("context").agg((F.sum(F.col("n") * F.col("score")) / (F.max("total") + 1.0)).alias("confidence"), F.count_if(F.col("score") >= 0.5).alias("support"))
        accepted = cut(conf.where((F.col("confidence") >= min_confidence) & (F.col("support") >= min_support)))
    return accepted


def _found(docs: DataFrame, row: str, spans: str, words: str) -> DataFrame:
    """The documents, written, with a row number, their base spans and candidates."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return cut(docs.withColumn(row, F.monotonically_increasing_id()).withColumn(spans, base(text)).withColumn(words, _candidates(text)))


def discovered(rows: DataFrame, docs: DataFrame, rounds: int = ROUNDS, min_confidence: float = MIN_CONFIDENCE, min_support: int = MIN_SUPPORT) -> DataFrame:
    """row, added: the spans that the method adds; rows has row, spans, candidates of all ``docs``."""
    seen = cut(candidates(rows))
    at = seen.where("size(contexts) > 0").select("value", "seed", "bad", F.explode("contexts").alias("c")).select("value", "seed", "bad", "c.context", "c.words")
    edges = cut(at.groupBy("context", "words", "value").agg(F.count("*").alias("n"), F.bool_or("seed").alias("seed"), F.bool_and("bad").alias("bad")))
    pool = cut(edges.where("not bad").groupBy("context", "words").agg(F.count("*").alias("n")).where(F.col("n") >= min_support).select("words").distinct())
    accepted = patterns(edges, cut(background(docs, pool)), rounds, min_confidence, min_support).select("context")
    open_ = seen.where("not base and not bad and size(contexts) > 0").select("row", "start", "end", F.explode("contexts.context").alias("context"))
    span = F.struct(F.lit("id").alias("kind"), F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))
    added = cut(open_.join(accepted, "context", "left_semi").groupBy("row").agg(F.array_sort(F.collect_set(span)).alias("added")))
    return F.broadcast(added) if added.count() <= BROADCAST_ROWS else added


def extract(docs: DataFrame, rounds: int = ROUNDS, min_confidence: float = MIN_CONFIDENCE, min_support: int = MIN_SUPPORT) -> DataFrame:
    """row, doc_id, base, added: the base spans and those that the method adds."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = cut(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), base(text).alias("spans"), _candidates(text).alias("candidates")))
    added = discovered(rows, docs, rounds, min_confidence, min_support)
    return rows.select("row", "doc_id", F.col("spans").alias("base")).join(added, "row", "left").withColumn("added", F.coalesce("added", F.array().cast(SPAN)))


def _masked(text: Column, spans: Column) -> Column:
    """The text with the spans replaced by their kinds; overlapping ones together, by the first one's kind."""
    kind = "struct<from:bigint,start:bigint,end:bigint,kind:string>"
    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"])).otherwise(F.signum(b["end"] - a["end"])).cast("int"))

    def merge(acc: Column, s: Column) -> Column:
        one = F.struct(acc["at"].alias("from"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    def part(of: Column, start: Column, end: Column) -> Column:
        return F.substr(of, (start + 1).cast("int"), (end - start).cast("int"))

    def piece(chunk: Column) -> Column:
        # a step's own stretch of the text first, as each place is looked for from its start
        first = chunk[0]["from"]
        stretch = part(text, first, F.element_at(chunk, -1)["end"])
        return _with(stretch, lambda t: F.array_join(F.transform(chunk, lambda s: F.concat(part(t, s["from"] - first, s["start"] - first), F.lit("<"), F.upper(s["kind"]), F.lit(">"))), ""))

    def whole(kept: Column) -> Column:
        # the end of overlapping spans is where the next piece starts from, so it is read off the greatest end
        return F.concat(F.array_join(F.transform(_steps(kept), piece), ""), F.substr(text, (F.array_max(spans["end"]) + 1).cast("int"), F.length(text)))

    return _with(_running(ordered, kind, merge), whole)


def mask(docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind, such as <EMAIL>; all columns stay.

    Overlapping spans are replaced together, by the first one's kind. ``n_chars``,
    if there, is the new text's length; a null text stays null.
    """
    row, spans, words, added = unused(docs, "row", "spans", "candidates", "added")
    rows = _found(docs, row, spans, words)
    new = discovered(rows.select(F.col(row).alias("row"), F.col(spans).alias("spans"), F.col(words).alias("candidates")), rows)
    out = rows.drop(words).join(new.withColumnsRenamed({"row": row, "added": added}), row, "left").withColumn(spans, F.concat(spans, F.coalesce(added, F.array().cast(SPAN))))
    hit = F.size(spans) > 0
    out = out.withColumn("text", F.when(hit, _masked(F.col("text").cast("string"), F.col(spans))).otherwise(F.col("text").cast("string")).cast(docs.schema["text"].dataType))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of personal data in every document."""
    found = extract(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.concat("base", "added")).alias("spans"))

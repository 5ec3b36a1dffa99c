"""Rows whose own text shows that they are about their subject.

A subject's tokens are the words of its names that tell something: those that
are not generic, or all of them where every one is. Generic words come as a
list, by rarity over the texts themselves (``common_words``), or both. A text
is evidence if one of its words is a token, or if of two words with five
letters or more one begins the other. A text that names a place elsewhere
first counts only for a subject whose names hold that place too.

The tokens and their first five letters are two short arrays a subject, so a
text's words are looked up where they are and never leave their row. Where all
names have no more than ``BROADCAST`` characters the arrays go to every task and
texts stay where they are; beyond it subjects are dealt in copies, so a subject
with a third of all texts is no single task.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions.text import alias_key

SHORTEST = 3
STEM = 5
SALTS = 8
BROADCAST = 8_000_000


def words_of(text: Column) -> Column:
    """The distinct comparison words of a text; none of a null."""
    return F.coalesce(F.array_distinct(F.filter(F.split(alias_key(text), " "), lambda w: w != "")), F.array().cast("array<string>"))


def common_words(texts: DataFrame, share: float) -> DataFrame:
    """word: the words that at least such a share of the texts have."""
    total = texts.agg(F.count("*").alias("total"))
    counts = texts.select(F.explode(words_of(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(total), F.col("n") >= F.col("total") * share).select("word")  # one row


def subject_tokens(subjects: DataFrame, generic: DataFrame, never: list[str]) -> DataFrame:
    """subject, names, tokens, stems of the subjects (subject, names); words of ``never`` are tokens of none."""
    words = subjects.select("subject", F.explode("names").alias("name")).select("subject", F.explode(words_of(F.col("name"))).alias("word")).distinct()
    words = words.where((F.length("word") >= SHORTEST) & ~F.col("word").isin(*never))
    marked = words.join(generic.select("word", F.lit(True).alias("generic")), "word", "left")
    tokens = marked.groupBy("subject").agg(F.collect_set(F.when(F.col("generic").isNull(), F.col("word"))).alias("special"), F.collect_set("word").alias("all"))
    tokens = tokens.select("subject", F.when(F.size("special") > 0, F.col("special")).otherwise(F.col("all")).alias("tokens"))
    long = F.filter("tokens", lambda t: F.length(t) >= STEM)
    return subjects.join(tokens, "subject").select("subject", "names", "tokens", F.array_distinct(F.transform(long, lambda t: F.substring(t, 1, STEM))).alias("stems"))


def mentions(words: Column, tokens: Column, stems: Column) -> Column:
    """Whether words hold a token, or one that begins a token or begins with it (five letters at least)."""
    like = F.filter(words, lambda w: (F.length(w) >= STEM) & F.array_contains(stems, F.substring(w, 1, STEM)))
    begins = F.exists(like, lambda w: F.exists(tokens, lambda t: (F.length(t) >= STEM) & (F.startswith(w, t) | F.startswith(t, w))))
    return F.arrays_overlap(words, tokens) | begins


def text_evidence(texts: DataFrame, subjects: DataFrame, generic: DataFrame, never: list[str], elsewhere: list[str]) -> DataFrame:
    """id, subject, mentioned, far, kept of each text (id, subject, text) whose subject is known.

    ``far`` is the first place of ``elsewhere`` in the text (null without one or
    if the subject's names hold it). A null text mentions nothing; a subject
    without tokens is mentioned nowhere, and its texts are left out like those
    of unknown subjects.
    """
    t = subject_tokens(subjects, generic, never)
    size = subjects.select(F.aggregate("names", F.lit(0).cast("long"), lambda a, n: a + F.coalesce(F.length(n), F.lit(0))).alias("n")).agg(F.sum(F.coalesce("n", F.lit(0)) + 100)).first()[0] or 0
    if size <= BROADCAST:
        rows = texts.select("id", "subject", "text").join(F.broadcast(t), "subject")
    else:
        t = t.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = texts.select("id", "subject", "text", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("_salt")).join(t, ["subject", "_salt"])
    place = F.lit(None).cast("string")
    if elsewhere:
        place = F.nullif(F.regexp_extract("text", rf"(?<!\w)({'|'.join(map(re.escape, elsewhere))})(?!\w)", 1), F.lit(""))
    rows = rows.withColumn("_place", place).withColumn("far", F.when(~F.exists("names", lambda n: F.coalesce(F.contains(n, F.col("_place")), F.lit(False))), F.col("_place")))
    rows = rows.withColumn("mentioned", mentions(words_of(F.col("text")), F.col("tokens"), F.col("stems")))
    return rows.select("id", "subject", "mentioned", "far", (F.col("mentioned") & F.col("far").isNull()).alias("kept"))

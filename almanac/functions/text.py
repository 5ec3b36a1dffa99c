"""Text functions: comparison keys, word lists, codes, text-quality tests. All are Columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Street words and their short forms.
STREET_WORDS = [
    ("northeast", "ne"), ("northwest", "nw"), ("southeast", "se"), ("southwest", "sw"),
    ("north", "n"), ("south", "s"), ("east", "e"), ("west", "w"),
    ("street", "st"), ("avenue", "ave"), ("av", "ave"), ("boulevard", "blvd"), ("drive", "dr"),
    ("road", "rd"), ("lane", "ln"), ("court", "ct"), ("place", "pl"), ("parkway", "pkwy"),
    ("highway", "hwy"), ("circle", "cir"), ("terrace", "ter"), ("causeway", "cswy"), ("plaza", "plz"),
    ("u s", "us"), ("state road", "sr"), ("state rd", "sr"), ("county road", "cr"), ("county rd", "cr"),
    ("first", "1st"), ("second", "2nd"), ("third", "3rd"), ("fourth", "4th"), ("fifth", "5th"),
]


def _latin() -> tuple[str, str]:
    """Accented Latin letters and the letter that each decomposes to."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


LATIN, PLAIN = _latin()


def fold_accents(c: Column) -> Column:
    """Lower case, accents of Latin letters and combining marks dropped, curly quotes straight."""
    return F.lower(F.translate(F.regexp_replace(F.translate(c, "‘’", "''"), "[̀-ͯ]", ""), LATIN, PLAIN))


def name_key(c: Column) -> Column:
    """A name for comparison: "The Café & Bar" is "cafe and bar"."""
    c = F.regexp_replace(F.replace(fold_accents(c), F.lit("&"), F.lit(" and ")), "['’`]", "")
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(c, "[^a-z0-9]+", " ")), "^the\\s+", ""))


def alias_key(c: Column, by: str = " ") -> Column:
    """The key of an alias; unlike a name's key it keeps "the"."""
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.replace(fold_accents(c), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " ")), " ", by))


def slug(c: Column) -> Column:
    return alias_key(c, "-")


def addr_key(c: Column) -> Column:
    """A street address for comparison, without its suite or unit."""
    c = F.regexp_replace(F.regexp_replace(fold_accents(c), "#.*$", ""), "\\b(suite|ste|unit|apt)\\b.*$", "")
    c = F.trim(F.regexp_replace(c, "[^a-z0-9]+", " "))
    for word, short in STREET_WORDS:
        c = F.regexp_replace(c, rf"\b{word}\b", short)
    return F.coalesce(F.trim(F.regexp_replace(c, "\\s+", " ")), F.lit(""))


def street_key(c: Column) -> Column:
    """Struct of house number and street of the first part of an address; null without a number."""
    k = addr_key(F.split(c, ",")[0])
    number = F.regexp_extract(k, "^(\\d+[a-z]?)\\s+(.+)$", 1)
    return F.when(number != "", F.struct(number.alias("no"), F.regexp_extract(k, "^(\\d+[a-z]?)\\s+(.+)$", 2).alias("street")))


def url_key(c: Column) -> Column:
    """A URL's identity for comparison: no scheme, www, query or closing slash."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(c), "^https?://(www\\.)?", ""), "/+$", ""), "[?#].*$", "")


def norm_for_field(field: Column, value: Column) -> Column:
    """A value in the form in which two writings of one fact are equal."""
    digits = F.regexp_replace(value, "\\D", "")
    return (
        F.when(field == "phone", F.right(digits, F.lit(10)))
        .when(field == "address", addr_key(value))
        .when(field.isin("url", "booking_url", "tickets_url", "official_url", "source_url", "quote_source"), url_key(value))
        .otherwise(name_key(value))
    )


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.try_parse_url(url, F.lit("HOST")), "^www\\.", "")


def page_key(url: Column) -> Column:
    """Host without www, path without closing slash, query."""
    query = F.try_parse_url(url, F.lit("QUERY"))
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/+$", "")
    return F.concat(F.lower(host_of(url)), path, F.when(query.isNotNull(), F.concat(F.lit("?"), query)).otherwise(""))


def title_key(c: Column) -> Column:
    """A title without its year, "annual" and ordinals."""
    return F.trim(F.regexp_replace(F.regexp_replace(name_key(c), "\\b(20\\d\\d|annual|\\d+(st|nd|rd|th))\\b", " "), "\\s+", " "))


def shared_words(a: Column, b: Column) -> Column:
    """Struct of the number of shared distinct words and its share of the smaller set."""
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    n = F.size(F.array_intersect(x, y))
    return F.struct(n.alias("shared"), (n / F.least(F.size(x), F.size(y))).alias("ratio"))


def name_level(a: Column, b: Column, qualifiers: list[str]) -> Column:
    """3 the same, 2 the same words, 1 one holds the other and only qualifiers more, else 0."""
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    more = F.array_union(F.array_except(x, y), F.array_except(y, x))
    inside = (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)
    only = F.forall(more, lambda w: w.isin(*qualifiers))
    return F.when(a == b, 3).when(F.array_sort(x) == F.array_sort(y), 2).when(inside & only, 1).otherwise(0)


def search_terms(c: Column) -> Column:
    """Terms of a query: split on space and comma, punctuation at the edges dropped."""
    parts = F.transform(F.split(fold_accents(c), "[\\s,]+"), lambda t: F.regexp_replace(t, "^[^a-z0-9]+|[^a-z0-9]+$", ""))
    return F.filter(parts, lambda t: t != "")


def truncate_words(c: Column, n: int) -> Column:
    """At most n characters, cut at a word, with an ellipsis."""
    cut = F.regexp_replace(F.regexp_replace(F.substring(c, 1, n), "\\s+\\S*\\z", ""), "[,;:.\\s]+\\z", "")
    return F.when(F.length(c) <= n, c).otherwise(F.concat(cut, F.lit("…")))


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\\n\\s*\\n"), lambda p: F.trim(p)), lambda p: p != "")


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, "\\s+"), lambda w: w != ""))


def initials(c: Column) -> Column:
    """First letters of the first two words, upper case."""
    return F.upper(F.array_join(F.transform(F.slice(F.filter(F.split(c, "[^\\p{L}0-9]+"), lambda w: w != ""), 1, 2), lambda w: F.substring(w, 1, 1)), ""))


def plain_text(html: Column) -> Column:
    """Text of an HTML string: tags dropped, the common references decoded, one space."""
    c = F.regexp_replace(html, "(?s)<(script|style)\\b.*?</\\1>", " ")
    c = F.regexp_replace(c, "(?s)<!--.*?-->|<[^>]*>", " ")
    for ref, to in (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        c = F.replace(c, F.lit(ref), F.lit(to))
    return F.trim(F.regexp_replace(c, "\\s+", " "))


def match_spans(text: Column, terms: Column) -> Column:
    """Array of (start, length) of each term's first match in the text, in order."""
    spans = lambda folded: F.array_sort(F.filter(F.transform(terms, lambda t: F.struct(F.instr(folded, t).alias("start"), F.length(t).alias("length"))), lambda s: s["start"] > 0))
    return F.transform(F.array(fold_accents(text)), spans)[0]  # the text is folded once


def share_code(c: Column) -> Column:
    """FNV-1a (32 bits) of the UTF-8 bytes, modulo 36**5, five digits of base 36."""
    raw = F.hex(F.encode(c, "utf-8"))
    at = F.sequence(F.lit(1), F.length(raw), F.lit(2))
    byte = lambda i: F.conv(F.substr(raw, i, F.lit(2)), 16, 10).cast("bigint")
    h = F.aggregate(at, F.lit(2166136261).cast("bigint"), lambda acc, i: (acc.bitwiseXOR(byte(i)) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))
    h = F.when(F.length(c) == 0, F.lit(2166136261).cast("bigint")).otherwise(h)
    return F.lpad(F.lower(F.conv((h % F.lit(36**5)).cast("string"), 10, 36)), 5, "0")


def hash8(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 8)


def first_year(c: Column) -> Column:
    """First number of four digits, else 9999."""
    return F.coalesce(F.nullif(F.regexp_extract(c, "(\\d{4})", 1), F.lit("")).cast("int"), F.lit(9999))


def year_numeral(c: Column) -> Column:
    """The year if the text is no more than a year, a range or "c. 1855"."""
    return F.nullif(F.regexp_extract(c, "^(?:c\\.\\s*)?(\\d{4})(?:\\s*[-–]\\s*(?:\\d{2,4}))?$", 1), F.lit("")).cast("int")


# Words of an estimate.
GUESSES = "(?i)\\b(about|approx\\.|approximately|approx|around|roughly|estimated|estimate|probably|likely|call for|or so|guessed|guess)\\b|~"


def guess_words(c: Column) -> Column:
    return c.rlike(GUESSES)


def placeholder(c: Column) -> Column:
    return c.rlike("(?i)\\b(tbd|tba|todo|lorem ipsum|n/a|xxx)\\b")


def html_in_text(c: Column) -> Column:
    return c.rlike("<[a-zA-Z/!][^>]*>|&[a-z]+;|&#\\d+;")


# Abbreviations whose full stop ends no sentence (and single capitals).
ABBREVIATIONS = ["St", "Ste", "Ft", "Mt", "Dr", "Mr", "Mrs", "Ms", "Jr", "Sr", "No", "Ave", "Blvd", "Rd", "U\\.S", "Inc", "Co", "vs", "Pt", "[A-Z]"]


def first_sentence(c: Column) -> Column:
    """Up to the first end mark before a space and a capital or digit, unless an abbreviation stands before it."""
    end = f'(?s)^(.*?(?<!(?:^|[\\s("“])(?:{"|".join(ABBREVIATIONS)}))[.!?])(?=\\s+["“(]?[A-Z0-9])'
    return F.coalesce(F.nullif(F.regexp_extract(c, end, 1), F.lit("")), c)


def license_class(c: Column) -> Column:
    """Accepted licence class of a licence line, or the reason why not."""
    k = F.lower(c)
    return (
        F.when(k.isNull() | (F.trim(k) == ""), "rejected: none")
        .when(k.rlike("\\bnc\\b|non-?commercial"), "rejected: non-commercial")
        .when(k.rlike("\\bnd\\b|no-?deriv"), "rejected: no derivatives")
        .when(k.rlike("public domain|cc0|\\bpd\\b"), "public-domain")
        .when(k.rlike("cc[ -]by[ -]sa|share-?alike"), "cc-by-sa")
        .when(k.rlike("cc[ -]by|attribution"), "cc-by")
        .otherwise("rejected: unknown")
    )

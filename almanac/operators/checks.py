"""Data-quality checks generated from a spec; each finding is a row.

A finding is (collection, record_id, field, level, message). A spec maps a
field to a dict of rules: type, req, enum, max, kind (id, url, date, time), text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions.text import html_in_text, placeholder

FINDING = "collection string, record_id string, field string, level string, message string"

PATTERNS = {
    "id": "^[a-z0-9][a-z0-9-]*$",
    "url": "^https://[^\\s/]+\\.[^\\s]+$",
    "date": "^\\d{4}-\\d{2}-\\d{2}$",
    "time": "^([01]\\d|2[0-3]):[0-5]\\d$",
}


def field_rules(field: str, rules: dict) -> list[tuple[Column, str, str]]:
    """(condition of a finding, level, message) for a field."""
    c = F.col(field)
    s = c.cast("string")
    out: list[tuple[Column, str, str]] = []
    if rules.get("req"):
        out.append((c.isNull(), "error", "required"))
    if rules.get("text"):
        out += [(F.trim(s) == "", "error", "blank"), (s != F.trim(s), "warning", "white space at an edge"), (placeholder(s), "warning", "placeholder"), (html_in_text(s), "error", "HTML in text")]
    if rules.get("enum"):
        out.append((~s.isin(*map(str, rules["enum"])), "error", "not in the vocabulary"))
    if rules.get("kind"):
        out.append((~s.rlike(PATTERNS[rules["kind"]]), "error", f"not a {rules['kind']}"))
        if rules["kind"] == "date":
            out.append((s.rlike(PATTERNS["date"]) & F.expr(f"try_to_date(cast({field} as string), 'yyyy-MM-dd') is null"), "error", "no such day"))
    if rules.get("max"):
        out.append((F.length(s) > rules["max"], "warning", "too long"))
    return out


def findings(df: DataFrame, collection: str, id_: str, rules: list[tuple[Column, str, str, str]]) -> DataFrame:
    """Rows of (condition, level, message, field) that hold, in one pass over the records."""
    hits = F.array(*(F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(field).alias("field"), F.lit(level).alias("level"), F.lit(message).alias("message"))) for cond, level, message, field in rules))
    return df.select(F.lit(collection).alias("collection"), F.col(id_).cast("string").alias("record_id"), F.explode(F.array_compact(hits)).alias("f")).select("collection", "record_id", "f.*")


def check_spec(df: DataFrame, collection: str, id_: str, spec: dict[str, dict]) -> DataFrame:
    return findings(df, collection, id_, [(cond, level, message, f) for f, r in spec.items() for cond, level, message in field_rules(f, r)])


def check_unique(df: DataFrame, collection: str, id_: str) -> DataFrame:
    dup = df.groupBy(F.col(id_).cast("string").alias("record_id")).agg(F.count("*").alias("n")).where("n > 1")
    return dup.select(F.lit(collection).alias("collection"), "record_id", F.lit(id_).alias("field"), F.lit("error").alias("level"), F.concat(F.lit("used "), F.col("n").cast("string"), F.lit(" times")).alias("message"))


def unknown_keys(lines: DataFrame, json: str, id_: str, known: list[str]) -> DataFrame:
    """id, key of JSON objects' keys that the schema does not have."""
    keys = F.expr(f"json_object_keys({json})")
    return lines.select(id_, F.explode(keys).alias("key")).where(~F.col("key").isin(*known, "notes"))


def check_partition(families: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """value, problem: values in no family or in several, and family values outside the vocabulary."""
    n = families.groupBy("value").agg(F.countDistinct("family").alias("n"))
    missing = vocabulary.join(n, "value", "left_anti").select("value", F.lit("in no family").alias("problem"))
    several = n.where("n > 1").select("value", F.lit("in several families").alias("problem"))
    unknown = n.join(vocabulary, "value", "left_anti").select("value", F.lit("unknown value").alias("problem"))
    return missing.unionByName(several).unionByName(unknown)


def severity_gate(found: DataFrame) -> DataFrame:
    """level, message, n."""
    return found.groupBy("level", "message").agg(F.count("*").alias("n"))


class GateError(RuntimeError):
    pass


def require_no_errors(found: DataFrame) -> None:
    """Raise if there is an error; the message names a few."""
    some = found.where("level = 'error'").limit(5).collect()
    if some:
        raise GateError("; ".join(f"{r.collection} {r.record_id} {r.field}: {r.message}" for r in some))

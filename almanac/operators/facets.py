"""Faceted filters from a state, text filters, canonical query strings, facet counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions.text import fold_accents

Test = Callable[[object], Column]


def facet_filter(spec: dict[str, tuple[str, str]], state: dict, tests: dict[str, Test] | None = None) -> Column:
    """A condition from a state. spec: key -> (kind, column); kinds list, one, bool, text.

    A list key asks for any of its values; keys are joined by and; keys without
    a value, or not in the spec, are skipped. tests override a key's condition.
    """
    out = F.lit(True)
    for key, value in state.items():
        if value in (None, "", [], False):
            continue
        if tests and key in tests:
            out &= tests[key](value)
        elif key in spec:
            kind, column = spec[key]
            c = F.col(column)
            if kind == "list":
                out &= F.arrays_overlap(c, F.array(*map(F.lit, value)))
            elif kind == "one":
                out &= c.isin(*value) if isinstance(value, (list, tuple)) else c == value
            elif kind == "bool":
                out &= F.coalesce(c, F.lit(False))
            elif kind == "text":
                out &= text_all_terms(fold_accents(c), str(value))
    return F.coalesce(out, F.lit(False))


def text_all_terms(normal: Column, query: str) -> Column:
    """Whether every term of a query, split on white space, is in a normalised text."""
    out = F.lit(True)
    for term in query.lower().split():
        out &= F.contains(normal, F.lit(term))
    return out


def active_filters(spec: dict[str, str], state: Column) -> Column:
    """Number of keys of a map column that differ from the spec's defaults."""
    return sum((F.coalesce(state[k] != d, F.lit(False)).cast("int") for k, d in spec.items()), F.lit(0))


def canonical_query(url: Column, spec: dict[str, tuple[str, str | None, list[str] | None]]) -> Column:
    """The URL's query with known keys only, in the spec's order.

    spec: key -> (kind, default, allowed values or None). Lists are split on
    commas, deduplicated and sorted; invalid values and defaults are left out.
    """
    said = F.str_to_map(F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit("")), F.lit("&"), F.lit("="))
    parts = []
    for key, (kind, default, allowed) in spec.items():
        v = F.element_at(said, F.lit(key))
        if kind == "list":
            values = F.array_distinct(F.split(v, ","))
            values = F.filter(values, lambda x: x.isin(*allowed)) if allowed else F.filter(values, lambda x: x != "")
            v = F.array_join(F.array_sort(values), ",")
        elif allowed:
            v = F.when(v.isin(*allowed), v)
        bad = v.isNull() | (v == "")
        parts.append(F.when(~(bad | (v == default) if default else bad), F.concat(F.lit(f"{key}="), v)))
    return F.concat_ws("&", *parts)


def facet_counts(df: DataFrame, facets: dict[str, Column], id_: str) -> DataFrame:
    """facet, value, n (distinct ids) for several facets in one pass; arrays count each value."""
    pairs = F.flatten(F.array(*(_named(f, c) for f, c in facets.items())))
    return df.select(id_, F.explode(pairs).alias("p")).groupBy(F.col("p.facet").alias("facet"), F.col("p.value").alias("value")).agg(F.countDistinct(id_).alias("n"))


def _named(facet: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(facet).alias("facet"), v.alias("value")))

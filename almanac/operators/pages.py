"""Audits of raw web pages: links, anchors, structure, sizes. Built-in functions only, but for gzip sizes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def links(pages: DataFrame, id_: str = "page_id", html: str = "html") -> DataFrame:
    """id, href of all links of all pages, in place order with ``pos``."""
    found = F.regexp_extract_all(html, F.lit(r"(?i)<a\s[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))
    return pages.select(id_, F.posexplode(found).alias("pos", "href"))


def anchors(pages: DataFrame, id_: str = "page_id", html: str = "html") -> DataFrame:
    """id, anchor: the id attributes of all pages."""
    return pages.select(id_, F.explode(F.regexp_extract_all(html, F.lit(r"(?i)\sid\s*=\s*[\"']([^\"']+)[\"']"), F.lit(1))).alias("anchor"))


def resolve(href: Column, base: Column) -> Column:
    """Root-relative path of a link on a page: no query or fragment, . and .. worked out."""
    path = F.regexp_replace(href, "[?#].*$", "")
    folder = F.regexp_replace(base, "[^/]*$", "")
    full = F.when(F.startswith(path, F.lit("/")), path).when(path == "", base).otherwise(F.concat(folder, path))
    parts = F.split(full, "/")
    keep = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))).when(p == ".", acc).otherwise(F.concat(acc, F.array(p))),
    )
    return F.array_join(keep, "/")


def climbs(href: Column, base: Column) -> Column:
    """Whether a link goes above the root."""
    up = F.size(F.split(F.regexp_replace(href, "[?#].*$", ""), "\\.\\./", -1)) - 1
    depth = F.size(F.split(F.regexp_replace(base, "[^/]*$", ""), "/")) - 2
    return up > depth


def link_check(found: DataFrame, targets: DataFrame, known_anchors: DataFrame | None = None) -> DataFrame:
    """id, href, problem of links (id, href, path, anchor) to a page or anchor that is not there."""
    missing = found.join(targets.select("path").distinct(), "path", "left_anti").select("page_id", "href", F.lit("no such page").alias("problem"))
    if known_anchors is None:
        return missing
    there = found.where("anchor is not null and anchor <> ''").join(targets.select("path").distinct(), "path", "left_semi")
    lost = there.join(known_anchors.select("path", "anchor").distinct(), ["path", "anchor"], "left_anti").select("page_id", "href", F.lit("no such anchor").alias("problem"))
    return missing.unionByName(lost)


def page_audit(pages: DataFrame, id_: str = "page_id", html: str = "html") -> DataFrame:
    """id, problem: a row for each rule that a page breaks."""
    h = F.col(html)
    count = lambda p: F.size(F.regexp_extract_all(h, F.lit(p), F.lit(0)))
    ids = F.regexp_extract_all(h, F.lit(r"(?i)\sid\s*=\s*[\"']([^\"']+)[\"']"), F.lit(1))
    imgs = F.regexp_extract_all(h, F.lit(r"(?i)<img\b[^>]*>"), F.lit(0))
    rules = [
        (count(r"(?i)<h1[\s>]") != 1, "not exactly one h1"),
        (F.size(ids) != F.size(F.array_distinct(ids)), "duplicate id"),
        (~h.rlike(r"(?is)<title[^>]*>\s*\S"), "no title"),
        (~h.rlike(r"(?i)<meta\s[^>]*name\s*=\s*[\"']description"), "no description"),
        (~h.rlike(r"(?i)<link\s[^>]*rel\s*=\s*[\"']canonical"), "no canonical"),
        (F.exists(imgs, lambda i: ~i.rlike(r"(?i)\salt\s*=")), "image without alt"),
        (F.exists(imgs, lambda i: ~(i.rlike(r"(?i)\swidth\s*=") & i.rlike(r"(?i)\sheight\s*="))), "image without size"),
        (h.rlike(r"(?i)\b(href|src)\s*=\s*[\"']http://"), "insecure link"),
        (h.rlike(r"(?i)<script\s[^>]*src\s*=\s*[\"']https?://"), "third-party script"),
    ]
    return pages.select(id_, F.explode(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), m) for c, m in rules)))).alias("problem"))


@F.pandas_udf(T.LongType())
def gzip_size(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Bytes of a text in gzip."""
    for s in texts:
        yield s.map(lambda v: len(zlib.compress((v or "").encode(), 6)) + 12)


def size_budget(pages: DataFrame, raw: int, packed: int, id_: str = "page_id", html: str = "html") -> DataFrame:
    """id, raw and gzip bytes, over: what exceeds a budget."""
    sized = pages.select(id_, F.octet_length(html).cast("long").alias("raw"), gzip_size(F.col(html)).alias("gzip"))
    return sized.withColumn("over", F.when(F.col("raw") > raw, "raw").when(F.col("gzip") > packed, "gzip"))

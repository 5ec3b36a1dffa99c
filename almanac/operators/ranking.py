"""Orders, first and top rows, diverse picks. Every order ends in a unique column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.sources.shared import written


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def top_n_per_group(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group, with their rank and the group's full count."""
    w = Window.partitionBy(*keys)
    return df.withColumn("total", F.count("*").over(w)).withColumn("rank", F.row_number().over(w.orderBy(*order))).where(F.col("rank") <= n)


def diverse_top_n(df: DataFrame, keys: list[str], family: str, special: Column, order: list, n: int) -> DataFrame:
    """Special rows one a family, other special ones, then one a family of the rest, then the rest; n a group."""
    marked = df.withColumn("_special", special)
    one = F.row_number().over(Window.partitionBy(*keys, family, "_special").orderBy(*order))
    # a family that a special row stands for already does not come first again
    seen = F.max(F.col("_special").cast("int")).over(Window.partitionBy(*keys, family)) == 1
    pass_ = F.when(F.col("_special") & (one == 1), 1).when(F.col("_special"), 2).when((one == 1) & ~seen, 3).otherwise(4)
    ranked = marked.withColumn("step", pass_)
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("step", *order))).where(F.col("rank") <= n).drop("_special")


def spread_picks(df: DataFrame, group: str, area: str, leads: Column, open_: Column, order: list, features: Column, n: int = 6, lead: int = 2) -> DataFrame:
    """group, area, id, step: up to two leading rows of a group by an order, then one open row of each area, six in all.

    Areas come by their number of rows, then by name; of an area the row with
    most features, then by the order, that is no leading one. An area without
    such a row is passed over.
    """
    by = Window.partitionBy(group)
    first = F.row_number().over(Window.partitionBy(group, F.col("_leads")).orderBy(*order))
    rows = df.withColumn("_size", F.count("*").over(Window.partitionBy(group, area))).withColumn("_leads", F.coalesce(leads, F.lit(False))).withColumn("_first", first)
    rows = rows.withColumn("_lead", F.col("_leads") & (F.col("_first") <= lead)).where(F.col("_lead") | open_)
    best = F.row_number().over(Window.partitionBy(group, area, "_lead").orderBy(F.desc(features), *order))
    rows = rows.withColumn("_best", best).where("_lead or _best = 1")
    place = F.row_number().over(by.orderBy(F.desc("_lead"), F.when(F.col("_lead"), F.col("_first")), F.desc("_size"), area, *order))
    return rows.withColumn("step", place).where(F.col("step") <= n).select(group, area, "id", "step")


def vocab_order(c: Column, words: list[str]) -> Column:
    """Place in a fixed list, 99 if not in it."""
    at = F.array_position(F.array(*map(F.lit, words)), c)
    return F.when(at == 0, 99).otherwise(at).cast("bigint")


def name_sort_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "^the\\s+", "")


def numbered(df: DataFrame, order: list, keep: Column) -> DataFrame:
    """The frame with ``number``: 1.. over the rows to keep, null for the others.

    Rows are range-partitioned by the order; each partition's count is added up
    and its rows are numbered within, so no task gets all rows.
    """
    # written once, as each run of a range partitioning may cut the ranges elsewhere
    parts = written(df.withColumn("_keep", keep).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = parts.groupBy("_part").agg(F.count_if("_keep").alias("_c"))
    before = counts.select("_part", (F.sum("_c").over(Window.orderBy("_part")) - F.col("_c")).alias("_before"))  # a row for each partition
    inside = F.sum(F.col("_keep").cast("long")).over(Window.partitionBy("_part").orderBy(*order))
    return parts.join(F.broadcast(before), "_part").withColumn("number", F.when(F.col("_keep"), F.col("_before") + inside)).drop("_keep", "_part", "_before")


def suffix_duplicates(df: DataFrame, label: str, order: list) -> DataFrame:
    """Repeated labels get (2), (3) and so on."""
    n = F.row_number().over(Window.partitionBy(label).orderBy(*order))
    return df.withColumn("shown", F.when(n == 1, F.col(label)).otherwise(F.concat(F.col(label), F.lit(" ("), n.cast("string"), F.lit(")"))))

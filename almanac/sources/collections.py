"""Reading collections and slices of records; publishing behind a gate."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanac.operators.checks import require_no_errors


def read_collection(spark: SparkSession, path: str, schema: T.StructType, required: bool = False) -> DataFrame:
    """Records of a JSON array file; lines that do not parse are kept in ``_corrupt_record``.

    A missing optional file is an empty collection; a required one must be there and have rows.
    """
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    try:
        df = spark.read.schema(full).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
        empty = required and df.isEmpty()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) or required:
            raise
        return spark.createDataFrame([], full)
    if empty:
        raise ValueError(f"{path} has no records")
    return df


def read_slices(spark: SparkSession, path: str, records: T.StructType, expected: list[str], allow_missing: bool = False) -> DataFrame:
    """slice, checked, collection, record (JSON), problem: a row a record of all slice bundles."""
    schema = T.StructType([T.StructField("slice", T.StringType()), T.StructField("checked", T.StringType()), T.StructField("records", T.MapType(T.StringType(), T.ArrayType(T.StringType())))])
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    have = spark.createDataFrame([(s,) for s in expected], "slice string").join(df.select("slice"), "slice", "left_anti")
    if not allow_missing and (gone := [r["slice"] for r in have.limit(20).collect()]):
        raise ValueError(f"missing slices: {', '.join(sorted(gone))}")
    known = [f.name for f in records.fields]
    each = df.select("slice", "checked", F.explode("records").alias("collection", "list")).select("slice", "checked", "collection", F.explode("list").alias("record"))
    id_ = F.get_json_object("record", "$.id")
    return each.withColumn("problem", F.when(~F.col("collection").isin(*known), "unknown collection").when(id_.isNull(), "no id"))


def unwrap_records(df: DataFrame, name: str) -> DataFrame:
    """A list, {records: {name: [...]}} or {name: [...]} as the same rows."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    if "records" in fields:
        return df.select(F.explode(F.col("records")[name]).alias("r")).select("r.*")
    if name in fields and isinstance(fields[name], T.ArrayType):
        return df.select(F.explode(name).alias("r")).select("r.*")
    return df


def write_collections(collections: dict[str, DataFrame], folder: str, fields: dict[str, list[str]], form: str = "parquet") -> None:
    """Each collection sorted by id, in its schema's field order; fields that the schema has not follow by name.

    ``form`` is parquet or json: a record a line, nulls left out, so that equal
    collections give equal lines in equal order.
    """
    for name, df in collections.items():
        known = [c for c in fields.get(name, df.columns) if c in df.columns]
        own = df.select(*known, *sorted(set(df.columns) - set(known)))
        own.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").format(form).save(f"{folder}/{name}")


def gated_publish(df: DataFrame, staging: str, target: str, check: Callable[[DataFrame], DataFrame]) -> None:
    """Write to staging, check what was written, and swap it with the target if no error is found.

    The target's folder is renamed aside and staging renamed into its place. A
    failed check leaves the target as it was, a refused rename puts it back.
    Between the two renames there is no target for a moment; a driver lost then
    leaves the old table whole as ``<target>.before-...``. Both paths are on one
    file system, whose renames are atomic (object stores' are not).
    """
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(staging)
    require_no_errors(check(spark.read.parquet(staging)))
    path = spark._jvm.org.apache.hadoop.fs.Path
    made, public, aside = path(staging), path(target), path(f"{target}.before-{uuid.uuid4().hex}")
    files = public.getFileSystem(spark._jsc.hadoopConfiguration())
    had = files.exists(public)
    if had and not files.rename(public, aside):
        raise OSError(f"{target} can't be moved aside")
    if not files.rename(made, public):
        if had:
            files.rename(aside, public)
        raise OSError(f"{staging} can't be moved to {target}")
    if had:
        files.delete(aside, True)

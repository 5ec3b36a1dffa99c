"""Small things that the operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset (a local test), a temporary folder takes its place.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            where = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        sc.setCheckpointDir(where)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def content_key() -> Column:
    """A hash of a document's id and text: rows with equal ones are the same document."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def hashed_sample(df: DataFrame, key: Column, n: int, total: int) -> DataFrame:
    """About the n rows of the least key hashes, n at most; total is the number of rows.

    A share of the hashes is cut out first, so that what tasks send to the
    driver is bounded by n and not by n times the tasks.
    """
    share = min(1.0, (1.5 * n + 100) / max(total, 1))
    h = F.xxhash64(key)
    cut_out = df if share == 1.0 else df.where(F.pmod(h, F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    return cut_out.orderBy(h, key).limit(n)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that the table has not (case does not tell them apart)."""
    taken = {c.lower() for c in df.columns}
    return [next(c for k in range(len(taken) + 1) if (c := f"_{name}{k}") not in taken) for name in names]


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables in the shared folder that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

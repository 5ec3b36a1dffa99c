"""Registration of queries with their SQL twins, and the stand-in tables they run on.

The listings' places, stays, dated events and occurrences are derived from the
star-schema tables by the same expressions in Spark and in the SQL twins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

Load = Callable[[str], DataFrame]


def query(sql: str | None = None, name: str | None = None):
    """Register a function of a loader (table name -> DataFrame) as a query."""

    def register(f: Callable[[Load], DataFrame]):
        key = name or f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = key, f.__doc__
        QUERIES[key] = run
        if sql:
            ORACLES[key] = with_inputs(sql)
        return f

    return register


LAT = "27.0 + ({n} * 37 % 19) / 10.0D + ({k} * 7919 % 500) / 10000.0D"
LNG = "-82.9D + ({n} * 53 % 14) / 10.0D + ({k} * 104729 % 487) / 10000.0D"
MINUTE = "lpad(cast(floor(({m}) / 60) as string), 2, '0') || ':' || lpad(cast(({m}) % 60 as string), 2, '0')"


class Tables:
    """Parquet tables by name; places, stays, happenings and occurrences are derived."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        own = getattr(self, name, None)
        return own() if own else self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def places(self) -> DataFrame:
        n, k = "c_nationkey", "c_custkey"
        return self("customer").selectExpr("c_custkey as id", "c_name as name", "c_mktsegment as kind", "c_nationkey as area", f"{LAT.format(n=n, k=k)} as lat", f"{LNG.format(n=n, k=k)} as lng", "c_acctbal as score")

    def stays(self) -> DataFrame:
        n, k = "s_nationkey", "s_suppkey"
        return self("supplier").selectExpr("s_suppkey as id", "s_name as name", "s_nationkey as area", f"{LAT.format(n=n, k=k)} as lat", f"{LNG.format(n=n, k=k)} as lng")

    def happenings(self) -> DataFrame:
        return self("orders").selectExpr(
            "o_orderkey as id",
            "o_orderpriority as kind",
            "o_custkey as place",
            "o_orderkey % 40 as series",
            "to_date(o_orderdate) as date",
            "date_add(to_date(o_orderdate), cast(o_orderkey % 21 as int)) as end_date",
            f"case when o_orderkey % 7 <> 0 then {MINUTE.format(m='o_orderkey * 13 % 1440')} end as start",
            f"case when o_orderkey % 5 <> 0 then {MINUTE.format(m='o_orderkey * 29 % 1440')} end as end",
            "o_orderkey % 11 = 0 as all_day",
            "case o_orderstatus when 'F' then 'scheduled' when 'O' then 'tentative' else 'cancelled' end as status",
            "o_orderkey % 17 = 0 as featured",
            "o_totalprice as price",
        )

    def occurrences(self) -> DataFrame:
        """Dated repeats of a happening: its date and 7 days for each line number."""
        days = self("lineitem").select("l_orderkey", "l_linenumber").distinct()
        return days.join(self("orders"), F.col("l_orderkey") == F.col("o_orderkey")).selectExpr("o_orderkey as id", "date_add(to_date(o_orderdate), 7 * l_linenumber) as date").distinct()


_SQL_LAT = "27.0 + ({n} * 37 % 19) / 10.0::DOUBLE + ({k} * 7919 % 500) / 10000.0::DOUBLE"
_SQL_LNG = "-82.9::DOUBLE + ({n} * 53 % 14) / 10.0::DOUBLE + ({k} * 104729 % 487) / 10000.0::DOUBLE"
_SQL_MINUTE = "lpad(CAST(({m}) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(({m}) % 60 AS VARCHAR), 2, '0')"

INPUTS = {
    "places": f"SELECT c_custkey AS id, c_name AS name, c_mktsegment AS kind, c_nationkey AS area, {_SQL_LAT.format(n='c_nationkey', k='c_custkey')} AS lat, {_SQL_LNG.format(n='c_nationkey', k='c_custkey')} AS lng, c_acctbal AS score FROM customer",
    "stays": f"SELECT s_suppkey AS id, s_name AS name, s_nationkey AS area, {_SQL_LAT.format(n='s_nationkey', k='s_suppkey')} AS lat, {_SQL_LNG.format(n='s_nationkey', k='s_suppkey')} AS lng FROM supplier",
    "happenings": f"""SELECT o_orderkey AS id, o_orderpriority AS kind, o_custkey AS place, o_orderkey % 40 AS series, CAST(o_orderdate AS DATE) AS date,
        CAST(o_orderdate AS DATE) + CAST(o_orderkey % 21 AS INTEGER) AS end_date,
        CASE WHEN o_orderkey % 7 <> 0 THEN {_SQL_MINUTE.format(m='o_orderkey * 13 % 1440')} END AS start,
        CASE WHEN o_orderkey % 5 <> 0 THEN {_SQL_MINUTE.format(m='o_orderkey * 29 % 1440')} END AS "end",
        o_orderkey % 11 = 0 AS all_day, CASE o_orderstatus WHEN 'F' THEN 'scheduled' WHEN 'O' THEN 'tentative' ELSE 'cancelled' END AS status,
        o_orderkey % 17 = 0 AS featured, o_totalprice AS price FROM orders""",
    "occurrences": "SELECT DISTINCT o_orderkey AS id, CAST(o_orderdate AS DATE) + 7 * l_linenumber AS date FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    # days of a happening: each day of a run of up to 14 days, the first one only of a longer one
    "instances": """SELECT id, kind, place, status, featured, start, "end", all_day, CAST(d AS DATE) AS date, date AS first_date, end_date, date_diff('day', date, end_date) > 13 AS run
        FROM (SELECT *, unnest(generate_series(date, CASE WHEN date_diff('day', date, end_date) > 13 THEN date ELSE end_date END, INTERVAL 1 DAY)) AS d FROM happenings)""",
}
_NEEDS = {"instances": ["happenings"]}

#: Great-circle metres in SQL.
METRES = "(2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lng - {a}.lng) / 2), 2)))))"


def with_inputs(sql: str) -> str:
    """Put the stand-in tables that a statement names before it, as CTEs."""
    import re

    used: list[str] = []

    def need(name: str) -> None:
        for other in _NEEDS.get(name, []):
            need(other)
        if name not in used:
            used.append(name)

    for name in INPUTS:
        if re.search(rf"\b(from|join|,)\s+{name}\b", sql, re.I):
            need(name)
    if not used:
        return sql
    ctes = ",\n".join(f"{n} AS ({INPUTS[n]})" for n in used)
    body = sql.strip()
    if own := re.match(r"with\b(\s+recursive\b)?", body, re.I):
        return f"WITH{own[1] or ''} {ctes},\n{body[own.end() :]}"
    return f"WITH {ctes}\n{body}"

"""Centroid clustering on whole numbers with scalar lookup tables.

A component x is the whole number floor(256 * x). In each round a task takes a
batch and, for each dimension, tabulates the squared difference between every
integer value that occurs there and every centroid; a distance is then a sum of
table entries, gathered by each vector's value codes. All sums are exact, so
neither the order of tasks nor a retry changes a centroid, and ties go to the
smaller number. A task holds one batch and its tables; it gives each centroid's
count, sums and inertia, in 32-bit parts that Spark adds (``vectors.parts``), so
no vector moves and a crowded cluster is as cheap as an empty one. The driver
holds the centroids only. Rounds depend on rereading the table, not on lineage:
a lost executor costs its tasks.

Defined results: a vector that is null, has another length, or holds null or
non-finite entries is left out; equal vectors each get a row; where several rows
have an id (or none: its hash is that of "2:null"), equal hashes are ordered by
the vector; fewer vectors than centroids make fewer centroids; a distance or
inertia that does not fit a long is null, sums stay exact; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm.common import table
from almanac.llm.vectors import LONG, PARTS, floors, numbers, parts, totals, whole

DIMS = 64
SCALE = 256
CENTROIDS = 40
ROUNDS = 5
SALT = "2"

#: Values up to so many bits keep a distance of DIMS squared differences in a long.
_BITS = 27
_COUNT, _INERTIA = -1, -2


def first_centroids(vectors: DataFrame, k: int = CENTROIDS) -> np.ndarray:
    """The k vectors with the least hashes of their ids."""
    hashed = F.sha2(F.concat(F.lit(f"{SALT}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    usable = (F.size("vector") == DIMS) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(usable).orderBy(hashed, "vector").limit(k).select("vector").collect()
    return floors(np.array([r[0] for r in rows], float).reshape(len(rows), DIMS), SCALE, _BITS)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances (rows x centroids) by lookup."""
    kind = np.int64 if x.dtype == centroids.dtype == np.int64 else object
    out = np.zeros((len(centroids), len(x)), kind)
    for d in range(x.shape[1]):
        value, code = np.unique(x[:, d], return_inverse=True)
        squares = (centroids[:, d, None].astype(kind) - value.astype(kind)[None, :]) ** 2
        for k in range(len(centroids)):
            out[k] += squares[k].take(code)
    return out.T


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each row's nearest centroid, the first of equally near ones."""
    all_of_them = distances(x, centroids)
    number = all_of_them.argmin(axis=1)
    return number, all_of_them[np.arange(len(x)), number]


def summed(vectors: DataFrame, centroids: np.ndarray) -> dict[tuple[int, int], int]:
    """Count, inertia and component sums of each cluster after assigning all vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(centroids), DIMS + 2), object)
        for batch in batches:
            _, x = exactly(batch.column("vector"))
            if not len(x):
                continue
            number, distance = nearest(x, centroids)
            for k in np.unique(number):
                mine = number == k
                held[k] += np.array([*map(int, x[mine].sum(axis=0)), int(distance[mine].astype(object).sum()), int(mine.sum())], object)
        columns = [*range(DIMS), _INERTIA, _COUNT]
        yield parts((k, c, held[k, i]) for k in range(len(centroids)) for i, c in enumerate(columns))

    return totals(vectors.mapInArrow(run, PARTS))


def exactly(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, whole numbers) of the vectors of the right length."""
    kept, x = whole(column, DIMS)
    full = column.value_lengths().to_numpy(zero_copy_only=False)[kept] == DIMS
    return kept[full], floors(x[full], SCALE, _BITS)


def moved(centroids: np.ndarray, sums: dict[tuple[int, int], int]) -> np.ndarray:
    """The centroids at their vectors' rounded-down means; empty ones stay."""
    rows = []
    for k, old in enumerate(centroids):
        n = sums.get((k, _COUNT), 0)
        rows.append([sums.get((k, d), 0) // n for d in range(DIMS)] if n else [int(v) for v in old])
    out = np.array(rows, object).reshape(len(rows), DIMS)
    return out.astype(np.int64) if all(abs(v) < 1 << _BITS for v in out.ravel()) else out


def _vectors(embeddings: DataFrame) -> DataFrame:
    return embeddings.select("vec_id", numbers(F.col("embedding")).alias("vector"))


def cluster(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS) -> np.ndarray:
    """The centroids after so many rounds."""
    vectors = _vectors(embeddings)
    centroids = first_centroids(vectors, k)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(centroids, summed(vectors, centroids))
    return centroids


def assign(embeddings: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of each vector."""
    kind = embeddings.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, x = exactly(batch.column("vector"))
            if not len(kept) or not len(centroids):
                continue
            number, distance = nearest(x, centroids)
            fits = pa.array(distance) if distance.dtype == np.int64 else pa.array([int(v) if v < LONG else None for v in distance], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(kept)), pa.array(number, pa.int32()), fits], names=["vec_id", "cluster", "distance"])

    return _vectors(embeddings).mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's cluster and distance, with its cluster's and all clusters' inertia."""
    embeddings = table(spark, sf_dir, "embeddings")
    centroids = cluster(embeddings)
    sums = summed(_vectors(embeddings), centroids) if len(centroids) else {}
    fits = lambda v: v if v < LONG else None
    inertia = [sums.get((k, _INERTIA), 0) for k in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    # a row for each centroid
    about = spark.createDataFrame([(k, fits(v), fits(sum(inertia)), digest[k]) for k, v in enumerate(inertia)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assign(embeddings, centroids).join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    steps = [
        """v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, sha256('2:' || vec_id::VARCHAR) AS h,
            list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS x
          FROM embeddings WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda e: e IS NOT NULL AND isfinite(e))))""",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x FROM v ORDER BY h, x LIMIT 40)",
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, min(d) AS d, arg_min(k, d * 40 + k) AS k FROM (
            SELECT r, k, list_sum(list_transform(list_zip(v.x, c{i}.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v CROSS JOIN c{i}) GROUP BY r)""")
        if i < ROUNDS:
            steps.append(f"""m{i} AS MATERIALIZED (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM (
                SELECT k, i, sum(e) AS s, count(*) AS n FROM (SELECT k, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM a{i} JOIN v USING (r)) GROUP BY k, i) GROUP BY k)""")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.k, coalesce(m{i}.x, c{i}.x) AS x FROM c{i} LEFT JOIN m{i} USING (k))")
    return f"""WITH {", ".join(steps)}
        SELECT vec_id, k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia,
          (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{ROUNDS}.x, ',')) AS centroid_sha256
        FROM a{ROUNDS} JOIN v USING (r) JOIN c{ROUNDS} USING (k)"""


SQL = _sql()

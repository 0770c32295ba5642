"""Centroid clustering: rounds of assignment over integer vectors, screened by block norms.

Each kept vector is written once with its compressed form: for each of SEGMENTS
segments the mean times the root of its length, and the norm of what is left
after the mean.  By Cauchy-Schwarz two vectors are at least as far apart as
their compressed forms (inside a segment the means differ exactly, and the
rests by at least the difference of their norms).  A matrix product gives that
lower bound for every centroid; the centroid of the least bound gets its exact
distance first, and only centroids whose bound does not exceed it are measured
exactly, in integers.  A bound is lowered by more than its rounding error and
prunes only where it is greater, so neither distances nor ties can change.

A round sends one row of sums for each centroid and task, added up by Spark; the
driver holds K centroids.  Sums travel as 32-bit limbs, so they are exact for any
number of rows.

Defined results: a vector is kept if it has exactly DIMENSIONS components, none
null, NaN, infinite or beyond the range of a 32-bit float; others give no row.
Vectors without vec_id are clustered but do not start a centroid; of equal
vec_ids the vector that sorts first by its components starts first.  Fewer than
K vectors make as many centroids; none give no rows.  Repeated rows count each.
Components beyond 2**27 take Python's integers; a distance or sum beyond the
range of a long is null.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, workspace

DIMENSIONS = 64
SCALE = 64
K = 16
ROUNDS = 3
SEGMENTS = 8
#: Components up to here have exact squared distances in 64-bit integers.
SMALL = 1 << 27
LIMBS = 5
FLOAT_MAX = float(np.finfo(np.float32).max)
SIDE = 8192


def compressed(v: np.ndarray) -> np.ndarray:
    """Two numbers for each segment of the rows of ``v``; their distance is never above the rows' own."""
    parts = v.astype(np.float64).reshape(len(v), SEGMENTS, -1)
    mean = parts.mean(2)
    rest = np.sqrt(np.square(parts - mean[:, :, None]).sum(2))
    return np.concatenate([mean * np.sqrt(parts.shape[2]), rest], axis=1)


def lower_bounds(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For compressed rows and centroids, squared distances lowered by more than their rounding errors."""
    a, b = np.square(x).sum(1)[:, None], np.square(c).sum(1)[None, :]
    return a + b - 2 * (x @ c.T) - (1e-9 * (a + b) + 1e-6)


class Assigner:
    """The nearest centroid of each row, ties to the smaller number."""

    def __init__(self, centroids: list[list[int]]):
        self.exact = centroids
        self.wide = any(abs(x) > SMALL for c in centroids for x in c)
        self.ints = None if self.wide else np.array(centroids, np.int64)
        self.short = None if self.wide else compressed(self.ints)
        self.measured = 0

    def __call__(self, v: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """``v``: whole numbers as doubles; ``short``: their compressed form.  Numbers and exact squared distances."""
        number, distance = np.zeros(len(v), np.int32), [0] * len(v)
        small = np.zeros(len(v), bool) if self.wide else (np.abs(v) <= SMALL).all(1)
        at = np.flatnonzero(small)
        for a in range(0, len(at), SIDE):
            rows = at[a : a + SIDE]
            k, d = self._screened(v[rows].astype(np.int64), short[rows])
            number[rows] = k
            for r, x in zip(rows.tolist(), d.tolist(), strict=True):
                distance[r] = x
        for r in np.flatnonzero(~small).tolist():
            x = [int(y) for y in v[r]]
            distance[r], number[r] = min((sum((p - q) ** 2 for p, q in zip(x, c, strict=True)), k) for k, c in enumerate(self.exact))
        return number, distance

    def _screened(self, v: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = lower_bounds(short, self.short)
        best = low.argmin(1)
        every = np.arange(len(v))
        far = np.iinfo(np.int64).max
        found = np.full(low.shape, far)
        found[every, best] = np.square(v - self.ints[best]).sum(1)
        open_ = low <= found[every, best][:, None]
        open_[every, best] = False
        r, k = np.nonzero(open_)
        for a in range(0, len(r), SIDE):
            x, y = r[a : a + SIDE], k[a : a + SIDE]
            found[x, y] = np.square(v[x] - self.ints[y]).sum(1)
        self.measured += len(v) + len(r)
        number = found.argmin(1)
        return number.astype(np.int32), found[every, number]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _prepared(batches):
    for batch in batches:
        x = _matrix(batch.column(1), DIMENSIONS)
        v = np.floor(SCALE * x)
        short = compressed(v)
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.ravel())) for m in (v, short)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["vec_id", "v", "short"])


def prepare(vectors: DataFrame) -> DataFrame:
    """vec_id, v (whole numbers as doubles) and short, for the vectors that are kept."""
    x = F.col("embedding").cast("array<double>")
    usable = (F.size(x) == DIMENSIONS) & F.forall(x, lambda y: y.isNotNull() & (F.abs(y) <= FLOAT_MAX))
    kept = vectors.where(F.coalesce(usable, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding"))
    return kept.mapInArrow(_prepared, "vec_id long, v array<double>, short array<double>")


def _assigned(centroids):
    def assign(batches):
        nearest = Assigner(centroids)
        most = (1 << 63) - 1
        for batch in batches:
            if batch.num_rows:
                k, d = nearest(_matrix(batch.column(1), DIMENSIONS), _matrix(batch.column(2), 2 * SEGMENTS))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(k), pa.array([x if x <= most else None for x in d], pa.int64())], names=["vec_id", "cluster", "distance"])

    return assign


def limbs(x: int) -> list[int]:
    """A whole number as 32-bit limbs, the last one signed."""
    return [(x >> 32 * j) & 0xFFFFFFFF for j in range(LIMBS - 1)] + [x >> 32 * (LIMBS - 1)]


def _summed(centroids):
    def sums(batches):
        nearest = Assigner(centroids)
        total = [[0] * DIMENSIONS for _ in centroids]
        count = [0] * len(centroids)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column(1), DIMENSIONS)
            number, _ = nearest(v, _matrix(batch.column(2), 2 * SEGMENTS))
            small = (np.abs(v) <= SMALL).all(1)
            for k in np.unique(number).tolist():
                own = number == k
                count[k] += int(own.sum())
                add = v[own & small].astype(np.int64).sum(0).tolist()
                for row in v[own & ~small]:
                    add = [p + int(q) for p, q in zip(add, row, strict=True)]
                total[k] = [p + q for p, q in zip(total[k], add, strict=True)]
        full = [k for k, n in enumerate(count) if n]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([count[k] for k in full], pa.int64()), pa.array([[y for x in total[k] for y in limbs(x)] for k in full], pa.list_(pa.int64()))], names=["cluster", "n", "parts"])

    return sums


def start(prepared: DataFrame, k: int = K) -> list[list[int]]:
    """The vectors with the k smallest hashes of their ids, in that order."""
    first = prepared.where("vec_id is not null").select("v", F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).alias("hash"))
    return [[int(x) for x in r.v] for r in first.orderBy("hash", "v").limit(k).collect()]


def moved(prepared: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Each centroid as the exact floor of its vectors' mean; an empty one stays."""
    parts = prepared.mapInArrow(_summed(centroids), "cluster int, n long, parts array<long>")
    by_place = parts.select("cluster", "n", F.posexplode("parts").alias("at", "part")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("part").alias("part"))
    after, count = [list(c) for c in centroids], {}
    sums: dict[tuple[int, int], int] = {}
    for r in by_place.collect():  # K * DIMENSIONS * LIMBS rows at most
        i, j = divmod(r["at"], LIMBS)
        sums[r["cluster"], i] = sums.get((r["cluster"], i), 0) + (r["part"] << 32 * j)
        count[r["cluster"]] = r["n"]
    for (k, i), s in sums.items():
        after[k][i] = s // count[k]
    return after


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256; a row for each kept vector."""
    spark = vectors.sparkSession
    ws = workspace(spark, "centroids")
    prepared = ws.write(prepare(vectors), "vectors")
    centroids = start(prepared, k)
    if not centroids:
        return prepared.limit(0).select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    for _ in range(rounds):
        centroids = moved(prepared, centroids)
    assigned = ws.write(prepared.mapInArrow(_assigned(centroids), "vec_id long, cluster int, distance long"), "assigned")
    ws.drop("vectors")
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("total"), (F.count("*") > F.count("distance")).alias("beyond")).collect()  # K rows at most
    within = lambda x, beyond: int(x) if not beyond and x <= (1 << 63) - 1 else None
    every = within(sum(r.total or 0 for r in sums), any(r.beyond for r in sums))
    rows = [(r.cluster, within(r.total or 0, r.beyond), every, hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()) for r in sums]
    totals = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # K rows at most


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(read_table(spark, sf_dir, "embeddings"))


def oracle() -> str:
    """The same in DuckDB: every distance to every centroid, each round."""
    nearest = "SELECT rid, vec_id, v, m.k AS k, m.d AS d FROM (SELECT rid, vec_id, v, min({'d': d, 'k': k}) AS m FROM (SELECT rid, vec_id, v, k, CAST(list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS BIGINT) AS d FROM kept, c%d) GROUP BY rid, vec_id, v)"
    steps = []
    for t in range(ROUNDS):
        steps += [
            f"a{t} AS MATERIALIZED ({nearest % t})",
            f"s{t} AS MATERIALIZED (SELECT k, i, sum(v[i]) AS s, count(*) AS n FROM a{t}, (SELECT unnest(range(1, 65)) AS i) GROUP BY k, i)",
            f"m{t} AS MATERIALIZED (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{t} GROUP BY k)",
            f"c{t + 1} AS MATERIALIZED (SELECT c{t}.k, coalesce(m{t}.c, c{t}.c) AS c FROM c{t} LEFT JOIN m{t} USING (k))",
        ]
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS k, v AS c FROM kept WHERE vec_id IS NOT NULL ORDER BY k LIMIT {K}
),
{", ".join(steps)},
a{ROUNDS} AS MATERIALIZED ({nearest % ROUNDS})
SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} USING (k)
"""

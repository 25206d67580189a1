"""Centroid clustering of vectors by plain Lloyd rounds in whole numbers, so that its result doesn't depend on how rows are dealt.

Each round the centroids (k rows) are broadcast; tasks compare their vectors with one centroid after the other, in blocks
of a few thousand, and pass on one row of sums for each cluster; sums are merged by groupBy. Only those k rows come to the
driver.

Defined results: vectors that are null, have another number of components, or hold null or non-finite ones are left out;
repeated rows and ids each count and are each a row; a null id is hashed as the empty text; vectors whose hashes agree
are ordered by id, then by components; fewer vectors than clusters make fewer clusters; an empty table gives no rows.
Whole numbers too large for 64-bit differences are computed as Python's; a sum beyond a long is an error, not a wrong row.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .shared import written

DIMS, CLUSTERS, ROUNDS, SCALE, SALT = 64, 40, 5, 256, "2"
BLOCK = 4096  # vectors that a task compares at a time


def safe(dims: int) -> int:
    """Components up to here have differences whose squares sum in 64 bits."""
    return math.isqrt((2**63 - 1) // dims) // 2


def scaled(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vectors (vec_id, embedding) -> (vec_id, x): components as whole numbers, of the vectors that have dims finite ones."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where((F.size("embedding") == dims) & fine)
    return kept.select("vec_id", F.transform(v, lambda x: F.floor(x * float(scale)).cast("long")).alias("x"))


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the lowest index of the nearest centroid, and the squared distance to it."""
    if max(abs(int(f(a))) for f in (np.max, np.min) for a in (x, centroids)) > safe(x.shape[1]):
        x, centroids = x.astype(object), centroids.astype(object)
    away = np.empty((len(x), len(centroids)), x.dtype)
    for s in range(0, len(x), BLOCK):
        for k, c in enumerate(centroids):
            d = x[s : s + BLOCK] - c
            away[s : s + BLOCK, k] = (d * d).sum(1)
    at = away.argmin(1)
    return at, away[np.arange(len(x)), at]


def first_centroids(rows: DataFrame, k: int = CLUSTERS, salt: str = SALT) -> np.ndarray:
    """The k vectors with the smallest hashes of salt:vec_id; only these come to the driver."""
    h = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r["x"] for r in rows.withColumn("h", h).orderBy("h", "vec_id", "x").limit(k).collect()], np.int64)


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round; empty clusters keep theirs."""
    known, dims = rows.sparkSession.sparkContext.broadcast(centroids), centroids.shape[1]

    def sums(batches):
        totals: dict[int, tuple[int, np.ndarray]] = {}
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["x"])
                at, _ = nearest(x, known.value)
                for k in np.unique(at).tolist():
                    n, t = totals.get(k, (0, np.zeros(dims, object)))
                    own = x[at == k]
                    totals[k] = n + len(own), t + own.astype(object if np.abs(own).max() > safe(dims) else np.int64).sum(0)
        yield pd.DataFrame([(k, n, t.tolist()) for k, (n, t) in totals.items()], columns=["cluster", "n", "total"])

    parts = rows.select("x").mapInPandas(sums, "cluster int, n long, total array<long>")
    merged = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(dims))).collect()
    out = centroids.copy()
    for r in merged:
        out[r["cluster"]] = [r[f"t{i}"] // r["n"] for i in range(dims)]
    return out


def lloyd(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, salt: str = SALT) -> DataFrame:
    """vectors (vec_id, embedding) -> (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row for each kept one."""
    spark = vectors.sparkSession
    kind = vectors.schema["vec_id"].dataType.simpleString()
    rows = written(scaled(vectors, dims, scale), "vectors")
    centroids = first_centroids(rows, k, salt)
    if not len(centroids):
        return rows.selectExpr("vec_id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256")
    for _ in range(rounds):
        centroids = moved(rows, centroids)
    known = spark.sparkContext.broadcast(centroids)

    def assign(batches):
        for pdf in batches:
            if len(pdf):
                at, away = nearest(np.stack(pdf["x"]), known.value)
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "cluster": at.astype(np.int32), "distance": away})

    assigned = written(rows.mapInPandas(assign, f"vec_id {kind}, cluster int, distance long"), "assigned")
    inertias = assigned.groupBy("cluster").agg(F.sum("distance").alias("own"))  # a row a cluster
    shas = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    by = {r["cluster"]: r["own"] for r in inertias.collect()}
    total = sum(by.values())
    table = [(i, by.get(i, 0), total, shas[i]) for i in range(len(shas))]
    clusters = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13(spark, sf_dir: str) -> DataFrame:
    """All vectors of embeddings."""
    return lloyd(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def _sql() -> str:
    """One round after the other: vectors against centroids, then sums of components."""
    away = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = [
        f"""vectors AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0)""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('{SALT}:' || vec_id)) - 1 AS c, x FROM vectors QUALIFY c < {CLUSTERS})",
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, min({{'d': CAST({away} AS BIGINT), 'c': c.c}}) AS best FROM vectors v, c{i} c GROUP BY r)")
        if i < ROUNDS:
            steps.append(f"""m{i} AS (
  SELECT c, list(CAST(floor(s / k) AS BIGINT) ORDER BY j) AS x FROM (
    SELECT best.c AS c, j, sum(CAST(x[j] AS BIGINT)) AS s, count(*) AS k
    FROM a{i} JOIN vectors USING (r), range(1, {DIMS + 1}) t(j) GROUP BY ALL) GROUP BY c)""")
            steps.append(f"c{i + 1} AS (SELECT c, coalesce(m.x, o.x) AS x FROM c{i} o LEFT JOIN m{i} m USING (c))")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(best.c AS INT) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN vectors USING (r) JOIN c{ROUNDS} c ON c.c = best.c"""  # fmt: skip


OP13_SQL = _sql()

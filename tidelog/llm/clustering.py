"""Centroid clustering by plain Lloyd rounds in whole numbers: every result is exact and the same however the rows lie."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, table

#: Components lie below this, so that squared distances of up to 64 of them are below 2^63.
LIMIT = 1 << 27


def whole_vectors(df: DataFrame, dims: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """id and v (floors of scale times each component) of the vectors with dims finite components."""
    x = F.col("x")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    within = F.forall(x, lambda c: F.abs(c) < LIMIT / scale)
    fine = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("x")).where((F.size(x) == dims) & finite)
    v = F.transform(x, lambda c: F.floor(c * scale))
    return fine.select("id", F.when(within, v).otherwise(F.raise_error(F.lit(f"a component beyond {LIMIT // scale}, where distances leave a long"))).alias("v"))


def nearest_centroid(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to the nearest centroid; of equal ones the lowest number."""
    gaps = np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)
    best = gaps.argmin(1)
    return best, gaps[np.arange(len(x)), best]


def _sums(vectors: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Number and componentwise sums of the vectors nearest each centroid: added up in each partition, then merged.
    The driver gets one row for each centroid."""
    k, dims = centroids.shape
    sent = vectors.sparkSession.sparkContext.broadcast(centroids)

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for f in frames:
            if len(f):
                x = np.stack(f["v"].to_numpy()).astype(np.int64)
                best, _ = nearest_centroid(x, sent.value)
                n += np.bincount(best, minlength=k)
                for c in np.unique(best):
                    total[c] += x[best == c].sum(0)
        some = np.flatnonzero(n)
        yield pd.DataFrame({"cluster": some.astype(np.int32), "n": n[some], "s": [row.tolist() for row in total[some]]})

    parts = vectors.select("v").mapInPandas(part, "cluster int, n bigint, s array<bigint>")
    exact = [F.sum(F.col("s")[d].cast("decimal(20,0)")).alias(f"s{d}") for d in range(dims)]
    return {r.cluster: (r.n, [int(r[f"s{d}"]) for d in range(dims)]) for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *exact).collect()}


def cluster_vectors(df: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id_col, cluster, distance (squared), cluster_inertia, inertia, centroid (its components) of each vector.

    Centroids start as the k vectors whose sha256 of salt:id is smallest; each round moves every centroid that has
    vectors to the floor of their mean, empty ones stay; then vectors are assigned once more.

    Vectors of another length, null ones and those with a null or not finite component take no part; a vector with a
    null id is clustered but never a start; rows that repeat an id are vectors of their own, and where such an id
    starts, equal hashes go by components. Fewer than k vectors give fewer centroids, none an empty result. A
    component too large for exact distances in a long is an error. Other columns are not read, whatever their names. The
    driver holds k centroids and, each round, their sums. Whole-number vectors lie in the shared folder.
    """
    spark = df.sparkSession
    vectors = save(whole_vectors(df, dims, scale, id_col, vector_col), "whole-vectors")
    hashed = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    starts = vectors.where("id IS NOT NULL").withColumn("h", hashed).orderBy("h", "v").limit(k).collect()
    if not starts:
        return vectors.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), *(F.lit(0).cast("bigint").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.col("v").alias("centroid")).limit(0)
    centroids = np.array([r.v for r in starts], np.int64)
    for _ in range(rounds):
        for c, (n, total) in _sums(vectors, centroids).items():
            centroids[c] = [t // n for t in total]
    sent = spark.sparkContext.broadcast(centroids)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                best, gap = nearest_centroid(np.stack(f["v"].to_numpy()).astype(np.int64), sent.value)
                yield pd.DataFrame({"id": f["id"].astype("Int64"), "cluster": best.astype(np.int32), "distance": gap})

    assigned = save(vectors.mapInPandas(assign, "id bigint, cluster int, distance bigint"), "assigned")
    inertia = {r.cluster: r.s for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    rows = [(c, s, sum(inertia.values()), centroids[c].tolist()) for c, s in inertia.items()]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    return assigned.join(F.broadcast(about), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cluster_vectors(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.concat_ws(",", F.transform("centroid", lambda x: x.cast("string"))), 256)
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def _oracle(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """DuckDB SQL for the rows of op13_centroid_clustering: a step of assignment and one of means for each round."""
    floor_mean = "((s - ((s % n) + n) % n) // n)::BIGINT"
    sql = [
        f"""e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: isfinite(x))) = {dims})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('2:' || vec_id) AS h, v FROM e WHERE vec_id IS NOT NULL) ORDER BY h, v LIMIT {k})",
    ]
    for i in range(rounds + 1):
        square = f"list_sum(list_transform(range(1, {dims + 1}), lambda j: (e.v[j] - c.v[j]) * (e.v[j] - c.v[j])))::BIGINT"
        sql.append(f"a{i} AS MATERIALIZED (SELECT r, vec_id, c, d FROM (SELECT r, vec_id, c, {square} AS d FROM e, c{i} c) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        if i < rounds:
            sql.append(f"s{i} AS (SELECT c, j, sum(v[j]) AS s, count(*) AS n FROM a{i} JOIN e USING (r), (SELECT unnest(range(1, {dims + 1})) AS j) GROUP BY ALL)")
            sql.append(f"m{i} AS (SELECT c, list({floor_mean} ORDER BY j) AS v FROM s{i} GROUP BY c)")
            sql.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.v, o.v) AS v FROM c{i} o LEFT JOIN m{i} m USING (c))")
    last = f"""SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(v, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (c)"""
    return "WITH " + ",\n".join(sql) + "\n" + last


ORACLE_SQL = _oracle()

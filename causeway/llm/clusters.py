"""Centroid clustering of integer vectors with Hamerly's bounds.

Components become integers, so every distance and mean is exact. Each vector keeps its cluster, an upper bound of the
distance to its centroid and one lower bound of the distance to the second-nearest. When centroids move, the upper
bound grows by the own centroid's drift and the lower one shrinks by the largest drift of the others. A vector whose
upper bound stays below its lower bound, or below half the gap between its centroid and the nearest other, keeps its
cluster unseen; else its own distance is computed, and only if that leaves it ambiguous are all distances scanned, as
exact integers. Bounds are rounded outwards, so rounding never decides; equal distances always are ambiguous and the scan
gives them to the smaller number.

Vectors never move: each round is one pass over the partitions, and what is shuffled is sums, one row for each cluster and
task. The rounds' state is persisted while the next one needs it, in memory or on disk, and is made again from its
lineage where an executor is lost; the result is written to the checkpoint folder. Only centroids reach the driver.

Edge cases: vectors that are null, of another length, or hold a null or a non-finite component are left out; with fewer
vectors than centroids each vector is one; rows without vec_id are clustered but never are first centroids; repeated
rows count each, also as first centroids; equal distances go to the smaller number and empty clusters keep their
centroid; an empty table gives an empty result; columns beside vec_id and embedding are not read. Scaled components of 2**27 or
more raise an error, as squared distances would leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import cut, lean

COMPONENTS, CENTROIDS, ROUNDS, SEED, SCALE = 64, 40, 5, 2, 256
LARGEST = 1 << 27  # 64 squared differences of such numbers stay below 2**63
EXACT_IN_DOUBLES = 1 << 22  # and those of such numbers below 2**53
SLACK = 1e-9  # relative; bounds are rounded outwards by it
STATE = "vec_id long, v array<int>, cluster int, upper double, lower double"
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))), F.lit(False))


def scaled(vector: Column) -> Column:
    """floor(256 * x) of each component; an error where that is 2**27 or more."""
    whole = lambda x: F.floor(x.cast("double") * SCALE)
    bad = F.raise_error("a scaled component is 2**27 or more").cast("int")
    return F.transform(vector, lambda x: F.when(F.abs(whole(x)) < LARGEST, whole(x).cast("int")).otherwise(bad))


def matrix(column, width: int) -> np.ndarray:
    """An Arrow column of lists of one length as rows; float64 if products are exact in it, else int64."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return exact(flat)


def exact(flat: np.ndarray) -> np.ndarray:
    small = not flat.size or int(np.abs(flat.astype(np.int64)).max()) < EXACT_IN_DOUBLES
    return flat.astype(np.float64 if small else np.int64)


def squared_distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All exact squared distances of rows of v and c."""
    v, c = (v, c) if v.dtype == c.dtype else (v.astype(np.int64), c.astype(np.int64))
    return ((v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)[None, :]).astype(np.int64)


def own_distances(v: np.ndarray, c: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    v, c = (v, c) if v.dtype == c.dtype else (v.astype(np.int64), c.astype(np.int64))
    d = v - c[cluster]
    return (d * d).sum(1).astype(np.int64)


def scan(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (the smaller number of equals), upper and lower bound, from all distances."""
    d = squared_distances(v, c)
    cluster = d.argmin(axis=1)
    upper = np.sqrt(d[np.arange(len(d)), cluster]) * (1 + SLACK)
    if len(c) == 1:
        return cluster, upper, np.full(len(d), np.inf)
    return cluster, upper, np.sqrt(np.partition(d, 1, axis=1)[:, 1]) * (1 - SLACK)


class Move:
    """How far centroids went, and how near the others are."""

    def __init__(self, old: np.ndarray, new: np.ndarray):
        self.centroids = exact(new)
        self.drift = np.sqrt(((new - old).astype(np.float64) ** 2).sum(1)) * (1 + SLACK)
        k = len(new)
        self.others = np.array([np.delete(self.drift, i).max(initial=0.0) for i in range(k)])  # the largest drift of another centroid
        gaps = squared_distances(self.centroids, self.centroids).astype(np.float64)
        np.fill_diagonal(gaps, np.inf)
        self.half_gap = np.sqrt(gaps.min(axis=1)) / 2 * (1 - SLACK)

    def follow(self, v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Cluster, upper and lower bound after the move, and how many vectors took a full scan."""
        cluster = cluster.copy()
        upper, lower = (upper + self.drift[cluster]) * (1 + SLACK), lower - self.others[cluster]
        lower = np.where(lower > 0, lower * (1 - SLACK), lower)
        safe = np.maximum(lower, self.half_gap[cluster])
        ask = np.flatnonzero(upper >= safe)
        upper[ask] = np.sqrt(own_distances(v[ask], self.centroids, cluster[ask])) * (1 + SLACK)
        ask = ask[upper[ask] >= safe[ask]]
        cluster[ask], upper[ask], lower[ask] = scan(v[ask], self.centroids)
        return cluster, upper, lower, len(ask)


def _first(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        c = exact(centroids)
        for b in batches:
            cluster, upper, lower = scan(matrix(b["v"], c.shape[1]), c)
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["v"], pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower)], ["vec_id", "v", "cluster", "upper", "lower"])

    return rows.mapInArrow(lean(work), STATE)


def _next(state: DataFrame, old: np.ndarray, new: np.ndarray, last: bool) -> DataFrame:
    """The state after centroids moved; in the last round vec_id, cluster and the exact distance."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        move = Move(old, new)
        for b in batches:
            v = matrix(b["v"], new.shape[1])
            held = [b[c].to_numpy(zero_copy_only=False) for c in ("cluster", "upper", "lower")]
            cluster, upper, lower, _ = move.follow(v, *held)
            if last:
                columns = [b["vec_id"], pa.array(cluster, pa.int32()), pa.array(own_distances(v, move.centroids, cluster), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])
            else:
                yield pa.RecordBatch.from_arrays([b["vec_id"], b["v"], pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower)], ["vec_id", "v", "cluster", "upper", "lower"])

    return state.mapInArrow(lean(work), "vec_id long, cluster int, distance long" if last else STATE)


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """floor(sum / count) of each cluster's vectors; empty clusters keep their centroid."""
    width = centroids.shape[1]
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(width)])
    out = centroids.copy()
    for r in sums.collect():  # one row for each centroid
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return out


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose `seed:vec_id` has the smallest SHA-256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("digest")
    chosen = rows.where("vec_id is not null").select(digest, "v").orderBy("digest", "v").limit(k).collect()
    return np.array([r["v"] for r in chosen], dtype=np.int64)


def cluster_vectors(embeddings: DataFrame, components: int = COMPONENTS, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    spark = embeddings.sparkSession
    e = F.col("embedding")
    rows = embeddings.where((F.size(e) == components) & finite(e)).select(F.col("vec_id").cast("long").alias("vec_id"), scaled(e).alias("v"))
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], RESULT)
    state = _first(rows, centroids).persist(StorageLevel.MEMORY_AND_DISK)
    moved = _means(state, centroids) if rounds else centroids
    for _ in range(rounds - 1):
        following = _next(state, centroids, moved, last=False).persist(StorageLevel.MEMORY_AND_DISK)
        centroids, moved = moved, _means(following, moved)
        state.unpersist()
        state = following
    found = cut(_next(state, centroids, moved, last=True))
    state.unpersist()
    inertia = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # one row for each centroid
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in moved.tolist()]
    about = spark.createDataFrame([(i, inertia.get(i, 0), sum(inertia.values()), d) for i, d in enumerate(digests)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # about has k rows


def op12_hamerly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    """The same in DuckDB: every round scans all distances, component by component."""
    ctes = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "l AS MATERIALIZED (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v)",
        f"s AS (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1 AS k, v FROM v WHERE vec_id IS NOT NULL ORDER BY k LIMIT {CENTROIDS})",
        "c0 AS MATERIALIZED (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM s)",
    ]
    for t in range(ROUNDS + 1):
        ctes.append(f"a{t} AS MATERIALIZED (SELECT r, min(d * 64 + k) % 64 AS k, min(d) AS d FROM (SELECT r, k, CAST(sum((l.x - c.x) * (l.x - c.x)) AS BIGINT) AS d FROM l JOIN c{t} c USING (i) GROUP BY r, k) q GROUP BY r)")
        if t < ROUNDS:
            ctes.append(f"c{t + 1} AS MATERIALIZED (SELECT k, i, coalesce((s - ((s % n) + n) % n) // n, x) AS x FROM c{t} LEFT JOIN (SELECT k, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{t} JOIN l USING (r) GROUP BY k, i) m USING (k, i))")
    ctes.append(f"h AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS sha FROM c{ROUNDS} GROUP BY k)")
    return f"WITH {', '.join(ctes)} SELECT vec_id, CAST(k AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha AS centroid_sha256 FROM a{ROUNDS} JOIN v USING (r) JOIN h USING (k)"


SQL = _sql()

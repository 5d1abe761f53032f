"""Centroid clustering on bit planes: exact integer distances from AND and popcount.

Components are whole numbers floor(scale * x). Bit b of 64 components is one unsigned 64-bit word, a plane; in two's
complement plane b weighs 2 ** b, the top one -2 ** b. A dot product is the weighted sum of popcounts of a vector's
planes AND a centroid's planes, and |x - c| ** 2 = |x| ** 2 - 2 x c + |c| ** 2 is exact in 64-bit integers.

Each round is one pass over the packed table: a task sums its vectors by nearest centroid, so a shuffle carries
clusters times components numbers a task whatever the number of equal vectors, and the driver sees clusters times
components sums.

Vectors that are null, of another length, or with null or non-finite components are left out. Repeated rows count as
often as they occur and get equal results; a null vec_id takes part but is never a first centroid while there are
others. Fewer vectors than clusters make fewer clusters; an empty table gives an empty result. Components beyond
+-LARGEST raise: their distances do not fit a long. Extra columns are not carried.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

CLUSTERS, ROUNDS, DIMS, SCALE, SEED = 16, 3, 64, 64.0, 1
LARGEST = 1 << 27
#: Vectors that are compared at once, which bounds a task's memory.
BLOCK = 4096
WORD = 64


def weights(planes: int) -> list[int]:
    return [1 << b for b in range(planes - 1)] + [-(1 << (planes - 1))]


def pack(v: np.ndarray) -> np.ndarray:
    """Planes (rows, planes, words) of whole numbers (rows, components); the last word is filled up with zeros."""
    most = int(np.maximum(v, ~v).max()) if v.size else 0
    words = -(-v.shape[1] // WORD)
    full = np.zeros((len(v), words * WORD), np.int64)
    full[:, : v.shape[1]] = v
    planes = [np.packbits((full >> b & 1).astype(np.uint8), axis=1, bitorder="little").view("<u8") for b in range(most.bit_length() + 1)]
    return np.stack(planes, 1)


def unpack(planes: np.ndarray, dims: int) -> np.ndarray:
    bits = np.unpackbits(np.ascontiguousarray(planes).view(np.uint8).reshape(*planes.shape[:2], -1), axis=2, bitorder="little")[:, :, :dims]
    return sum(w * bits[:, b].astype(np.int64) for b, w in enumerate(weights(planes.shape[1])))


def dots(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Dot products (rows of x, rows of c) of packed vectors."""
    out = np.zeros((len(x), len(c)), np.int64)
    for b, wx in enumerate(weights(x.shape[1])):
        for d, wc in enumerate(weights(c.shape[1])):
            out += wx * wc * np.bitwise_count(x[:, None, b] & c[None, :, d]).sum(-1, dtype=np.int64)
    return out


def squares(x: np.ndarray) -> np.ndarray:
    w = weights(x.shape[1])
    return sum(w[b] * w[d] * np.bitwise_count(x[:, b] & x[:, d]).sum(-1, dtype=np.int64) for b in range(len(w)) for d in range(len(w)))


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least squared distance's centroid, the first of equals, and that distance."""
    far = squares(x)[:, None] - 2 * dots(x, c) + squares(c)[None]
    at = far.argmin(1)
    return at, far[np.arange(len(x)), at]


def packed(vectors: DataFrame, dims: int = DIMS, scale: float = SCALE) -> DataFrame:
    """vec_id and planes (those of word 0, then of word 1, ...) of the vectors that count."""
    words = -(-dims // WORD)

    def run(batches):
        for b in batches:
            ids, col = b.column("vec_id"), b.column("v")
            ok = pc.fill_null(pc.equal(pc.list_value_length(col), dims), False)
            ids, col = ids.filter(ok), col.filter(ok)
            x = np.floor(col.flatten().to_numpy(zero_copy_only=False).astype(float) * scale).reshape(-1, dims)  # nulls are NaN
            fine = np.isfinite(x).all(1)
            x = x[fine]
            if x.size and np.abs(x).max() > LARGEST:
                raise ValueError(f"components beyond {LARGEST} after scaling: distances would not fit a long")
            planes = pack(x.astype(np.int64)).transpose(0, 2, 1)
            values = pa.array(planes.reshape(-1).view(np.int64), pa.int64())
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * (planes.shape[2] * words), pa.int32())
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(fine)), pa.ListArray.from_arrays(ends, values)], names=["vec_id", "planes"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).mapInArrow(run, f"vec_id {kind}, planes array<bigint>")


def planes_of(column: pa.Array, words: int):
    """(rows, planes) of a list column, rows of equally many planes together and BLOCK of them at a time."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        for i in range(0, len(rows), BLOCK):
            at = rows[i : i + BLOCK]
            flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).view("<u8")
            yield at, flat.reshape(len(at), words, -1).transpose(0, 2, 1)


def sums(table: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Per centroid that has vectors: their number, and their sums by component."""
    dims, c = centroids.shape[1], pack(centroids)
    words = c.shape[2]

    def run(batches):
        total = np.zeros((len(centroids), dims + 1), np.int64)
        for b in batches:
            for _, x in planes_of(b.column(0), words):
                at, _ = nearest(x, c)
                v = unpack(x, dims)
                for k in np.unique(at):
                    total[k, 0] += (at == k).sum()
                    total[k, 1:] += v[at == k].sum(0)
        k, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(j), pa.array(total[k, j])], names=["k", "j", "s"])

    rows = table.select("planes").mapInArrow(run, "k bigint, j bigint, s bigint").groupBy("k", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # clusters x (components + 1) rows
    found: dict[int, list[int]] = {}
    for r in rows:
        found.setdefault(r.k, [0] * (dims + 1))[r.j] = int(r.s)
    return {k: (v[0], v[1:]) for k, v in found.items()}


def first_centroids(table: DataFrame, clusters: int, dims: int, seed: int) -> np.ndarray:
    """The vectors of least sha256 of 'seed:vec_id'; of equal ids the least planes."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = table.orderBy(order.asc_nulls_last(), "planes").limit(clusters).collect()
    words = -(-dims // WORD)
    return np.array([unpack(np.array(r.planes, np.int64).view("<u8").reshape(1, words, -1).transpose(0, 2, 1), dims)[0] for r in rows], np.int64).reshape(len(rows), dims)


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: float = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of vectors (vec_id, embedding), and the centroids after `rounds` rounds."""
    table = materialize(packed(vectors, dims, scale), "planes")
    centroids = first_centroids(table, clusters, dims, seed)
    for _ in range(rounds if len(centroids) else 0):
        for k, (n, total) in sums(table, centroids).items():
            centroids[k] = [s // n for s in total]
    c, words = pack(centroids), -(-dims // WORD)

    def run(batches):
        for b in batches:
            at, far = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, np.int64)
            for rows, x in planes_of(b.column("planes"), words):
                at[rows], far[rows] = nearest(x, c)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(at), pa.array(far)], names=["vec_id", "cluster", "distance"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return table.mapInArrow(run, f"vec_id {kind}, cluster int, distance bigint"), centroids


def with_inertia(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """found with the summed distances of its cluster and of all, and its centroid's digest."""
    found = materialize(found, "clusters")
    rows = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # a row per cluster
    digest = lambda k: hashlib.sha256(",".join(map(str, centroids[k].tolist())).encode()).hexdigest()
    total = sum(int(r.s) for r in rows)
    about = found.sparkSession.createDataFrame([(r.cluster, int(r.s), total, digest(r.cluster)) for r in rows], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # at most a row per centroid is broadcast


def oracle_sql(table: str = "embeddings") -> str:
    """The same for DuckDB with the rounds written out; without the planes."""
    far = lambda c: f"list_sum(list_transform(range(1, {DIMS + 1}), lambda i: (v.x[i] - {c}.x[i]) * (v.x[i] - {c}.x[i])))"
    steps = [
        f"v AS (SELECT vec_id, list_transform(embedding, lambda a: CAST(floor({SCALE} * CAST(a AS DOUBLE)) AS BIGINT)) AS x FROM {table} WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda a: a IS NULL OR NOT isfinite(a))) = 0)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS k, x FROM (SELECT sha256('{SEED}:' || vec_id) AS h, x FROM v ORDER BY h LIMIT {CLUSTERS}))",
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} AS (SELECT vec_id, any_value(v.x) AS x, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT v.vec_id, v.x, k, {far(f'c{r}')} AS d FROM v, c{r}) v GROUP BY vec_id)")
        if r < ROUNDS:
            steps.append(f"s{r} AS (SELECT k, i, sum(x[i]) AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, {DIMS + 1})) AS i) GROUP BY k, i)")
            steps.append(f"c{r + 1} AS (SELECT c{r}.k, coalesce(m.x, c{r}.x) AS x FROM c{r} LEFT JOIN (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM s{r} GROUP BY k) m ON m.k = c{r}.k)")
    last = ROUNDS
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(a{last}.k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a{last}.k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(c{last}.x, ',')) AS centroid_sha256 FROM a{last} JOIN c{last} ON a{last}.k = c{last}.k"""

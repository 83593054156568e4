"""Centroid clustering of whole-number vectors with n-simplex projection.

A kept vector's entries become ``floor(1024 * x)``. Its exact squared distances to a few pivots
are taken once; with the pivots they fix a simplex whose apex has one coordinate per pivot (the
foot of the vector in the pivots' hull, and the height above it). Two apexes bound the distance
of their vectors: heights on the same side give a lower bound, on opposite sides an upper one.
Apexes are saved beside the vectors; each round moves only the centroids' apexes, drops every
centroid whose lower bound lies above the least upper bound or above the exact distance to the
most promising one, and compares what is left in 64-bit integers. Bounds carry a margin well
above the rounding of their doubles, so a nearest or tied centroid is never dropped.

The pivots are the seeds, in whose hull all centroids start, and further vectors of a small pool,
each time the one farthest from the hull so far; those that would make the simplex flat are left
out. They decide how much is filtered, never the result.

Sums per cluster are added up within a task (a row per cluster and task), then by Spark as
decimals, so no row count overflows them; 8 centroids reach the driver.

Defined cases: a vector that is null, of another length or with a null, infinite or
not-a-number entry is left out, as is one whose length (of its whole numbers) exceeds 2**30,
since squared distances could exceed a long; an id may be null or repeated, each row counts;
rows with one id are ordered by their vector as seeds; with fewer than 8 rows there are so many
centroids; an empty table gives an empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.shared import emit, prepare, saved
from orderlens.llm.vectors import complete, doubles, lists, matrix

DIMS = 64
SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
PIVOTS = 48
POOL = 128
LONGEST = float(1 << 60)  # squared
MOST = (1 << 63) - 1
# Share of the vectors' squared distances to the first pivot that a bound may be off.
MARGIN = 1e-5
FLATTEST = 0.05

KEPT = pa.schema([("vec_id", pa.int64()), ("x", pa.list_(pa.int32()))])
PLACED = pa.schema([("vec_id", pa.int64()), ("x", pa.list_(pa.int32())), ("apex", pa.list_(pa.float64()))])
PARTIAL = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))])
ASSIGNED = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])


def squared(rows: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole-number vectors, (rows, to)."""
    return np.stack([((rows - one) ** 2).sum(axis=1) for one in to], axis=1)


@dataclass(frozen=True)
class Simplex:
    """Pivots, their squared distances to the first, and the inverse of the others' coordinates."""

    pivots: np.ndarray
    edges: np.ndarray
    inverse: np.ndarray

    @staticmethod
    def of(seeds: np.ndarray, pool: np.ndarray, most: int) -> Simplex:
        """Up to ``most`` pivots: seeds first, then the pool's farthest from the hull so far."""
        chosen = [seeds[0]]
        others = np.vstack([seeds[1:], pool])
        gaps = (others - seeds[0]).astype(float)
        rest = (gaps**2).sum(axis=1)
        widest = rest.max(initial=0.0)
        coordinates = np.zeros((len(others), 0))
        rows: list[int] = []
        while len(chosen) < most and len(others):
            open_seeds = [k for k in range(len(seeds) - 1) if k not in rows and rest[k] > FLATTEST**2 * widest]
            k = open_seeds[0] if open_seeds else int(rest.argmax())
            if rest[k] <= FLATTEST**2 * widest or rest[k] <= 0:
                break
            along = (gaps @ gaps[k] - coordinates @ coordinates[k]) / np.sqrt(rest[k])
            coordinates = np.c_[coordinates, along]
            rest = np.maximum(rest - along**2, 0)
            rest[k] = 0
            rows.append(k)
            chosen.append(others[k])
        pivots = np.array(chosen)
        return Simplex(pivots, squared(pivots[1:], pivots[:1])[:, 0], np.linalg.inv(np.tril(coordinates[rows])))

    def apexes(self, rows: np.ndarray) -> np.ndarray:
        gaps = squared(rows, self.pivots)
        foot = ((gaps[:, :1] + self.edges - gaps[:, 1:]) / 2) @ self.inverse.T
        height = np.sqrt(np.maximum(gaps[:, 0] - (foot**2).sum(axis=1), 0))
        return np.c_[foot, height]


def nearest(x: np.ndarray, apex: np.ndarray, centroids: np.ndarray, tops: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (ties: smaller number), exact squared distance, and how many exact
    distances it took."""
    n = len(x)
    sizes = (apex**2).sum(axis=1)[:, None] + (tops**2).sum(axis=1)
    inner = apex[:, :-1] @ tops[:, :-1].T
    heights = apex[:, -1:] * tops[:, -1]
    low = sizes - 2 * (inner + heights) - MARGIN * sizes
    high = sizes - 2 * (inner - heights) + MARGIN * sizes
    open_ = low <= high.min(axis=1)[:, None]
    # The most promising one first: its exact distance closes most of the others.
    cluster = np.where(open_, low + high, np.inf).argmin(axis=1).astype(np.int32)
    distance = ((x - centroids[cluster]) ** 2).sum(axis=1)
    made = n
    open_ &= low <= distance[:, None]
    open_[np.arange(n), cluster] = False
    for k in range(len(centroids)):
        at = np.flatnonzero(open_[:, k] & (low[:, k] <= distance))
        made += len(at)
        exact = ((x[at] - centroids[k]) ** 2).sum(axis=1)
        better = (exact < distance[at]) | ((exact == distance[at]) & (k < cluster[at]))
        cluster[at[better]] = k
        distance[at[better]] = exact[better]
    return cluster, distance, made


def kept(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, values = complete(batch.column(1), dims)
            numbers = np.floor(scale * values)
            fits = (numbers**2).sum(axis=1) <= LONGEST
            yield emit(KEPT, batch.column(0).take(pa.array(at[fits])), lists(numbers[fits].astype(np.int32)))

    narrow = vectors.select(vectors[id_col].cast("long").alias("vec_id"), doubles(vectors[vec_col]).alias("x"))
    return narrow.mapInArrow(whole, "vec_id long, x array<int>")


def seeds_and_pool(rows: DataFrame, clusters: int, pool: int, salt: str = "3") -> tuple[np.ndarray, np.ndarray]:
    """The seeds by ascending hash and, behind them, the pool that pivots come from. Only the share
    of hashes that should hold them a few times over is ordered; if it holds too few, a larger one."""
    code = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    coded = rows.select(code.alias("code"), "x")
    wanted = clusters + pool
    share = 8 * wanted / max(1, rows.count())
    while True:
        near = coded.where(F.col("code") < f"{int(share * (1 << 64)):016x}") if share < 1 else coded
        first = near.orderBy("code", "x").limit(wanted).collect()
        if len(first) == wanted or share >= 1:
            break
        share *= 16
    whole = np.array([r.x for r in first], np.int64)
    return whole[:clusters], whole[clusters:]


def cluster(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    pivots: int = PIVOTS,
    dims: int = DIMS,
    scale: int = SCALE,
) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid (array<long>)."""
    spark = prepare(vectors.sparkSession)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
    rows = kept(vectors, id_col, vec_col, dims, scale)
    seeds, pool = seeds_and_pool(rows, clusters, POOL)
    if not len(seeds):
        return spark.createDataFrame([], schema)
    simplex = Simplex.of(seeds, pool.reshape(-1, dims), pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), dims).astype(np.int64)
            yield emit(PLACED, batch.column(0), batch.column(1), lists(simplex.apexes(x)))

    placed = saved(rows.mapInArrow(place, "vec_id long, x array<int>, apex array<double>"))
    width = len(simplex.pivots)

    def assign(centroids: np.ndarray):
        tops = simplex.apexes(centroids)

        def each(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                if batch.num_rows:
                    x = matrix(batch.column(1), dims).astype(np.int64)
                    number, distance, _ = nearest(x, matrix(batch.column(2), width), centroids, tops)
                    yield batch.column(0), x, number, distance

        return each

    def totals(centroids: np.ndarray, of_distances: bool) -> dict[int, tuple[int, list[int]]]:
        """Per cluster its size and the sums of its vectors, or of their distances."""
        each = assign(centroids)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            size: dict[int, int] = {}
            total: dict[int, np.ndarray] = {}
            for _, x, number, distance in each(batches):
                for k in np.unique(number):
                    mine = number == k
                    size[k] = size.get(k, 0) + int(mine.sum())
                    # Distances reach 2**62: they are added up in two halves.
                    part = np.stack([distance[mine] >> 31, distance[mine] & ((1 << 31) - 1)], 1) if of_distances else x[mine]
                    total[k] = total.get(k, 0) + part.sum(axis=0)
            found = sorted(size)
            yield emit(PARTIAL, found, [size[k] for k in found], [total[k] for k in found])

        sums = placed.mapInArrow(partial, "cluster int, n long, total array<long>")
        each_sum = sums.select("cluster", "n", F.posexplode("total").alias("dim", "part"))
        added = each_sum.groupBy("cluster", "dim").agg(
            F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total")
        )
        out: dict[int, tuple[int, dict[int, int]]] = {}
        for row in added.collect():  # clusters x dims numbers
            out.setdefault(row.cluster, (row.n, {}))[1][row.dim] = int(row.total)
        return {k: (n, [parts[d] for d in sorted(parts)]) for k, (n, parts) in out.items()}

    centroids = seeds.copy()
    for _ in range(rounds):
        for k, (n, total) in totals(centroids, False).items():
            centroids[k] = [t // n for t in total]
    final = totals(centroids, True)
    inertia = {k: (halves[0] << 31) + halves[1] for k, (_, halves) in final.items()}
    each = assign(centroids)

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, number, distance in each(batches):
            yield emit(ASSIGNED, ids, number, distance)

    def long_or_null(value: int):
        return F.lit(Decimal(value)).cast("decimal(38,0)").cast("long") if value <= MOST else F.lit(None).cast("long")

    of_cluster = F.create_map(*[c for k, v in inertia.items() for c in (F.lit(k), long_or_null(v))])
    vectors_of = F.create_map(*[c for k in inertia for c in (F.lit(k), F.array(*[F.lit(int(v)).cast("long") for v in centroids[k]]))])
    return placed.mapInArrow(result, "vec_id long, cluster int, distance long").select(
        "vec_id",
        "cluster",
        "distance",
        of_cluster[F.col("cluster")].alias("cluster_inertia"),
        long_or_null(sum(inertia.values())).alias("inertia"),
        vectors_of[F.col("cluster")].alias("centroid"),
    )


def digest(clustered: DataFrame) -> DataFrame:
    code = F.sha2(F.array_join(F.transform("centroid", lambda c: c.cast("string")), ","), 256)
    return clustered.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", code.alias("centroid_sha256"))


def _oracle() -> str:
    """The same rounds written out as SQL, over all distances."""
    parts = [
        """kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda c: coalesce(isfinite(c), false)))
    AND list_sum(list_transform(embedding, lambda c: floor(1024 * c::DOUBLE) ** 2)) <= 1152921504606846976)""",
        """c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256(concat('3:', coalesce(vec_id::VARCHAR, ''))), x) - 1)::INT AS cluster, x AS m
  FROM kept ORDER BY cluster LIMIT 8)""",
    ]
    far = "list_sum(list_transform(list_zip(x, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    for k in range(ROUNDS + 1):
        parts.append(
            f"""a{k} AS MATERIALIZED (
  SELECT r, any_value(vec_id) AS vec_id, any_value(x) AS x, arg_min(cluster, (d::HUGEINT * 8 + cluster)) AS cluster, min(d) AS d
  FROM (SELECT r, vec_id, x, cluster, {far} AS d FROM kept, c{k}) GROUP BY r)"""
        )
        parts.append(
            f"""c{k + 1} AS MATERIALIZED (
  WITH sums AS (
    SELECT cluster, i, sum(v)::BIGINT AS s, count(*) AS n
    FROM (SELECT cluster, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{k}) GROUP BY cluster, i),
  moved AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM sums GROUP BY cluster)
  SELECT cluster, coalesce(moved.m, c{k}.m) AS m FROM c{k} LEFT JOIN moved USING (cluster))"""
        )
    return (
        "WITH "
        + ",\n".join(parts[:-1])
        + f"""
SELECT vec_id, cluster::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} USING (cluster)"""
    )


ORACLE = _oracle()

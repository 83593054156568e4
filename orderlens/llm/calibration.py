"""Isotonic calibration of raw scores from binned counts, and sums of matrices over partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 512


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % parts


def monotone(counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing means closest to the bins' own."""
    blocks: list[list[float]] = []
    for n, s in zip(counts, sums, strict=True):
        blocks.append([n, s, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n2, s2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n2, blocks[-1][1] + s2, blocks[-1][2] + k2]
    return np.concatenate([np.full(k, s / n) for n, s, k in blocks])


def isotonic(scored: DataFrame, raw: str, label: str) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the map from raw score to probability, from at most ``BINS`` counted bins."""
    edges = scored.agg(F.min(raw), F.max(raw)).first()
    if edges[0] is None:
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    low, width = float(edges[0]), max(float(edges[1]) - float(edges[0]), 1e-9)
    place = F.least(F.floor((F.col(raw) - low) / width * BINS), F.lit(BINS - 1))
    rows = scored.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.sum(label).alias("s"), F.avg(raw).alias("x")).collect()
    rows.sort(key=lambda r: r["bin"])
    # One pseudo count of the overall share in each bin keeps thin bins off 0 and 1.
    n = np.array([r["n"] for r in rows], float)
    s = np.array([float(r["s"]) for r in rows])
    share = s.sum() / n.sum()
    fitted = monotone(n + 0.1, s + 0.1 * share)
    x = np.array([r["x"] for r in rows])
    # A slight slope keeps the order of raw scores within a pooled block.
    return x, np.clip(fitted + 1e-6 * np.arange(len(x)) / BINS, 0, 1)


def summed(parts: DataFrame) -> list[np.ndarray]:
    """Sums of equally shaped flat matrices; ``parts`` has a long ``part`` and a binary ``flat``.

    Two levels of at most a few dozen matrices each meet in one task, whatever the number of
    partitions; at most 32 sums come to the driver.
    """

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py()) for x in table.column("flat"))
        return pa.table({"part": table.column("part").slice(0, 1), "flat": pa.array([total.tobytes()], pa.binary())})

    near = parts.withColumn("part", F.floor(F.col("part") / 32)).groupBy("part").applyInArrow(add, "part long, flat binary")
    far = near.withColumn("part", F.col("part") % 32).groupBy("part").applyInArrow(add, "part long, flat binary")
    return [np.frombuffer(r["flat"]) for r in far.collect()]


def partition_sums(rows: DataFrame, columns: list[str], flat, size: int) -> np.ndarray:
    """``flat(batch)`` gives each batch's flat matrix; partitions add theirs before anything moves."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(size), False
        for batch in batches:
            if batch.num_rows:
                total += flat(batch)
                seen = True
        if seen:
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "flat": pa.array([total.tobytes()], pa.binary())}
            )

    found = summed(rows.select(*columns).mapInArrow(run, "part long, flat binary"))
    return np.sum(found, axis=0) if found else np.zeros(size)

"""Customer segments: k-means on standardised recency, frequency and value."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from marketlens.operators.prep import standardize
from marketlens.schemas import SEGMENT_FEATURES, SEGMENT_LABELS
from marketlens.sources.scratch import materialize

#: Places of the grid per standard deviation.
GRID = 1 << 22
#: Points of a block inside a task, and of a partition that is larger than a core's share.
BLOCK, PART_ROWS = 2048, 1 << 21
#: Sums that the driver adds up itself; of more tasks, executors add them up first.
SUMMED = 32


class TooFewRowsError(ValueError):
    """Fewer customers than clusters."""


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """[run, centre, point]: squared distances, coordinate by coordinate, so a row's do not depend on its block."""
    out = np.zeros((*centres.shape[:2], x.shape[1]))
    for d in range(len(x)):
        away = x[d] - centres[:, :, d, None]
        away *= away
        out += away
    return out


def _draws(ids: np.ndarray, runs: np.ndarray, step: int) -> np.ndarray:
    """[run, point]: exponential draws from 64-bit hashes of ids."""
    x = ids.astype(np.uint64)[None, :] ^ ((runs.astype(np.uint64) * np.uint64(1009) + np.uint64(step + 1)) * np.uint64(0x9E3779B97F4A7C15))[:, None]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return -np.log(((x >> np.uint64(11)) + 0.5) / 2.0**53)


def _point_blocks(points: DataFrame, at: list[str], n: int) -> RDD:
    """(ids, [coordinate, point]) in blocks that executors keep, in memory or on disk, dealt over the cores."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                numbers = [part.column(c).to_numpy().tobytes() for c in ("_id", *at)]
                yield pa.RecordBatch.from_arrays([pa.array([numbers[0]], pa.binary()), pa.array([b"".join(numbers[1:])], pa.binary())], names=["ids", "at"])

    def block(row: Row) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["at"], np.int64).reshape(len(at), -1).astype(float)

    parts = max(-(-n // PART_ROWS), min(-(-n // BLOCK), points.sparkSession.sparkContext.defaultParallelism))
    blocks = points.mapInArrow(packed, "ids binary, at binary").repartition(parts)
    return blocks.rdd.map(block).persist(StorageLevel.MEMORY_AND_DISK)


def _starts(blocks: RDD, d: int, k: int, restarts: int, seed: int) -> np.ndarray:
    """[run, centre, coordinate]: a point drawn by the hash of its id, then points drawn by squared distance to
    the centres so far. One scan draws the next centre of every run; a task sends one row per run."""
    runs, drawn = np.arange(seed, seed + restarts), np.zeros((restarts, 0, d))
    for step in range(k):

        def run(part: Iterator[tuple], step: int = step, drawn: np.ndarray = drawn) -> Iterator[list[tuple]]:
            least = None
            for ids, x in part:
                race = _draws(ids, runs, step)
                if step:
                    far = _squared(x, drawn).min(axis=1)
                    race = np.where(far > 0, race / np.maximum(far, 1e-300), 1e300)
                first = np.lexsort((*x[::-1], ids))  # the order on a tie
                best = first[race[:, first].argmin(axis=1)]
                found = [(race[r, i], ids[i], *x[:, i]) for r, i in enumerate(best)]
                least = [*map(min, least, found)] if least else found
            if least:
                yield least

        least = blocks.mapPartitions(run).treeReduce(lambda a, b: [*map(min, a, b)], _depth(blocks))
        drawn = np.concatenate([drawn, np.array([row[2:] for row in least], float)[:, None, :]], axis=1)
    return drawn


def _depth(blocks: RDD) -> int:
    return 1 if blocks.getNumPartitions() <= SUMMED else 2


def _cluster_sums(blocks: RDD, centres: np.ndarray) -> dict[tuple[int, int], tuple[int, ...]]:
    """(run, cluster) -> size and sums of coordinates, all runs in one scan; a task sends a row per run and cluster."""
    runs, k, size = centres.shape

    def run(part: Iterator[tuple]) -> Iterator[np.ndarray]:
        total = np.zeros((1 + size, runs * k), np.int64)
        for _, x in part:
            slot = (_squared(x, centres).argmin(axis=1) + (np.arange(runs) * k)[:, None]).reshape(-1)
            total[0] += np.bincount(slot, minlength=runs * k)
            for d in range(size):
                # Whole numbers far below 2**53: exact in doubles.
                total[d + 1] += np.bincount(slot, np.tile(x[d], runs), runs * k).astype(np.int64)
        yield total

    sums = blocks.mapPartitions(run).treeReduce(np.add, _depth(blocks))
    return {(i // k, i % k): tuple(int(v) for v in sums[:, i]) for i in np.flatnonzero(sums[0]).tolist()}


def _nearest(at: list[str], centres: np.ndarray) -> Column:
    """Which centre is nearest; the lower number on a tie."""
    away = [sum(((F.col(a) - float(x)) * (F.col(a) - float(x)) for a, x in zip(at, centre, strict=True)), F.lit(0.0)) for centre in centres]
    return F.least(*[F.struct(d.alias("d"), F.lit(c).alias("c")) for c, d in enumerate(away)]).getField("c")


def cluster_customers(features: DataFrame, k: int = 4, restarts: int = 20, seed: int = 42, steps: int = 300) -> DataFrame:
    """Customers with a ``cluster`` from the best of several k-means runs.

    All runs go side by side: one scan assigns every point in all runs that still move and adds up
    their clusters, so a step costs one job and brings k rows per run to the driver. Points are whole
    multiples of a fine grid on the scaled features and starts come from hashes of ids, so sums, centres
    and the best run are exact and do not depend on partitions.
    """
    at = [f"_at{i}" for i in range(len(SEGMENT_FEATURES))]
    scaled = standardize(features.dropna(subset=SEGMENT_FEATURES), SEGMENT_FEATURES)
    placed = scaled.select(*features.columns, *[F.round(F.coalesce(F.col(f"{c}_z"), F.lit(0.0)) * GRID).cast("long").alias(a) for c, a in zip(SEGMENT_FEATURES, at, strict=True)])
    placed = materialize(placed)
    points = placed.select(F.xxhash64("customer_unique_id").alias("_id"), *at)
    n = points.count()
    if n < k:
        raise TooFewRowsError(f"{n} customers cannot form {k} segments.")
    blocks = _point_blocks(points, at, n)
    centres = _starts(blocks, len(at), k, restarts, seed)
    sums: list[dict[int, tuple[int, ...]]] = [{} for _ in range(restarts)]
    moving = list(range(restarts))
    for _ in range(steps):
        if not moving:
            break
        found = _cluster_sums(blocks, centres[moving])
        still = []
        for i, r in enumerate(moving):
            now = {c: found[i, c] for c in range(k) if (i, c) in found}
            if now != sums[r]:
                still.append(r)
            sums[r] = now
            for c, (size, *total) in now.items():  # a centre without points stays where it is
                centres[r, c] = [t / size for t in total]
        moving = still
    blocks.unpersist()
    # The least sum of squares is the largest sum of squared cluster sums over sizes.
    spread = [sum(Fraction(total * total, size) for size, *totals in run.values() for total in totals) for run in sums]
    best = centres[max(range(restarts), key=lambda r: (spread[r], -r))]
    return placed.select(*features.columns, _nearest(at, best).alias("cluster"))


def _average_rank(c: str, descending: bool = False) -> Column:
    """Rank with ties at their mean position."""
    order = F.col(c).desc() if descending else F.col(c).asc()
    return F.rank().over(Window.orderBy(order)) + (F.count(F.lit(1)).over(Window.partitionBy(c)) - 1) / 2


def assign_segment_names(profile: DataFrame) -> DataFrame:
    """Name clusters by summed ranks: revenue and orders high, recency low is best.

    Works on one row per cluster. Positions past the last label repeat it.
    """
    scored = profile.withColumn(
        "value_score",
        _average_rank("total_revenue", True) + _average_rank("order_count", True) + _average_rank("recency_days"),
    )
    position = F.row_number().over(Window.orderBy("value_score", "cluster"))
    labels = F.array(*[F.lit(label) for label in SEGMENT_LABELS])
    return scored.withColumn(
        "segment_name", F.element_at(labels, F.least(position, F.lit(len(SEGMENT_LABELS))))
    ).drop("value_score")


def cluster_profile(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy("cluster").agg(
        F.count_distinct("customer_unique_id").alias("customers"),
        F.avg("recency_days").alias("recency_days"),
        F.avg("order_count").alias("order_count"),
        F.avg("total_revenue").alias("total_revenue"),
        F.avg("avg_order_value").alias("avg_order_value"),
        F.avg("churn_label").alias("churn_rate"),
    )


def name_customers(clustered: DataFrame, summary: DataFrame) -> DataFrame:
    """Attach segment names; the lookup has one row per cluster."""
    return clustered.join(F.broadcast(summary.select("cluster", "segment_name")), "cluster", "left").select(
        *clustered.columns, "segment_name"
    )


def segment_customers(clustered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Customers with segment names, and the named profile."""
    summary = assign_segment_names(cluster_profile(clustered))
    return name_customers(clustered, summary), summary

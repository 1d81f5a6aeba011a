"""Boosted regression trees on binned features, grown from histograms that Spark adds up.

Binned rows lie in blocks that executors keep, in memory or on disk. A level of a tree is one job over them: tasks count
rows, gradients and weights per (node, feature, bin), Spark adds these up and the driver picks each node's split, so
nothing that grows with the rows leaves the executors. Only the smaller child of a node is counted; what it leaves of its
parent is the other one. Features of two bins that are never both in their upper bin, as the entries of one category are,
share a line of a block: it holds the place of the one that is, so a tree's work grows with the categories, not with their levels.
Gradients and weights are whole numbers on a fine grid, rows and columns of a tree are drawn by hashes, and cut points come from exact counts:
the same rows give the same trees, however they are partitioned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

from marketlens.sources.scratch import materialize

#: Rows of a block inside a task; sums over one are exact in doubles.
BLOCK = 4096
#: Bins per feature.
BINS = 32
#: Low bits of a double that cut points leave out: values closer than a thousandth of themselves share a bin.
COARSE = 42
#: Bytes of binned rows in a partition.
PART_BYTES = 64 << 20
#: Trees whose values are added anew in every job before the running predictions are kept.
STORE_EVERY = 8
#: Histograms that the driver adds up itself; of more tasks, executors add them up first.
SUMMED = 32
#: Trees that a block's rows walk down at once.
WALKED = 8
_ALL_LEFT = 127

#: Per node: line of the block, the least code of the rows that go right, and how far above it their codes reach.
Tests = np.ndarray


@dataclass
class BoostedModel:
    cuts: list[np.ndarray]
    base: float
    rate: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def predict(self, rows: DataFrame, x: str, name: str, bins: bool = False) -> DataFrame:
        """Add the prediction for the array column ``x``, or for its bins; all other columns pass.

        With ``bins`` the column ``x`` then holds the bins of its values, a byte each: models with the same cut points take them too.
        """
        cuts, base, rate, trees = self.cuts, self.base, self.rate, [_plain(tree) for tree in self.trees]
        fields = [StructField(x, BinaryType()) if bins and f.name == x else f for f in rows.schema.fields]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(start, BLOCK)
                    codes = _codes(part, x, cuts)
                    value = _added(np.full(part.num_rows, base), codes, trees, rate)
                    passed = [_packed(codes) if bins and c == x else part.column(c) for c in part.schema.names]
                    yield pa.RecordBatch.from_arrays([*passed, pa.array(value)], names=[*part.schema.names, name])

        return rows.mapInArrow(run, StructType([*fields, StructField(name, DoubleType())]))


def _numbers(batch: pa.RecordBatch, name: str, size: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, size)


def _codes(batch: pa.RecordBatch, name: str, cuts: list[np.ndarray]) -> np.ndarray:
    """[feature, row]: bin of every value, how many cut points it reaches; a column of bins is taken as it is."""
    column = batch.column(name)
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        held = np.frombuffer(b"".join(column.to_numpy(zero_copy_only=False)), np.int8)
        return np.ascontiguousarray(held.reshape(batch.num_rows, len(cuts)).T)
    x = _numbers(batch, name, len(cuts))
    out = np.zeros(x.shape[::-1], np.int8)
    for f, at in enumerate(cuts):
        out[f] = np.searchsorted(at, x[:, f], "right")
    return out


def _packed(codes: np.ndarray) -> pa.Array:
    """The bins of every row as bytes."""
    size, n = codes.shape
    ends = pa.py_buffer(np.arange(0, (n + 1) * size, size, np.int32) if size else np.zeros(n + 1, np.int32))
    return pa.Array.from_buffers(pa.binary(), n, [None, ends, pa.py_buffer(codes.T.tobytes())])


def _plain(tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[Tests, np.ndarray]:
    """Tests and leaves of a tree on lines that hold a feature each."""
    feature, cut, leaf = tree
    return np.array([feature, cut + 1, _ALL_LEFT - np.minimum(cut + 1, _ALL_LEFT)]), leaf


def _walk(codes: np.ndarray, tests: list[Tests], levels: int) -> np.ndarray:
    """[tree, row]: number of each row's node after so many levels."""
    node, turns = np.zeros((len(tests), codes.shape[1]), np.uint8 if levels <= 8 else np.uint32), []
    for level in range(levels):
        at = slice((1 << level) - 1, (2 << level) - 1)
        lines, least, reach = (np.array([t[i, at] for t in tests]) for i in range(3))
        above = codes.view(np.uint8).take(lines, 0)
        above -= least.astype(np.uint8)[:, :, None]  # codes below the least one wrap to large numbers
        right = above <= reach.astype(np.uint8)[:, :, None]
        for turn in turns:  # the earlier turns, from the root, halve the nodes in question
            low, high = right[:, : right.shape[1] // 2], right[:, right.shape[1] // 2 :]
            right = low ^ (turn & (low ^ high))
        turns.append(right)
        node += node
        node += right[:, 0]
    return node


def _added(value: np.ndarray, codes: np.ndarray, trees: list[tuple[Tests, np.ndarray]], rate: float) -> np.ndarray:
    for first in range(0, len(trees), WALKED):
        some = trees[first : first + WALKED]
        for node, (_, leaf) in zip(_walk(codes, [t for t, _ in some], len(some[0][1]).bit_length() - 1), some, strict=True):
            value = value + (rate * leaf).take(node)
    return value


def _drawn(ids: np.ndarray, seed: int, tree: int, share: float) -> np.ndarray:
    """Which rows a tree sees: a hash of (id, seed, tree)."""
    x = ids.astype(np.uint64) ^ np.uint64((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(11) < share * 2.0**53


def _flip(bits: np.ndarray) -> np.ndarray:
    """Bits of doubles as whole numbers in the order of the doubles, and back."""
    return bits ^ ((bits >> 63) & np.int64(2**63 - 1))


def cut_points(rows: DataFrame, x: str, size: int, bins: int = BINS) -> list[np.ndarray]:
    """Increasing cut points per feature, near equal shares of the rows; none for a constant feature.

    Values are counted by their leading bits, so the counts, and with them the cut points, are exact.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = _flip((_numbers(batch, x, size) + 0.0).view(np.int64)) >> COARSE
            for f in range(size):
                key, n = np.unique(keys[:, f], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), f)), pa.array(key), pa.array(n)], names=["f", "key", "n"])

    counts = rows.select(x).mapInArrow(run, "f long, key long, n long").groupBy("f", "key").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy("f")
    placed = counts.select("f", "key", "n", F.sum("n").over(whole.orderBy("key")).alias("upto"), F.sum("n").over(whole).alias("total"))
    share = lambda c: F.floor(c * bins / F.col("total"))
    crossed = share(F.col("upto")) > share(F.col("upto") - F.col("n"))
    # A feature whose rows all but one bin's worth share their last value still has a cut below it.
    found = placed.where("upto < total").groupBy("f").agg(F.max("key").alias("last"), F.collect_list(F.when(crossed, F.col("key"))).alias("keys")).collect()
    cuts = [np.zeros(0)] * size
    for row in found:
        keys = np.array(sorted(row["keys"] or [row["last"]]), np.int64)
        cuts[row["f"]] = _flip((keys + 1) << COARSE).view(np.float64)
    return cuts


@dataclass(frozen=True)
class _Lines:
    """The lines of a block: each a feature, or features of two bins that share it, in the order of their codes from 1 on."""

    members: list[list[int]]
    #: Codes of each line, and where they begin in a row of counts.
    sizes: list[int]
    starts: list[int]
    #: Line of every feature that has cut points, and its code there: 0 for a feature that has a line of its own.
    places: dict[int, tuple[int, int]]

    def pack(self, codes: np.ndarray) -> np.ndarray:
        out = np.empty((len(self.members), codes.shape[1]), np.int8)
        for line, features in enumerate(self.members):
            out[line] = codes[features[0]]
            for code, f in enumerate(features[1:], 2):
                out[line] += codes[f] * np.int8(code)
        return out

    def tests(self, feature: np.ndarray, cut: np.ndarray) -> Tests:
        """The tests of a tree's nodes on these lines."""
        out = []
        for f, c in zip(feature.tolist(), cut.tolist(), strict=True):
            line, code = self.places[f] if c < _ALL_LEFT else (0, 0)
            out.append((line, code, 0) if code else (line, c + 1, max(0, _ALL_LEFT - c - 1)))
        return np.array(out).T

    def unpack(self, counts: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """[node, feature, bin, ...] from [node, place, ...]."""
        out = np.zeros((len(counts), len(columns), BINS, *counts.shape[2:]), np.int64)
        whole = counts[:, : self.sizes[0]].sum(axis=1)
        for i, f in enumerate(columns.tolist()):
            line, code = self.places[f]
            at = self.starts[line]
            if code:
                out[:, i, 1] = counts[:, at + code]
                out[:, i, 0] = whole - out[:, i, 1]
            else:
                out[:, i, : self.sizes[line]] = counts[:, at : at + self.sizes[line]]
        return out


def _sum(found: RDD) -> np.ndarray:
    return np.sum(found.collect(), axis=0) if found.getNumPartitions() <= SUMMED else found.treeReduce(np.add, 2)


def _lines(blocks: RDD, cuts: list[np.ndarray]) -> _Lines:
    """Lines for the features with cut points; one scan of (feature, row) codes finds the pairs of two-bin features that meet in a row."""
    two = [f for f, at in enumerate(cuts) if len(at) == 1]

    def run(part: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
        total = np.zeros((len(two), len(two)), np.int64)
        for codes in part:
            upper = codes[two].astype(np.float32)  # counts of a block are exact
            total += (upper @ upper.T).astype(np.int64)
        yield total

    meet = _sum(blocks.mapPartitions(run)) > 0 if len(two) > 1 else np.ones((len(two), len(two)), bool)
    shared: list[list[int]] = []
    for i in range(len(two)):
        free = (s for s in shared if len(s) < _ALL_LEFT and not meet[i, s].any())
        line = next(free, None)
        if line is None:
            shared.append([i])
        else:
            line.append(i)
    members = [[f] for f, at in enumerate(cuts) if len(at) > 1] + [[two[i] for i in s] for s in shared]
    sizes = [len(cuts[m[0]]) + 1 if len(m) == 1 else len(m) + 1 for m in members]
    places = {f: (line, code if len(m) > 1 else 0) for line, m in enumerate(members) for code, f in enumerate(m, 1)}
    return _Lines(members, sizes, [0, *np.cumsum(sizes).tolist()[:-1]], places)


def _histogram(blocks: RDD, trees: list[tuple[Tests, np.ndarray]], tests: Tests, level: int, fewer: list[int], lines: _Lines, draw: tuple[int, int, float], rate: float, scales: tuple[float, float]) -> np.ndarray:
    """[node, place, (rows, gradient, weight)] of the root or of one child of each node above, in whole numbers: the right one where ``fewer`` is 1."""
    nodes, each, starts = max(1, 1 << level >> 1), sum(lines.sizes), np.array(lines.starts)[:, None]
    counted = np.zeros(1 << level, bool)
    counted[2 * np.arange(nodes) + fewer if level else 0] = True

    def run(part: Iterator[tuple]) -> Iterator[np.ndarray]:
        total = np.zeros((3, nodes * each), np.int64)
        for codes, ids, y, w, value in part:
            node = _walk(codes, [tests], level)[0]
            seen = np.flatnonzero(counted[node])
            seen = seen[_drawn(ids[seen], *draw)]
            if not len(seen):
                continue
            codes = codes.take(seen, 1)
            w = w if len(w) == 1 else w[seen]
            gradient = np.rint((y[seen] - _added(value[seen], codes, trees, rate)) * w * scales[0])
            weight = np.rint(w * scales[1])
            slot = codes + starts
            if level > 1:
                slot += (node[seen] >> 1) * np.int64(each)
            slot = slot.reshape(-1)
            count = np.bincount(slot, minlength=nodes * each)
            total[0] += count
            total[1] += np.bincount(slot, np.tile(gradient, len(codes)), nodes * each).astype(np.int64)
            if len(weight) == 1:
                total[2] += count * int(weight[0])
            else:
                total[2] += np.bincount(slot, np.tile(weight, len(codes)), nodes * each).astype(np.int64)
        yield total

    return np.moveaxis(_sum(blocks.mapPartitions(run)).reshape(3, nodes, each), 0, -1)


def _ratio(gradient: np.ndarray, weight: np.ndarray, penalty: float) -> np.ndarray:
    return np.divide(gradient, weight + penalty, out=np.zeros_like(gradient), where=weight + penalty > 0)


def _splits(counts: np.ndarray, scales: tuple[float, float], penalty: float, least_weight: float) -> Iterator[tuple[int, int, float, float]]:
    """Per node: feature, bin and the values left and right of the split; the first of equal gains, no split without gain."""
    left = counts.cumsum(axis=2)
    whole = left[:, :, -1:, :]
    n, g, w = left[..., 0], left[..., 1] / scales[0], left[..., 2] / scales[1]
    n_all, g_all, w_all = whole[..., 0], whole[..., 1] / scales[0], whole[..., 2] / scales[1]
    g_right, w_right = (whole[..., 1] - left[..., 1]) / scales[0], (whole[..., 2] - left[..., 2]) / scales[1]
    gain = _ratio(g * g, w, penalty) + _ratio(g_right * g_right, w_right, penalty) - _ratio(g_all * g_all, w_all, penalty)
    allowed = (n > 0) & (n < n_all) & (w >= least_weight) & (w_right >= least_weight)
    gain = np.where(allowed, gain, -np.inf)
    for node in range(len(counts)):
        f, b = np.unravel_index(gain[node].argmax(), gain[node].shape)
        if gain[node, f, b] > 0:
            yield int(f), int(b), float(_ratio(g, w, penalty)[node, f, b]), float(_ratio(g_right, w_right, penalty)[node, f, b])
        else:
            yield 0, _ALL_LEFT, float(_ratio(g_all, w_all, penalty)[node, 0, 0]), 0.0


def fit_boosted(
    rows: DataFrame,
    size: int,
    rounds: int,
    seed: int,
    depth: int = 3,
    rate: float = 0.05,
    row_share: float = 0.9,
    column_share: float = 0.9,
    penalty: float = 1.0,
    least_weight: float = 1.0,
    cuts: list[np.ndarray] | None = None,
) -> BoostedModel:
    """Least-squares boosting of ``y`` with weights ``w`` on the array ``x`` of ``size`` doubles.

    ``id`` (bigint) decides by hash which rows a tree sees; every tree draws its columns once. ``penalty`` is added to
    the weight of a leaf, and both sides of a split weigh ``least_weight`` at least. Rows without y or w do not count.
    ``cuts`` are the cut points of an earlier model of the same rows; without them they are found here. With them ``x`` may
    hold bins, as ``predict`` leaves them.
    """
    rows = rows.select("id", "x", F.col("y").cast("double").alias("y"), F.col("w").cast("double").alias("w")).dropna()
    n, top, heavy = rows.agg(F.count("*"), F.max(F.abs("y")), F.max("w")).first()
    if not n or not heavy > 0:
        raise ValueError("Boosting needs rows with a positive weight.")
    levels = min(39, 61 - int(n).bit_length())
    largest = top * heavy if top * heavy > 1e-200 else 1.0
    # Ten bits are left for residuals that grow before they fall.
    scales = tuple(2.0 ** (levels - room - int(np.ceil(np.log2(most)))) for room, most in ((10, largest), (0, heavy)))
    whole = lambda c, s: F.sum(F.rint(c * F.lit(s)).cast("long"))
    g, w = rows.agg(whole(F.col("y") * F.col("w"), scales[0]), whole(F.col("w"), scales[1])).first()
    model = BoostedModel(cut_points(rows, "x", size) if cuts is None else cuts, (g / scales[0]) / (w / scales[1]), rate)
    cuts, base = model.cuts, model.base

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            even = -(-batch.num_rows // max(1, -(-batch.num_rows // BLOCK)))  # blocks of a batch are of one size
            for start in range(0, batch.num_rows, max(1, even)):
                part = batch.slice(start, even)
                numbers = [part.column(c).to_numpy().tobytes() for c in ("id", "y", "w")]
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in (_codes(part, "x", cuts).tobytes(), *numbers)], names=["codes", "id", "y", "w"])

    def block(row: Row) -> tuple:
        ids, y, w = (np.frombuffer(row[c], kind) for c, kind in (("id", np.int64), ("y", np.float64), ("w", np.float64)))
        codes = lines.pack(np.frombuffer(row["codes"], np.int8).reshape(size, len(ids)))
        return codes, ids, y, w[:1] if (w == w[0]).all() else w, np.full(len(ids), base)

    def advanced(trees: list):
        return lambda b: (*b[:4], _added(b[4], b[0], trees, rate))

    table = materialize(rows.mapInArrow(binned, "codes binary, id binary, y binary, w binary"))
    usable = np.flatnonzero([len(c) > 0 for c in cuts])
    if not len(usable):
        return model
    lines = _lines(table.select("codes").rdd.map(lambda row: np.frombuffer(row["codes"], np.int8).reshape(size, -1)), cuts)
    # A task a core, more where a part would grow large; whole rounds of the cores then.
    cores, full = rows.sparkSession.sparkContext.defaultParallelism, -(-n * (len(lines.members) + 32) // PART_BYTES)
    parts = min(-(-n // BLOCK), cores) if full <= cores else -(-full // cores) * cores
    blocks, kept, grown = table.repartition(max(parts, full)).rdd.map(block).persist(StorageLevel.MEMORY_AND_DISK), 0, []
    for t in range(rounds):
        if t - kept == STORE_EVERY:
            later = blocks.map(advanced(grown[kept:])).persist(StorageLevel.MEMORY_AND_DISK)
            later.count()
            blocks.unpersist()
            blocks, kept = later, t
        take = max(1, round(column_share * len(usable)))
        columns = np.sort(np.random.default_rng([seed, t]).choice(usable, take, replace=False))
        feature, cut, leaf = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, _ALL_LEFT), np.zeros(1 << depth)
        fewer: list[int] = []
        for level in range(depth):
            found = _histogram(blocks, grown[kept:], lines.tests(feature, cut), level, fewer, lines, (seed, t, row_share), rate, scales)
            counts = lines.unpack(found, columns)
            if level:
                pairs = [(other, own) if right else (own, other) for right, own, other in zip(fewer, counts, parents - counts, strict=True)]
                counts = np.array(pairs).reshape(-1, *counts.shape[1:])
            parents, fewer = counts, []
            for node, (f, b, low, high) in enumerate(_splits(counts, scales, penalty, least_weight)):
                at = (1 << level) - 1 + node
                feature[at], cut[at] = columns[f], b
                rows_of = counts[node, f, :, 0]
                fewer.append(int(2 * rows_of[: b + 1].sum() > rows_of.sum()))
                if level == depth - 1:
                    leaf[2 * node : 2 * node + 2] = low, high
        model.trees.append((feature, cut, leaf))
        grown.append((lines.tests(feature, cut), leaf))
    blocks.unpersist()
    return model

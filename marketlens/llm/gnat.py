"""Hard-negative mining through a GNAT-style multiway hyperplane tree.

Each inner node has split points; a vector belongs to the nearest one. For every pair of siblings the node
keeps the range of distances from the one's split point to all vectors below the other. A query knows an
annulus: its window of scores as distances. By the triangle inequality a sibling whose ranges put it outside
the annulus of every window is left out with all below it; the leaves that remain are computed exactly.

Scores are inner products, so distances are taken where larger scores mean smaller distances: every vector
gets one more component, the square root of the largest squared length less its own, and queries get 0.
The tree's split points come from a bounded sample (SAMPLE vectors); the ranges cover every vector, so
nothing is missed. The sample also bounds each query's k-th score from below, which narrows its annulus.

Leaves are cut into blocks of about the square root of the table, so a group of copies is many blocks; a task
reads one block and streams the queries that reach it through matrix products. Top-k lists of blocks meet
in one window per query.

Defined results: rows without vec_id, without label, with a null vector, or with a null, non-finite or very
large component (SCALE * x beyond 62 bits) take no part. Of rows with equal vec_id the one with the least
(label, vector) takes part. A shorter vector counts as filled up with zeros; an empty one scores 0 with all.
Equal scores go by vec_id. Scores beyond 64 bits are clipped. An anchor without positives has no rows, nor
has a pair whose window is empty. Empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import store

SCALE = 256
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Split points of a node, vectors of the sample, sample vectors from which on a subtree is split.
FAN, SAMPLE, LEAF_SAMPLE = 8, 2048, 32
#: Rows of a block: twice the square root of the table between these bounds.
LEAST_BLOCK, MOST_BLOCK = 256, 1 << 16
#: Scores held at once while a block answers queries, and queries routed at once.
SCORES_AT_ONCE, ROUTED_AT_ONCE = 1 << 21, 64
_FAR = (1 << 63) - 1


def padded(lists: pa.Array, width: int) -> np.ndarray:
    """Integer vectors as rows of `width` numbers, filled up with zeros."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows; clipped where they leave 64 bits."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if top < 2**62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), -_FAR - 1, _FAR).astype(np.int64)


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (points * points).sum(axis=1)[None, :] - 2 * (x @ points.T)
    return np.sqrt(np.maximum(square, 0))


@dataclass
class Tree:
    """points[node]: split points; children[node]: inner nodes as their number, leaves as ~leaf. longest: largest squared length."""

    longest: float
    points: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaves: int = 0
    low: list[np.ndarray] = field(default_factory=list)
    high: list[np.ndarray] = field(default_factory=list)

    def lifted(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        """Vectors with the component that turns scores into distances."""
        x = vectors.astype(np.float64)
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.longest - (x * x).sum(axis=1), 0))
        return np.column_stack([x, more])

    def grow(self, sample: np.ndarray) -> int:
        """Split lifted sample vectors; the number of the new node, or ~leaf."""
        chosen = sample[:0]
        if len(sample) > LEAF_SAMPLE:
            # Of a few candidates those that stand farthest apart.
            few = np.unique(sample[: 3 * FAN], axis=0)
            picked, far = [0], distances(few, few[:1])[:, 0]
            while len(picked) < FAN and far.max() > 0:
                picked.append(int(far.argmax()))
                far = np.minimum(far, distances(few, few[picked[-1:]])[:, 0])
            chosen = few[picked]
        if len(chosen) < 2:
            self.leaves += 1
            return ~(self.leaves - 1)
        node = len(self.points)
        self.points.append(chosen)
        self.children.append([])
        to = distances(sample, chosen).argmin(axis=1)
        self.children[node] = [self.grow(sample[to == j]) for j in range(len(chosen))]
        return node

    def walk(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(node, rows of x that reach it, their distances to its split points, the child that each goes to)."""
        stack = [(0, np.arange(len(x)))] if self.points else []
        while stack:
            node, rows = stack.pop()
            away = distances(x[rows], self.points[node])
            to = away.argmin(axis=1)
            yield node, rows, away, to
            stack += [(child, rows[to == j]) for j, child in enumerate(self.children[node]) if child >= 0 and (to == j).any()]

    def empty_ranges(self) -> np.ndarray:
        """[node, least or negated largest, split point, child]: nothing seen yet."""
        return np.full((len(self.points), 2, FAN, FAN), np.inf)

    def reached(self, x: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
        """[query, leaf]: leaves that may hold a vector between the radii of some window of the query.

        inner and outer: [query, window]; a window that is none has an outer radius below its inner one.
        """
        out = np.zeros((len(x), self.leaves), bool)
        if not self.points:
            out[:] = (outer >= inner).any(axis=1)[:, None]
            return out
        slack = 1e-5 * math.sqrt(self.longest) + 1e-9
        stack = [(0, np.flatnonzero((outer >= inner).any(axis=1)))]
        while stack:
            node, rows = stack.pop()
            away = distances(x[rows], self.points[node])
            for j, child in enumerate(self.children[node]):
                low, high = self.low[node][:, j], self.high[node][:, j]
                if low[0] > high[0]:  # no vector below
                    continue
                nearest = np.maximum(low - away, away - high).max(axis=1)[:, None] - slack
                farthest = (away + high).min(axis=1)[:, None] + slack
                meets = ((nearest <= outer[rows]) & (farthest >= inner[rows]) & (inner[rows] <= outer[rows])).any(axis=1)
                if child < 0:
                    out[rows[meets], ~child] = True
                elif meets.any():
                    stack.append((child, rows[meets]))
        return out


def annulus(tree: Tree, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Radii of windows of scores: distance ** 2 = length ** 2 + longest - 2 * score."""
    base = ((x * x).sum(axis=1) + tree.longest)[:, None]
    radius = lambda score: np.sqrt(np.maximum(base - 2 * score.astype(np.float64), 0))
    return radius(high), np.where(low <= high, radius(low), -1.0)


@dataclass
class Rows:
    """Vectors with ids and label texts; answers windows of scores."""

    ids: np.ndarray
    labels: list[str]
    vectors: np.ndarray

    def __post_init__(self) -> None:
        names = {label: i for i, label in enumerate(dict.fromkeys(self.labels))}
        self.names, self.codes = names, np.array([names[label] for label in self.labels], np.int64)

    def scores(self, ids: np.ndarray, labels: list[str], vectors: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """(scores, mask of the pairs that count: same or other label, never the query itself)."""
        codes = np.array([self.names.get(label, -1) for label in labels], np.int64)
        alike = codes[:, None] == self.codes[None, :]
        return products(vectors, self.vectors), (alike if same else ~alike) & (ids[:, None] != self.ids[None, :])

    def floor(self, scores: np.ndarray, counts: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
        """low, raised to the k-th best counted score within each window where there are so many."""
        out = low.copy()
        if len(self.ids) < k:
            return out
        for w in range(low.shape[1]):
            inside = counts & (scores >= low[:, w, None]) & (scores <= high[:, w, None])
            enough = np.flatnonzero(inside.sum(axis=1) >= k)
            if len(enough):
                kept = np.where(inside[enough], scores[enough], -_FAR - 1)
                out[enough, w] = np.partition(kept, len(self.ids) - k, axis=1)[:, len(self.ids) - k]
        return out

    def best(self, scores: np.ndarray, counts: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """(query, window, row) of the k best counted rows of every window; equal scores by id."""
        found = []
        for w in range(low.shape[1]):
            i, j = np.nonzero(counts & (scores >= low[:, w, None]) & (scores <= high[:, w, None]))
            order = np.lexsort((self.ids[j], ~scores[i, j], i))
            i, j = i[order], j[order]
            starts = np.searchsorted(i, i, "left")
            top = np.arange(len(i)) - starts < k
            found.append((i[top], np.full(int(top.sum()), w), j[top]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def window_arrays(column: pa.Array) -> tuple[np.ndarray, ...]:
    """(id, score, low, high) as [query, window]; missing windows hold nothing."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    flat, out = column.flatten(), []
    for name, empty in (("id", 0), ("score", 0), ("low", 1), ("high", 0)):
        values = np.full((len(sizes), int(sizes.max(initial=0))), empty, np.int64)
        values[rows, at] = flat.field(name).to_numpy(zero_copy_only=False)
        out.append(values)
    return tuple(out)


class Index:
    """Tree over rows (vec_id, label string, q array<long>), with every row filed under its leaf."""

    def __init__(self, rows: DataFrame) -> None:
        square = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        facts = rows.agg(F.count("*").alias("n"), F.max(square).alias("longest"), F.max(F.size("q")).alias("width")).first()
        self.n, self.width = facts.n, max(1, facts.width or 0)
        sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()  # SAMPLE rows reach the driver
        vectors = padded(sample.column("q").combine_chunks(), self.width)
        self.sample = Rows(sample.column("vec_id").to_numpy(), sample.column("label").to_pylist(), vectors)
        self.tree = tree = Tree(facts.longest or 0.0)
        # Copies in the sample would only make the tree deep.
        tree.grow(tree.lifted(vectors[np.sort(np.unique(vectors, axis=0, return_index=True)[1])]))
        self.block = min(MOST_BLOCK, max(LEAST_BLOCK, 2 * math.isqrt(self.n)))

        filed = store(self._filed(rows), "leaves")
        # As many rows as the tree has ranges, and one per leaf.
        ranges = tree.empty_ranges().reshape(-1)
        for at, least in filed.where("leaf < 0").select(F.posexplode("ranges").alias("at", "v")).groupBy("at").agg(F.min("v").alias("v")).collect():
            ranges[at] = least
        ranges = ranges.reshape(-1, 2, FAN, FAN)
        tree.low = [r[0, : len(p)] for r, p in zip(ranges, tree.points, strict=True)]
        tree.high = [-r[1, : len(p)] for r, p in zip(ranges, tree.points, strict=True)]
        counts = {r.leaf: r["count"] for r in filed.where("leaf >= 0").groupBy("leaf").count().collect()}
        self.blocks = np.array([-(-counts.get(leaf, 0) // self.block) for leaf in range(tree.leaves)], np.int64)
        sizes = F.element_at(F.array(*[F.lit(int(b)) for b in np.maximum(self.blocks, 1)]), F.col("leaf") + 1)
        self.rows = filed.where("leaf >= 0").select("leaf", F.pmod(F.xxhash64("vec_id"), sizes).cast("int").alias("block"), F.col("vec_id").alias("id"), "label", "q")

    def _filed(self, rows: DataFrame) -> DataFrame:
        held, width = rows.sparkSession.sparkContext.broadcast(self.tree), self.width
        schema = "vec_id long, label string, q array<long>, leaf int, ranges array<double>"
        kinds = (pa.int64(), pa.string(), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.float64()))
        names = ["vec_id", "label", "q", "leaf", "ranges"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = held.value
            ranges = tree.empty_ranges()
            for batch in batches:
                x = tree.lifted(padded(batch.column(2), width))
                leaf = np.zeros(len(x), np.int32)
                for node, reach, away, to in tree.walk(x):
                    m = away.shape[1]
                    for j in range(m):
                        mine = to == j
                        if mine.any():
                            ranges[node, 0, :m, j] = np.minimum(ranges[node, 0, :m, j], away[mine].min(axis=0))
                            ranges[node, 1, :m, j] = np.minimum(ranges[node, 1, :m, j], -away[mine].max(axis=0))
                            if tree.children[node][j] < 0:
                                leaf[reach[mine]] = ~tree.children[node][j]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf), pa.nulls(len(x), kinds[4])], names=names)
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((None, None, None, -1, ranges.reshape(-1)), kinds, strict=True)], names=names)

        return rows.select("vec_id", "label", "q").mapInArrow(run, schema)

    def search(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """(query, window id, window score, id, score): k best rows of every window of the queries, a superset of them.

        queries: id, label, q, windows array<struct<id, score, low, high>>; same: rows of the query's label count,
        else those of any other.
        """
        spark = queries.sparkSession
        held, width = spark.sparkContext.broadcast((self.tree, self.sample, self.blocks)), self.width
        sent = "leaf int, block int, id long, label string, q array<long>, windows array<struct<id: long, score: long, low: long, high: long>>"

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, sample, blocks = held.value
            first = np.cumsum(blocks) - blocks
            leaf_of = np.repeat(np.arange(len(blocks)), blocks)
            for whole in batches:
                for at in range(0, whole.num_rows, ROUTED_AT_ONCE):
                    batch = whole.slice(at, ROUTED_AT_ONCE)
                    ids, vectors = batch.column(0).to_numpy(), padded(batch.column(2), width)
                    wid, score, low, high = window_arrays(batch.column(3))
                    low = sample.floor(*sample.scores(ids, batch.column(1).to_pylist(), vectors, same), low, high, k)
                    x = tree.lifted(vectors, query=True)
                    reached = np.repeat(tree.reached(x, *annulus(tree, x, low, high)), blocks, axis=1)
                    query, spot = np.nonzero(reached)
                    if not len(query):
                        continue
                    n = low.shape[1]
                    values = pa.StructArray.from_arrays([pa.array(v.reshape(-1)) for v in (wid, score, low, high)], names=["id", "score", "low", "high"])
                    windows = pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(ids) + 1, n), pa.int32()), values)
                    leaf = leaf_of[spot]
                    columns = [pa.array(leaf, pa.int32()), pa.array(spot - first[leaf], pa.int32()), *(c.take(pa.array(query)) for c in (*batch.columns[:3], windows))]
                    yield pa.RecordBatch.from_arrays(columns, names=["leaf", "block", "id", "label", "q", "windows"])

        asked = queries.select("id", "label", "q", "windows").mapInArrow(route, sent).withColumn("kind", F.lit(1))
        given = self.rows.withColumns({"windows": F.lit(None).cast(asked.schema["windows"].dataType), "kind": F.lit(0)})
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        both = given.unionByName(asked).repartition(parts, "leaf", "block").sortWithinPartitions("leaf", "block", "kind", "id")
        both = both.select("leaf", "block", "kind", "id", "label", "q", "windows")
        names = ["query", "window", "window_score", "id", "score"]

        def rows_of(parts: list[pa.RecordBatch]) -> Rows:
            table = pa.Table.from_batches(parts).combine_chunks()
            return Rows(table.column("id").to_numpy(), table.column("label").to_pylist(), padded(table.column("q").combine_chunks(), width))

        def answer(rows: Rows, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            step = max(1, SCORES_AT_ONCE // len(rows.ids))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids = part.column(3).to_numpy()
                wid, wscore, low, high = window_arrays(part.column(6))
                scores, counts = rows.scores(ids, part.column(4).to_pylist(), padded(part.column(5), width), same)
                i, w, j = rows.best(scores, counts, low, high, k)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (ids[i], wid[i, w], wscore[i, w], rows.ids[j], scores[i, j])], names=names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, parts, rows = None, [], None
            for batch in batches:
                codes = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
                cuts = [0, *(np.flatnonzero((codes[1:] != codes[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if a == b:
                        continue
                    leaf, block, kind = codes[a].tolist()
                    if (leaf, block) != key:
                        key, parts, rows = (leaf, block), [], None
                    if kind == 0:
                        parts.append(batch.slice(a, b - a))
                    elif parts:
                        rows = rows or rows_of(parts)
                        yield from answer(rows, batch.slice(a, b - a))

        return both.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def integer_rows(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label string, q array<long>) of the rows that take part, one per vec_id."""
    grown = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    fits = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(2.0**62 / scale)))  # NaN is larger than all
    able = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fits, F.lit(False))
    rows = vectors.where(able).select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(F.col("label").cast("string").alias("label"), grown.alias("q")).alias("row"))
    return rows.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.label", "row.q")


def mine(vectors: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of (vec_id, label, embedding).

    anchors: condition on vec_id. Each anchor has its best rows of the same label as positives; each such pair
    has the best rows of other labels whose score is from low to high hundredths of the positive's.
    """
    rows = store(integer_rows(vectors, scale), "integer-vectors")
    index = Index(rows)
    asking = rows.where(anchors).select(F.col("vec_id").alias("id"), "label", "q")
    window = lambda *values: F.struct(*[v.cast("long").alias(n) for v, n in zip(values, ("id", "score", "low", "high"), strict=True)])
    any_score = F.array(window(F.lit(0), F.lit(0), F.lit(-_FAR - 1), F.lit(_FAR)))

    best = lambda found, keys, k: found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    near = best(index.search(asking.withColumn("windows", any_score), positives, True), ["query"], positives)
    near = store(near.select("query", F.col("id").alias("positive"), "score"), "positives")

    rest = F.pmod("score", F.lit(100))
    base = F.expr("(score - pmod(score, 100)) div 100")
    least = base * low + F.floor((rest * low + 99) / 100)
    most = base * high + F.floor(rest * high / 100)
    windows = near.select("query", window(F.col("positive"), F.col("score"), least, most).alias("w")).groupBy("query").agg(F.sort_array(F.collect_list("w")).alias("windows"))
    found = index.search(asking.join(windows, F.col("id") == F.col("query")), negatives, False)
    return best(found, ["query", "window"], negatives).select(
        F.col("query").alias("anchor_id"), F.col("window").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("window_score").alias("positive_score"), F.col("score").alias("negative_score")
    )


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), len(embedding) = 0)
), a AS (
  SELECT * FROM v WHERE vec_id % 100 = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, list_inner_product(a.q, v.q)::BIGINT AS score FROM a JOIN v ON a.vec_id <> v.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT * FROM (
  SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
) WHERE rank <= 10
"""

"""Embedding near-duplicates through a pivot-permutation index.

A vector is described by its NEAREST reference points in order of closeness. It stands in the inverted lists of
its first LEADS points; two vectors of one list whose descriptions share at least SHARED points are candidates,
and candidates are verified by cosine in double precision. Lists are worked through in blocks of about
BLOCK vectors against BLOCK: a task multiplies two blocks of descriptions (shared points) and of vectors
(cosines), counts links and passes on counts and a spanning forest, never the pairs. A pair that meets in
several lists counts in the first one only.

Reference points come from a sample and stand apart from each other, so a group of near copies can't fill
them. Their number grows with the square root of the table, so lists do too and work grows with the
power 1.5 at most; the sample has SAMPLE rows a point. Every vector is indexed. Equal vectors are one class with
a count. Labels and vector lengths are part of every key. Recall is that of the candidates; links are exact.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows without
label, link with nothing (n_links 0, their own component, kept). Rows without vec_id take no part and are
kept. Repeated rows are vectors of their own that link with each other; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import SALTS, connected_components, salted, store

COSINE = 0.98
#: Reference points: at least these, and this many per square root of the vectors; sampled rows a point; the closeness two may have.
LEAST_PIVOTS, PIVOTS, SAMPLE, APART = 128, 2, 16, 0.7
#: Points that describe a vector; those of them whose lists hold it; shared points of a candidate pair.
NEAREST, LEADS, SHARED = 8, 3, 3
BLOCK = 512


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of unit length in double precision, filled up with zeros to `width`."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    # The largest component goes first: squares of very large or small ones stay finite.
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def choose_pivots(vectors: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` rows, each less than APART close to those before; then the least close ones."""
    chosen = np.zeros(0, np.int64)
    closeness = np.full(len(vectors), -1.0)
    for limit in (APART, 0.9, COSINE):
        for i in range(len(vectors)):
            if len(chosen) == most:
                return vectors[chosen]
            if closeness[i] < limit:
                chosen = np.append(chosen, i)
                closeness = np.maximum(closeness, vectors @ vectors[i])
                closeness[i] = 2.0
    return vectors[chosen]


def index_lists(reps: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(rep, label, size, n, embedding, near, list): a row for each leading point of the vector; `near` is its description."""
    held = reps.sparkSession.sparkContext.broadcast(pivots)
    k = min(NEAREST, len(pivots))
    leads = min(LEADS, k)
    chunk = max((1 << 21) // len(pivots), 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                far = -(matrix(part.column(4), held.value.shape[1]) @ held.value.T)
                near = np.argpartition(far, k - 1, axis=1)[:, :k]
                near = np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, axis=1), axis=1, kind="stable"), axis=1).astype(np.int32)
                rows = np.repeat(np.arange(part.num_rows), leads)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, k), pa.int32()), pa.array(near.reshape(-1)))
                columns = [c.take(pa.array(rows)) for c in (*part.columns, lists)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(near[:, :leads].reshape(-1))], names=["rep", "label", "size", "n", "embedding", "near", "list"])

    kinds = dict(reps.dtypes)
    schema = f"rep long, label {kinds['label']}, size int, n long, embedding {kinds['embedding']}, near array<int>, list int"
    return reps.select("rep", "label", "size", "n", "embedding").mapInArrow(run, schema)


def first_list(near_a: np.ndarray, near_b: np.ndarray) -> np.ndarray:
    """The least leading point that both rows have: the list in which their pair counts."""
    a, b = near_a[:, :LEADS], near_b[:, :LEADS]
    both = (a[:, :, None] == b[:, None, :]).any(axis=2)
    return np.where(both, a, np.iinfo(np.int32).max).min(axis=1)


def shared_points(near_a: np.ndarray, near_b: np.ndarray) -> np.ndarray:
    """How many reference points each row of `near_a` shares with each of `near_b`."""
    points, at = np.unique(np.concatenate((near_a, near_b)), return_inverse=True)
    at = at.reshape(-1, near_a.shape[1])
    named = np.zeros((len(at), len(points)), np.float32)
    np.put_along_axis(named, at, 1, axis=1)
    return named[: len(near_a)] @ named[len(near_a) :].T


def block_links(reps: np.ndarray, n: np.ndarray, side: np.ndarray, unit: np.ndarray, near: np.ndarray, key: int, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rep, linked vectors, root of its links) for the members of one block pair that link with any other."""
    left, right = np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max())
    candidates = shared_points(near[left], near[right]) >= min(SHARED, near.shape[1])
    i, j = np.nonzero(candidates & (unit[left] @ unit[right].T >= cosine))
    i, j = left[i], right[j]
    if side.min() == side.max():
        i, j = i[i < j], j[i < j]
    mine = first_list(near[i], near[j]) == key
    i, j = i[mine], j[mine]
    counts = np.bincount(i, n[j], len(reps)) + np.bincount(j, n[i], len(reps))
    root = reps.copy()
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        if (low == root).all():
            break
        root = low
    some = counts > 0
    return reps[some], counts[some].astype(np.int64), root[some]


def linked(lists: DataFrame, width: int, cosine: float) -> DataFrame:
    """(a, links, b): links of `a` counted in one block pair, and the smallest vector they lead to there."""
    group = salted(lists, ["label", "size", "list"], [F.count("*").alias("members")], F.col("rep"), 2)
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    dealt = group.withColumn("side", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.withColumns({"low": F.least("side", "other"), "high": F.greatest("side", "other")})
    keys = ["label", "size", "list", "low", "high"]
    parts = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, *keys).sortWithinPartitions(*keys, "rep").select(*keys, "rep", "n", "side", "near", "embedding")

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """All groups of a sorted table."""
        codes = np.stack([table.column(c).to_numpy() for c in keys], axis=1) if table.schema.field("label").type != pa.string() else None
        if codes is None:
            label = table.column("label").combine_chunks().dictionary_encode()
            label = label.indices.to_numpy(zero_copy_only=False)
            codes = np.stack([label, *(table.column(c).to_numpy() for c in keys[1:])], axis=1)
        starts = np.concatenate(([0], np.flatnonzero((codes[1:] != codes[:-1]).any(axis=1)) + 1, [len(codes)]))
        reps, n, side, key = (table.column(c).to_numpy() for c in ("rep", "n", "side", "list"))
        unit = matrix(table.column("embedding").combine_chunks(), width)
        flat = table.column("near").combine_chunks().flatten().to_numpy()
        near = flat.reshape(len(reps), -1)
        found = [block_links(reps[a:b], n[a:b], side[a:b], unit[a:b], near[a:b], int(key[a]), cosine) for a, b in zip(starts, starts[1:], strict=False) if b - a > 1]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in range(3)], names=["a", "links", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None else table
            last = held.slice(held.num_rows - 1).select(keys).to_pylist()[0]
            # The last group may go on in the next batch: at most about 2 * BLOCK rows are held back.
            a = held.num_rows - 1
            while a and held.slice(a - 1, 1).select(keys).to_pylist()[0] == last:
                a -= 1
            if a:
                yield from solve(held.slice(0, a).combine_chunks())
            held = held.slice(a).combine_chunks()
        if held is not None:
            yield from solve(held)

    return dealt.mapInArrow(run, "a long, links long, b long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row per row of (vec_id, embedding, label)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    valid = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & some, F.lit(False)))
    valid = valid.withColumn("size", F.size("embedding"))
    reps = valid.groupBy("label", "size", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    reps = store(reps, "vectors")
    width, held = reps.agg(F.coalesce(F.max("size"), F.lit(1)), F.count("*")).first()
    most = max(LEAST_PIVOTS, math.ceil(PIVOTS * math.sqrt(held)))
    # SAMPLE * most vectors come to the driver, a number that grows with the square root of the table.
    sample = reps.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE * most).select("embedding").toArrow()
    keys = ["label", "size", "embedding"]
    if sample.num_rows:
        pivots = choose_pivots(matrix(sample.column("embedding").combine_chunks(), width), most)
        found = store(linked(index_lists(reps, pivots), width, cosine), "links")
        label = connected_components(found.select("a", "b"))
        counts = found.groupBy("a").agg(F.sum("links").alias("links"))
        classes = reps.join(counts, F.col("rep") == F.col("a"), "left").join(label, F.col("rep") == F.col("id"), "left")
        classes = classes.select(*keys, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    else:
        classes = reps.select(*keys, F.lit(0).cast("long").alias("links"), F.col("rep").alias("component"))
    salts = valid.groupBy(*keys).agg(F.collect_set(F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))).alias("salts"))
    classes = classes.join(salts, keys).withColumn("salt", F.explode("salts")).drop("salts")
    back = valid.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))).join(classes, [*keys, "salt"]).select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.where(~(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & some, F.lit(False))))
    result = back.union(alone.select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return result.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


#: What `op1_pivots` returns where every link is retrieved: all pairs within a label, least reachable vec_id.
ORACLE = """
WITH RECURSIVE valid AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE label IS NOT NULL AND len([x for x in embedding if x <> 0]) > 0
      AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM valid a JOIN valid b
        ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (
    SELECT vec_id AS id, vec_id AS other FROM embeddings
    UNION
    SELECT id, b FROM reach JOIN links ON other = a),
least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, ifnull(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON id = vec_id LEFT JOIN degree ON a = vec_id"""

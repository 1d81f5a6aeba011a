"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are counts over bytes, words and lines of whole texts, computed in numpy for a chunk of
documents at once. The trees are grown on a bounded sample of labelled rows (FIT_ROWS), on quantile bins,
and flattened into arrays of split features, split bins and leaf values; scoring walks all documents of a
batch down all trees by index arithmetic.

Defined results: null text is an empty text; every row gets a score; labels with null ids or values are
left out, of several labels for one id the smallest counts. Without labels of both kinds every score is
the smoothed share of label 1. Only `text` is an input of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm.common import chunks, store, utf8
from marketlens.llm.words import SOLID, split_words

#: Labelled documents that trees are fitted on at most: those of the least hashes.
FIT_ROWS = 12_000
TREES, DEPTH, BINS, RATE, RIDGE, LEAST_ROWS = 80, 4, 64, 0.15, 5.0, 20
#: Scores from here on count as good.
GOOD = 0.7
#: The part of all ids that is not learned from: this remainder of crc32(id) by HELD_OUT_PARTS.
HELD_OUT_PARTS, HELD_OUT = 4, 2

_KIND = np.zeros(256, np.int64)
for _kind, _bytes in enumerate(["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\v\f", "\n", ".!?", ",;:", "'\"()-"], 1):
    _KIND[[ord(c) for c in _bytes]] = _kind
_KIND[0x80:0xC0] = 9
_KIND[0xC0:] = 10
_KINDS = 11
FEATURES = 30


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES numbers per document."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    document = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.bincount(document * _KINDS + _KIND[data], minlength=n * _KINDS).reshape(n, _KINDS)
    shares = kinds / np.maximum(size, 1)[:, None]
    words = split_words(data, offsets, SOLID)
    count = np.diff(words.first)
    owner, length = words.document, (words.stop - words.start).astype(np.float64)
    per_word = np.maximum(count, 1)
    mean = np.bincount(owner, length, n) / per_word
    spread = np.sqrt(np.maximum(np.bincount(owner, length**2, n) / per_word - mean**2, 0))
    short, long = np.bincount(owner, length <= 3, n) / per_word, np.bincount(owner, length >= 20, n) / per_word
    begins = data[words.start] if len(words.start) else np.zeros(0, np.uint8)
    ends = data[words.stop - 1] if len(words.stop) else np.zeros(0, np.uint8)
    upper = np.bincount(owner, (begins >= 65) & (begins <= 90), n) / per_word
    stops = np.bincount(owner, np.isin(ends, [46, 33, 63]), n) / per_word
    odd = np.bincount(owner, _KIND[begins] == 0, n) / per_word
    same = np.zeros(len(owner))
    if len(owner) > 1:
        same[1:] = (words.hashes[1:] == words.hashes[:-1]) & (owner[1:] == owner[:-1])
    doubled = np.bincount(owner, same, n) / per_word
    lines = np.bincount(document, data == 10, n) + 1
    distinct, top, pairs, top_pair, repeated_lines, letters = (np.zeros(n) for _ in range(6))
    pair_hash, pair_ok = words.grams(2)
    breaks = np.flatnonzero(data == 10)
    for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
        if b - a:
            _, many = np.unique(words.hashes[a:b], return_counts=True)
            distinct[i], top[i] = len(many) / (b - a), many.max() / (b - a)
        if b - a > 1:
            _, many = np.unique(pair_hash[a : b - 1], return_counts=True)
            pairs[i], top_pair[i] = len(many) / (b - a - 1), many.max() / (b - a - 1)
        text = data[offsets[i] : offsets[i + 1]]
        if lines[i] > 1:
            cut = breaks[np.searchsorted(breaks, offsets[i]) : np.searchsorted(breaks, offsets[i + 1])] - offsets[i]
            parts = [text[x:y].tobytes() for x, y in zip(np.append(0, cut + 1), np.append(cut, len(text)), strict=True)]
            repeated_lines[i] = 1 - len(set(parts)) / len(parts)
        if len(text):
            p = np.bincount(text, minlength=256) / len(text)
            letters[i] = -(p[p > 0] * np.log2(p[p > 0])).sum()
    columns = [np.log1p(size), np.log1p(count), mean, spread, short, long, upper, stops, odd, doubled, np.log1p(lines), count / lines, distinct, top, pairs, top_pair, repeated_lines, letters, np.log1p(count) * distinct]
    return np.column_stack([*columns, shares])


@dataclass(frozen=True)
class Trees:
    """Flat trees: node k of a level has its children at 2k and 2k + 1 of the next; a split that is not made
    sends everything left."""

    edges: list[np.ndarray]
    feature: np.ndarray
    split: np.ndarray
    leaf: np.ndarray
    base: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], axis=1) if self.edges else np.zeros((len(x), 0), np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        total = np.full(len(x), self.base)
        if len(self.leaf):
            binned, rows = self.bins(x), np.arange(len(x))
            for feature, split, leaf in zip(self.feature, self.split, self.leaf, strict=True):
                node = np.ones(len(x), np.int64)
                for _ in range(DEPTH):
                    node = 2 * node + (binned[rows, feature[node]] > split[node])
                total += leaf[node - (1 << DEPTH)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Grow trees on gradient histograms, a level at a time."""
    good = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(good / (1 - good)))
    if len(y) == 0 or y.min() == y.max():
        return Trees([], np.zeros((0, 1 << DEPTH), int), np.zeros((0, 1 << DEPTH), int), np.zeros((0, 1 << DEPTH)), base)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    trees = Trees(edges, np.zeros((TREES, 1 << DEPTH), int), np.full((TREES, 1 << DEPTH), BINS), np.zeros((TREES, 1 << DEPTH)), base)
    binned = trees.bins(x)
    features = x.shape[1]
    flat = binned + np.arange(features) * BINS
    total = np.full(len(y), base)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-total))
        gradient, weight = y - p, p * (1 - p)
        node = np.ones(len(y), np.int64)
        for level in range(DEPTH):
            nodes, low = 1 << level, 1 << level
            place = ((node - low)[:, None] * features * BINS + flat).reshape(-1)
            shape = (nodes, features, BINS)
            g, h, c = (np.bincount(place, np.repeat(v, features), nodes * features * BINS).reshape(shape).cumsum(axis=2) for v in (gradient, weight, np.ones(len(y))))
            whole = lambda v: v[:, :, -1:]
            value = lambda a, b: a**2 / (b + RIDGE)
            gain = value(g, h) + value(whole(g) - g, whole(h) - h) - value(whole(g), whole(h))
            gain[(c < LEAST_ROWS) | (whole(c) - c < LEAST_ROWS)] = 0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            useful = gain.reshape(nodes, -1).max(axis=1) > 1e-9
            trees.feature[t, low : 2 * low] = np.where(useful, best // BINS, 0)
            trees.split[t, low : 2 * low] = np.where(useful, best % BINS, BINS)
            node = 2 * node + (binned[np.arange(len(y)), trees.feature[t][node]] > trees.split[t][node])
        leaf = node - (1 << DEPTH)
        sums, weights = np.bincount(leaf, gradient, 1 << DEPTH), np.bincount(leaf, weight, 1 << DEPTH)
        trees.leaf[t] = RATE * sums / (weights + RIDGE)
        total += trees.leaf[t][leaf]
    return trees


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % HELD_OUT_PARTS == HELD_OUT, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Trees:
    """Trees from labelled documents outside the held-out part."""
    known = labels.selectExpr("cast(doc_id as long) as doc_id", "cast(quality as int) as quality").where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = store(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS), "labels")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for a, b in chunks(offsets):
                x = statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), lists], names=["d", "q", "x"])

    # At most FIT_ROWS rows of 12 bytes: a bounded broadcast, and no shuffle of texts.
    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "text")
    found = rows.mapInArrow(run, "doc_id long, quality int, x array<double>")
    # Documents that repeat an id would exceed the bound: the first in order stands for them.
    found = store(found, "statistics").groupBy("doc_id").agg(F.min(F.struct("x", "quality")).alias("s"))
    table = found.select("doc_id", "s.quality", "s.x").toArrow().sort_by("doc_id")
    x = np.array(table.column("x").to_pylist(), np.float64).reshape(table.num_rows, FEATURES)
    return fit(x, (table.column("quality").to_numpy() > 0).astype(np.float64))


def score(docs: DataFrame, trees: Trees, column: str = "score") -> DataFrame:
    """Every row of docs with the probability that it is good; a narrow step."""
    if column in docs.columns:
        raise ValueError(f"docs has a column {column}")
    held = docs.sparkSession.sparkContext.broadcast(trees)
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(at))
            scores = [held.value.score(statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) for a, b in chunks(offsets)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=schema.names)

    return docs.mapInArrow(run, schema)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))

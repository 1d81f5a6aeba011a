"""Benchmark decontamination by winnowing.

An item's windows are its runs of WINDOW words; a shorter item is one window. For windows of L words the
fingerprints are the least hash of K-word grams in every run of L - K + 1 grams, K = min(GRAM, L), so any
shared window shares a fingerprint. Document fingerprints pass a bit table of fixed size first, then join
the items' fingerprints; each hit carries the words around it, is extended to every window over it and
compared with the items' windows as text. Hashes only select: equality of text decides.

Items with the same windows form item sets; a document keeps set ids, and the list of its items is made
once per distinct combination, so a passage in many items and many documents is not multiplied out.

Defined results: null or wordless texts have no words and no hits; wordless items have no windows; items
without id are not listed; repeated document rows each get their row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import chunks, local_minima, store, utf8
from marketlens.llm.words import ALNUM, Words, split_words

WINDOW, GRAM = 13, 8
#: Bits of the table of item fingerprints that every task gets (1 MB), whatever the number of items.
FILTER_BITS = 1 << 23


def fingerprints(words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(word positions, hashes) of the winnowed grams for windows of `length` words."""
    gram = min(GRAM, length)
    hashes, inside = words.grams(gram)
    where = np.flatnonzero(inside)
    found = local_minima(hashes[where], words.document[where], length - gram + 1)
    return where[found], hashes[where[found]]


def item_windows(items: DataFrame) -> DataFrame:
    """(item_id string, length, window, marks array<long>): the distinct windows of each item and its fingerprints."""
    schema = "item_id string, length int, windows array<string>, marks array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            ids, rows = batch.column(0).to_pylist(), []
            for i, item in enumerate(ids):
                words = split_words(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]), ALNUM)
                n = len(words.start)
                if n:
                    length = min(WINDOW, n)
                    _, marks = fingerprints(words, length)
                    rows.append((item, length, list(dict.fromkeys(words.text(a, a + length) for a in range(n - length + 1))), marks.astype(np.int64).tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64())))], names=["i", "l", "w", "m"])

    return items.selectExpr("cast(item_id as string) as item_id", "text").mapInArrow(run, schema)


def hits(docs: DataFrame, lengths: list[int], table: np.ndarray) -> DataFrame:
    """A row per document: doc_id, digest of its text, n_words, and the fingerprints that the bit table knows.

    A fingerprint comes with its words in context: every window of its length that covers it lies inside.
    """
    held = docs.sparkSession.sparkContext.broadcast(table)
    schema = "doc_id long, digest long, n_words long, marks array<struct<length: int, mark: long, first: long, context: string>>"
    kind = pa.list_(pa.struct([("length", pa.int32()), ("mark", pa.int64()), ("first", pa.int64()), ("context", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for a, b in chunks(offsets):
                words = split_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ALNUM)
                document, marks = words.document, [[] for _ in range(b - a)]
                for length in lengths:
                    where, found = fingerprints(words, length)
                    bit = found & np.uint64(FILTER_BITS - 1)
                    kept = (known[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
                    gram = min(GRAM, length)
                    for at, mark in zip(where[kept].tolist(), found[kept].astype(np.int64).tolist(), strict=True):
                        d = document[at]
                        low, high = max(words.first[d], at - (length - gram)), min(words.first[d + 1], at + length)
                        marks[d].append({"length": length, "mark": mark, "first": int(low - words.first[d]), "context": words.text(low, high)})
                sizes = pa.array(np.diff(words.first), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), sizes, pa.array(marks, kind)], names=["d", "h", "n", "m"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "xxhash64(text) as digest", "text").mapInArrow(run, schema)


def bit_table(marks: DataFrame) -> np.ndarray:
    """Bits of the fingerprints, put together by Spark; at most FILTER_BITS / 64 rows come to the driver."""
    bit = F.col("mark").bitwiseAND(F.lit(FILTER_BITS - 1))
    slots = marks.groupBy(F.shiftright(bit, 6).alias("slot")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(mark & 63 as int))")).alias("bits"))
    table = np.zeros(FILTER_BITS >> 6, np.uint64)
    for slot, bits in slots.toLocalIterator():
        table[slot] = np.uint64(bits & 0xFFFFFFFFFFFFFFFF)
    return table


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, digest), a row per row of docs.

    contaminated: hits are at least a twentieth of the words. digest is xxhash64 of the text.
    """
    given = store(item_windows(items), "items")
    marks = given.select("length", F.explode("marks").alias("mark")).distinct()
    lengths = sorted(r.length for r in given.select("length").distinct().collect())  # at most WINDOW values
    found = store(hits(docs, lengths, bit_table(marks)), "hits")

    windows = given.select("item_id", "length", F.explode("windows").alias("window")).groupBy("length", "window").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    windows = store(windows.select("length", "window", "items", F.xxhash64("items", F.size("items")).alias("set")), "windows")
    sets = windows.groupBy("set").agg(F.first("items").alias("items"))

    candidates = found.select("doc_id", "digest", F.explode("marks").alias("m")).select("doc_id", "digest", "m.*").join(marks, ["length", "mark"], "left_semi")
    words = F.split("context", " ")
    # A document of fewer words than a window holds none, though it may share a gram with it: no place, no row.
    places = F.when(F.size(words) >= F.col("length"), F.sequence(F.lit(0), F.size(words) - F.col("length")))
    every = F.transform(places, lambda j: F.struct((F.col("first") + j).alias("start"), F.array_join(F.slice(words, j + 1, F.col("length")), " ").alias("window")))
    extended = candidates.select("doc_id", "digest", "length", F.explode(every).alias("w")).select("doc_id", "digest", "length", "w.start", "w.window")
    matched = extended.join(windows.select("length", "window", "set"), ["length", "window"])
    span = F.struct(F.col("start"), (F.col("start") + F.col("length")).alias("stop"))
    per_doc = matched.groupBy("doc_id", "digest").agg(F.sort_array(F.collect_set(span)).alias("spans"), F.sort_array(F.collect_set("set")).alias("sets"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda s, x: F.struct((s.n + F.greatest(F.lit(0), x.stop - F.greatest(s.end, x.start))).alias("n"), F.greatest(s.end, x.stop).alias("end")),
        lambda s: s.n,
    )
    per_doc = store(per_doc.select("doc_id", "digest", "sets", covered.alias("n_hit")), "hit-docs")
    members = per_doc.select("sets").distinct().select("sets", F.explode("sets").alias("set")).join(sets, "set").select("sets", F.explode("items").alias("item"))
    lists = members.groupBy("sets").agg(F.sort_array(F.collect_set("item")).alias("items"))
    lists = lists.select("sets", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    judged = per_doc.join(lists, "sets", "left").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "n_hit", "n_items", "items_sha256")
    rows = found.select("doc_id", "digest", "n_words").join(judged, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return rows.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        "digest",
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), sized AS (
  SELECT item_id, w, least(13, len(w)) AS n FROM i WHERE len(w) > 0
), places AS (
  SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM sized
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS win FROM places
), spots AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d CROSS JOIN (SELECT DISTINCT n FROM windows) WHERE len(w) >= n
), found AS (
  SELECT spots.doc_id, spots.s, spots.n, windows.item_id FROM spots JOIN windows ON spots.n = windows.n AND array_to_string(spots.w[s : s + spots.n - 1], ' ') = windows.win
), per_doc AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS items FROM found GROUP BY doc_id
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM found)) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(p.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(p.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN per_doc p USING (doc_id) LEFT JOIN covered c USING (doc_id)
"""

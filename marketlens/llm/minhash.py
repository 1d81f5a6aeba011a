"""MinHash near-duplicates with b-bit signatures: bands find candidates, packed low bits rank them, full sets decide.

A document's set holds its distinct n-word shingles; with fewer words the whole sequence is one shingle.
Equal sets are one class from the start, so copies cost one row each. Bands of class representatives give
buckets; instead of all pairs of a bucket,
 1. every member is compared with the bucket's smallest document,
 2. members not yet in that document's component are compared with a member drawn per bucket, and
 3. those that are still apart are compared with every member of another component.
Pairs must pass the length bound, which is exact, and a b-bit estimate within MARGIN below the threshold;
links are then confirmed on full sets. Links inside a component that is already joined can't change it and
are not sought. In step 3 a pair is compared in the first band that it shares. With 25 bands of 5 rows, a pair at the threshold meets in some
band with probability 0.99999957 (0.85) or 0.99995 (0.8).

Defined results: documents without words have an empty set and link with nothing; rows without doc_id
take no part (component null, kept); rows that repeat a doc_id count as one document and are kept or
dropped together with it; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import SALTS, chunks, connected_components, mix, salted, store, utf8
from marketlens.llm.words import SOLID, Words, split_words

#: Shingle words and similarity unless a caller says otherwise.
SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS, PERMUTATIONS, BITS = 25, 5, 1024, 2
#: How far below the threshold a b-bit estimate may be: over four standard deviations of an estimate.
MARGIN = 0.07

_FACTORS = mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_TERMS = mix(np.arange(1001, 1001 + PERMUTATIONS, dtype=np.uint64))


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of all documents, sorted within each; bounds of each document)."""
    hashes, inside = words.grams(size)
    counts = np.diff(words.first)
    sets = []
    for i, (a, n) in enumerate(zip(words.first[:-1].tolist(), counts.tolist(), strict=True)):
        if n >= size:
            sets.append(np.unique(hashes[a : a + n - size + 1]))
        elif n:
            # A number of words in front keeps short sequences apart from shingles.
            code = np.uint64(n)
            for h in words.hashes[a : a + n].tolist():
                code = mix(np.array([int(code) ^ h], np.uint64))[0]
            sets.append(np.array([code], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
    bounds = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), bounds


def signatures(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Minima of every permutation, a row per document; rows of empty sets are zero."""
    out = np.zeros((len(bounds) - 1, PERMUTATIONS), np.uint64)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        for j in range(PERMUTATIONS):
            out[full, j] = np.minimum.reduceat(flat * _FACTORS[j] + _TERMS[j], bounds[full])
    return out


def band_values(minima: np.ndarray) -> np.ndarray:
    """One 64-bit value per band."""
    out = np.zeros((len(minima), BANDS), np.uint64)
    for r in range(ROWS):
        out = mix(out + minima[:, r : BANDS * ROWS : ROWS])
    return out


def packed_bits(minima: np.ndarray) -> np.ndarray:
    """The lowest BITS bits of every minimum's hash, 64 / BITS of them in a 64-bit word."""
    low = mix(minima) & np.uint64((1 << BITS) - 1)
    lanes = 64 // BITS
    shifts = (np.arange(PERMUTATIONS) % lanes * BITS).astype(np.uint64)
    return (low << shifts).reshape(len(minima), -1, lanes).sum(axis=2, dtype=np.uint64)


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, digest of the set, bands, packed) of every row."""
    schema = "doc_id long, n_shingles long, digest binary, bands array<long>, packed array<long>"

    def lists(values: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1]), pa.int32()), pa.array(values.reshape(-1).view(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in chunks(offsets):
                words = split_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], SOLID)
                flat, bounds = shingle_sets(words, size)
                minima = signatures(flat, bounds)
                digests = [hashlib.blake2b(flat[x:y], digest_size=16).digest() for x, y in zip(bounds, bounds[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(bounds)), pa.array(digests, pa.binary()), lists(band_values(minima)), lists(packed_bits(minima))], names=["d", "n", "s", "b", "p"]
                )

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, schema)


def full_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(rep, members): the sorted shingle hashes of the documents whose ids are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in chunks(offsets):
                flat, bounds = shingle_sets(split_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], SOLID), size)
                found = [flat[x:y].tobytes() for x, y in zip(bounds, bounds[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(found, pa.binary())], names=["rep", "members"])

    wanted = docs.selectExpr("cast(doc_id as long) as doc_id", "text").join(ids.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    return wanted.mapInArrow(run, "rep long, members binary").dropDuplicates(["rep"])


def estimate(a: str, b: str) -> Column:
    """Similarity from packed signatures: equal lanes, corrected for the 2**-BITS that agree by chance."""

    def differing(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        for step in (BITS >> 1, BITS >> 2):
            z = z.bitwiseOR(F.shiftrightunsigned(z, step))
        lowest = sum(1 << (i * BITS) for i in range(64 // BITS - 1))
        mask = lowest | (1 << (64 - BITS))
        return F.bit_count(z.bitwiseAND(F.lit(mask)))

    apart = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda total, n: total + n)
    chance = 2.0**-BITS
    return (1.0 - apart / float(PERMUTATIONS) - chance) / (1.0 - chance)


def plausible(threshold: float) -> Column:
    """The length bound, which is exact, and the b-bit estimate with its margin."""
    short, long = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    return (short >= F.floor(F.lit(threshold - 1e-9) * long)) & (estimate("packed_a", "packed_b") >= threshold - MARGIN)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * |A and B| >= percent * |A or B| on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_a = pairs.select("a", "b").distinct().join(sets.select(F.col("rep").alias("a"), F.col("members").alias("set_a")), "a")
    with_both = with_a.join(sets.select(F.col("rep").alias("b"), F.col("members").alias("set_b")), "b")
    return with_both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = round(100 * THRESHOLD)) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row per row of docs; links are at percent / 100 and more."""
    threshold = percent / 100
    sketches = store(sketch(docs, size), "sketches")
    known = sketches.where("doc_id is not null and n_shingles > 0")
    # Equal sets have equal sketches: the one of the smallest document stands for all.
    reps = known.groupBy("digest").agg(F.min_by(F.struct("n_shingles", "bands", "packed"), "doc_id").alias("s"), F.min("doc_id").alias("rep"))
    reps = store(reps.select("digest", "rep", F.col("s.n_shingles").alias("n"), "s.bands", "s.packed"), "sets")

    banded = reps.select("rep", F.posexplode("bands").alias("band", "value"))
    small = salted(banded, ["band", "value"], [F.min("rep").alias("leader")], F.col("rep"), 2)
    small = store(small, "buckets")
    facts = reps.select("rep", "n", "packed")

    def with_facts(pairs: DataFrame) -> DataFrame:
        for side in "ab":
            pairs = pairs.join(facts.select(F.col("rep").alias(side), F.col("n").alias(f"n_{side}"), F.col("packed").alias(f"packed_{side}")), side)
        return pairs.where(plausible(threshold)).select("a", "b")

    sets = store(full_sets(docs, small.select("rep").distinct(), size), "full-sets")
    first = small.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    links = store(confirmed(with_facts(first), sets, percent), "links")
    label = connected_components(links)

    def labelled(rows: DataFrame, of: str, name: str) -> DataFrame:
        return rows.join(label.select(F.col("id").alias(of), F.col("component").alias(name)), of, "left").withColumn(name, F.coalesce(name, of))

    def apart() -> DataFrame:
        """Members of buckets that hold more than one component, with their own component and the leader's."""
        rows = labelled(labelled(small, "rep", "own"), "leader", "main")
        mixed = rows.groupBy("band", "value").agg(F.max((F.col("own") != F.col("main")).cast("int")).alias("m")).where("m = 1").select("band", "value")
        return store(rows.join(mixed, ["band", "value"], "left_semi"), "apart")

    rows = apart()
    outside = rows.where("own <> main")
    drawn = rows.where("own = main").groupBy("band", "value").agg(F.min_by("rep", F.xxhash64("rep", "band", "value")).alias("other"))
    second = outside.select("band", "value", "rep").join(drawn, ["band", "value"]).select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct()
    links = store(links.union(confirmed(with_facts(second), sets, percent)), "links")
    label = connected_components(links)

    rows = apart().join(reps.select("rep", "n", "packed", "bands"), "rep")
    told = ("rep", "own", "main", "n", "packed", "bands")
    left = rows.where("own <> main").select("band", "value", *[F.col(c).alias(f"{c}_a") for c in told])
    right = rows.select("band", "value", *[F.col(c).alias(f"{c}_b") for c in told])
    first_shared = F.array_position(F.zip_with("bands_a", "bands_b", lambda x, y: x == y), True) - 1
    # Two rows that are both outside the main component meet twice: the smaller one asks.
    asks = (F.col("own_b") == F.col("main_b")) | (F.col("rep_a") < F.col("rep_b"))
    close = left.join(right, ["band", "value"]).where((F.col("own_a") != F.col("own_b")) & asks & plausible(threshold) & (first_shared == F.col("band")))
    third = close.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"))
    links = store(links.union(confirmed(third, sets, percent)), "links")
    label = connected_components(links)

    classes = labelled(reps.select("digest", "rep"), "rep", "component_id")
    salts = known.groupBy("digest").agg(F.collect_set(F.pmod("doc_id", F.lit(SALTS))).alias("salts"))
    classes = classes.join(salts, "digest").select("digest", "component_id", F.explode("salts").alias("salt"))
    # Rows without id or words have no sub-key and meet no class.
    salt = F.when((F.col("n_shingles") > 0), F.pmod("doc_id", F.lit(SALTS)))
    rows = sketches.select("doc_id", "n_shingles", "digest", salt.alias("salt")).join(classes, ["digest", "salt"], "left")
    component = F.coalesce("component_id", "doc_id")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


#: What `op7_minhash` returns: shingles of three words, every pair that shares one, links by 85 %, least reachable doc_id.
ORACLE = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(ifnull(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                        ELSE list_distinct([array_to_string(w[i : i + 2], ' ') for i in range(1, len(w) - 1)]) END AS grams
    FROM words),
grams AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM sets),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id
    GROUP BY ALL HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (
    SELECT doc_id AS id, doc_id AS other FROM documents
    UNION
    SELECT id, b FROM reach JOIN links ON other = a),
least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT doc_id, CAST(len(grams) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN least ON id = doc_id"""

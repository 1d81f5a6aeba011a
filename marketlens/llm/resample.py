"""Importance resampling towards a target corpus: array-scored weights, ranks by a distributed LSD radix sort.

Features are runs of one and two words in hashed buckets. One pass over the texts counts buckets (at most
BUCKETS rows a task), the log ratios of all buckets make one array of fixed size, a second pass looks every
feature of a document up in it. Scores add Gumbel noise from a hash of the id, so the highest scores are a
draw without replacement in proportion to the weights, repeatable on any cluster.

The sort keeps a position for every row. A pass over one digit counts rows by (digit, block of positions),
adds the counts up to global offsets, and sends each row to offset + its place among the block's rows of that
digit: stable, so passes from the last digit of the last key to the first digit of the first leave the rows in
order. Blocks hold about the square root of all rows, so a digit that all rows share splits into blocks, and
no task sorts more than a block or the blocks of one digit.

Defined results: null, empty and wordless texts have no features and weight 0; a null doc_id is hashed as an
empty text and sorts after all ids; rows with equal doc_id are rows of their own, ordered by n_features on a
tie; very long texts are chunks of their own; an empty table gives an empty result, an empty target gives
every bucket its plain prior. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import chunks, store, utf8
from marketlens.llm.words import ALNUM, Words, split_words

BUCKETS, SEED, PERCENT, MIN_WORDS = 10_000, 7, 25, 20
#: Bits of a radix digit, and the least rows of a block of positions.
DIGIT_BITS, LEAST_BLOCK = 11, 256
#: Longer words are hashed one by one.
_TABLE_LENGTH = 48


@lru_cache(maxsize=1)
def crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """(CRC-32 of a byte step, [length, byte place, byte]: what so many zero bytes make of a checksum)."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
    shift = np.zeros((_TABLE_LENGTH + 1, 4, 256), np.uint32)
    for place in range(4):
        shift[0, place] = np.arange(256, dtype=np.uint32) << np.uint32(8 * place)
    for length in range(1, _TABLE_LENGTH + 1):
        shift[length] = step[shift[length - 1] & 0xFF] ^ (shift[length - 1] >> 8)
    return step, shift


def crc_of_words(words: Words) -> np.ndarray:
    """Unsigned CRC-32 of every word."""
    step, _ = crc_tables()
    size = words.stop - words.start
    order = np.argsort(-np.minimum(size, _TABLE_LENGTH + 1), kind="stable")
    begin, long = words.start[order], int((size > _TABLE_LENGTH).sum())
    state = np.full(len(size), 0xFFFFFFFF, np.uint32)
    still = np.searchsorted(-size[order], -np.arange(_TABLE_LENGTH), "left") if len(size) else np.zeros(_TABLE_LENGTH, np.int64)
    for k in range(_TABLE_LENGTH):
        n = int(still[k])  # words of more than k bytes stand first
        if n <= long:
            break
        now = state[long:n]
        state[long:n] = step[(now ^ words.lower[begin[long:n] + k]) & 0xFF] ^ (now >> 8)
    out = np.empty(len(size), np.uint32)
    out[order] = ~state
    for i in order[:long].tolist():
        out[i] = zlib.crc32(words.lower[words.start[i] : words.stop[i]])
    return out


def feature_buckets(words: Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of every run of one and two words; the checksum of a pair follows from those of its words."""
    step, shift = crc_tables()
    one, document = crc_of_words(words), words.document
    pair = np.flatnonzero(document[1:] == document[:-1])
    size = (words.stop - words.start)[pair + 1]
    blank = ~one[pair]
    blank = ~(step[(blank ^ 0x20) & 0xFF] ^ (blank >> 8))  # checksum of "word "
    near = np.minimum(size, _TABLE_LENGTH)
    two = one[pair + 1].copy()
    for place in range(4):
        two ^= shift[near, place, (blank >> np.uint32(8 * place)) & 0xFF]
    for i in np.flatnonzero(size > _TABLE_LENGTH).tolist():
        k = pair[i] + 1
        two[i] = zlib.crc32(words.lower[words.start[k] : words.stop[k]], int(blank[i]))
    return np.concatenate([one % buckets, two % buckets]).astype(np.int64), np.concatenate([document, document[pair]])


def _word_chunks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, Words]]:
    data, offsets = utf8(batch.column(column))
    for a, b in chunks(offsets):
        yield a, b, split_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ALNUM)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all texts; tasks add up first, so at most `buckets` numbers come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, words in _word_chunks(batch, 0):
                total += np.bincount(feature_buckets(words, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    found = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in found.collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed share in the target over that in the source), per bucket."""
    k = len(source)
    of_source, of_target = float(source.sum() + k), float(target.sum() + k)
    return np.array([math.floor(1000 * math.log((t + 1) * of_source / ((s + 1) * of_target))) for s, t in zip(source.astype(float), target.astype(float), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): weight is the floored mean gain of a document's features."""
    held = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in _word_chunks(batch, 1):
                bucket, document = feature_buckets(words, len(held.value))
                n = np.bincount(document, minlength=b - a)
                # Sums of whole numbers below 2**53 are exact in doubles.
                total = np.bincount(document, held.value[bucket], minlength=b - a).astype(np.int64)
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                columns = [batch.column(0).slice(a, b - a), *(pa.array(x.astype(np.int64)) for x in (np.diff(words.first), n, weight))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """Whole thousandths of a Gumbel draw that belongs to (seed, doc_id)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def digits(width: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the digits of a key of `width` bits, the last digit first."""
    parts = max(1, -(-width // DIGIT_BITS))
    cuts = [width * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def radix_ranks(rows: DataFrame, keys: list[tuple[str, bool]], name: str = "rank") -> DataFrame:
    """rows with `name`: 1, 2, 3 ... in the order of the keys (column of whole numbers, ascending); nulls last.

    Rows equal in all keys stand in any order. Keys may span the whole range of 64-bit numbers.
    """
    carried = rows.columns
    # Halves of the keys never overflow when their least value is taken away.
    halves = []
    for column, ascending in keys:
        halves += [(F.shiftright(column, 32), ascending), (F.col(column).bitwiseAND(F.lit(0xFFFFFFFF)), ascending)]
    spread = rows.select(*carried, *[h.alias(f"_k{i}") for i, (h, _) in enumerate(halves)])
    spread = store(spread.withColumn("_place", F.monotonically_increasing_id()), "radix-keys")
    kinds = ((F.min, "low"), (F.max, "high"), (F.count, "some"))
    facts = spread.agg(F.count("*").alias("n"), *[f(f"_k{i}").alias(f"{at}{i}") for i in range(len(halves)) for f, at in kinds]).first()
    if not facts.n:
        return rows.withColumn(name, F.lit(None).cast("long"))
    plan, ready = [], []
    for i, (_, ascending) in enumerate(halves):
        low, high = (facts[f"{at}{i}"] or 0 for at in ("low", "high"))
        value = F.col(f"_k{i}") - low if ascending else F.lit(high) - F.col(f"_k{i}")
        ready.append(F.coalesce(value, F.lit(high - low + 1)).alias(f"_k{i}"))
        # Null is one value more; a key of a single value needs no pass.
        width = (high - low + (facts[f"some{i}"] < facts.n)).bit_length()
        plan.append([(i, first, bits) for first, bits in digits(width)])
    passes = [d for digit in reversed(plan) for d in digit]
    block = max(LEAST_BLOCK, math.isqrt(facts.n))
    spread = spread.select(*carried, "_place", *ready)

    # Partitions number their rows from multiples of 2**33; the first pass needs dense positions.
    part, within = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = spread.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))  # a row per partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    state = spread.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("_place", F.col("_start") + within).drop("_part", "_start")
    for i, first, bits in passes:
        digit = F.shiftright(f"_k{i}", first).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
        now = state.withColumns({"_digit": digit, "_block": F.floor(F.col("_place") / block).cast("long")})
        counts = store(now.groupBy("_digit", "_block").agg(F.count("*").alias("_n")), "radix-counts")
        earlier = Window.partitionBy("_digit").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        totals = counts.groupBy("_digit").agg(F.sum("_n").alias("_all"))  # at most 2 ** DIGIT_BITS rows
        smaller = Window.orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)
        starts = totals.select("_digit", F.coalesce(F.sum("_all").over(smaller), F.lit(0)).alias("_start"))
        offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).join(F.broadcast(starts), "_digit")
        offsets = offsets.select("_digit", "_block", (F.col("_start") + F.col("_before")).alias("_offset"))
        local = F.row_number().over(Window.partitionBy("_digit", "_block").orderBy("_place")) - 1
        state = now.withColumn("_local", local).join(offsets, ["_digit", "_block"])
        state = store(state.select(*carried, *[f"_k{j}" for j in range(len(halves))], (F.col("_offset") + F.col("_local")).alias("_place")), "radix-pass")
    return state.select(*carried, (F.col("_place") + 1).alias(name))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), a row per row of docs (doc_id, text); target has texts.

    rank numbers the drawn documents by falling score, ties to the smaller doc_id; it is null for the others.
    """
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    scored = store(weigh(docs, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "scores")
    able = F.col("n_words") >= min_words
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked = radix_ranks(scored.where(able).select(*columns), [("score", False), ("doc_id", True), ("n_features", True)])
    drawn = scored.where(able).count() * percent // 100
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.union(scored.where(~able).select(*columns, F.lit(None).cast("long")))


ORACLE = r"""
WITH step AS (
  SELECT list(list_reduce([b, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) ORDER BY b) AS t FROM (SELECT unnest(range(256))::BIGINT AS b)
), texts AS (
  SELECT 'd' AS side, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark
), worded AS (
  SELECT side, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), spread AS (
  SELECT side, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM worded
), counted AS (
  SELECT side, r, f, count(*) AS n FROM spread GROUP BY ALL
), hashed AS (
  SELECT f, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(strlen(f)), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM counted), step
), placed AS (
  SELECT side, r, bucket, sum(n) AS n FROM counted JOIN hashed USING (f) GROUP BY ALL
), sums AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 'b'), 0)::DOUBLE AS t FROM placed GROUP BY bucket
), whole AS (
  SELECT coalesce(sum(s), 0)::DOUBLE AS s, coalesce(sum(t), 0)::DOUBLE AS t FROM sums
), gain AS (
  SELECT bucket, floor(1000 * ln((sums.t + 1) * (whole.s + 10000) / ((sums.s + 1) * (whole.t + 10000)))) AS g FROM sums, whole
), weighed AS (
  SELECT r, sum(n)::BIGINT AS n_features, floor(sum(n * g) / sum(n))::BIGINT AS weight FROM placed JOIN gain USING (bucket) WHERE side = 'd' GROUP BY r
), scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM worded LEFT JOIN weighed USING (r) WHERE side = 'd'
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS p, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND p <= n * 25 // 100 THEN p END::BIGINT AS rank FROM ranked
"""

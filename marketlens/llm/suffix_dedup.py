"""Removal of repeated passages: suffixes of a prefix-free parse, compared in corpus order.

Parsing. A rolling hash over GRAM bytes triggers at its local minima, so every string of LENGTH bytes holds
a trigger, and the leftmost least one is at a place that the string's own bytes decide. A trigger's phrase
is the text of all strings whose trigger it is. The distinct phrases of a trigger value form the
dictionary, their occurrences in corpus order the parse. Corpus suffixes that agree on LENGTH bytes are
suffixes of dictionary phrases with the same trigger value.

Order. Phrase occurrences are sorted by (trigger, phrase, corpus place) by Spark and streamed. In a run of
equal phrases all but the first occurrence repeat every string of it. First occurrences are settled by
that unless their trigger value has other phrases too; then the dictionary's own suffixes are sorted,
first in blocks of BLOCK neighbouring suffixes (a block's common core takes the trigger's place) and last
one by one. Only LENGTH bytes of a suffix matter, so suffixes are ordered by 64-bit hashes of those bytes:
equal suffixes stand together in corpus order, which is all that is asked of the suffix array.

Repeats inside one Arrow batch are settled before the shuffle and travel as merged spans, so a passage
that many documents share sends about one row per batch. Rows follow the input; no document group or
dictionary is held by one task. Texts are told apart by a 64-bit number of their own, so many texts of one id
(or without id) are as many documents; only rows equal in id and text share a number.

Defined results: null text is empty; strings of LENGTH bytes never cross documents; rows without doc_id
count as the smallest id; rows that repeat a doc_id with other text are ordered by a hash of it; rows equal
in id and text are one document.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm.common import BYTE_CODES, chunks, local_minima, mix, new_folder, prefix_hash, slice_hash, sliding, store, utf8

LENGTH, GRAM, BLOCK = 100, 32, 10
_NO_ID = -(1 << 63)
_FLAGS = "d long, place long, size int, kind int"
_ENTRIES = "core int, phrase long, d long, place long, size int"


def pack(start: np.ndarray, back: np.ndarray, count: np.ndarray) -> np.ndarray:
    """One sortable number: first string start, trigger's distance from it, strings."""
    return start.astype(np.int64) << 14 | back.astype(np.int64) << 7 | (count.astype(np.int64) - 1)


def unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 14 & 0xFFFFFFFF, place >> 7 & 127, (place & 127) + 1


def entries(core: np.ndarray, phrase: np.ndarray, d: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Occurrences of a batch. Of equal phrases the first in corpus order is sent (size 0); what the others
    cover is repeated for certain and sent as spans (size: bytes)."""
    order = np.lexsort((place, d))
    core, phrase, d, place = core[order], phrase[order], d[order], place[order]
    # The key holds both hashes, so equal keys are equal phrases of one trigger.
    key = mix(core * np.uint64(0x9E3779B97F4A7C15) + phrase)
    order = np.argsort(key, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    origin = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    first = np.zeros(len(order), bool)
    first[order[new]] = True
    again = np.zeros(len(order), bool)
    # The same bytes found through two triggers are one occurrence.
    again[order] = ~new & ((d[order] != d[origin]) | (place[order] >> 14 != place[origin] >> 14))
    sd, spot, size = merged(d[again], place[again] >> 14, unpack(place[again])[2] - 1 + LENGTH)
    spread = mix(spot.astype(np.uint64) ^ sd.astype(np.uint64))
    columns = [
        np.concatenate([core[first], spread]).astype(np.uint32).view(np.int32),
        np.concatenate([phrase[first].view(np.int64), np.zeros(len(sd), np.int64)]),
        np.concatenate([d[first], sd]),
        np.concatenate([place[first], spot << 14]),
        np.concatenate([np.zeros(int(first.sum()), np.int64), size]).astype(np.int32),
    ]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["core", "phrase", "d", "place", "size"])


def merged(d: np.ndarray, spot: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching spans made one."""
    order = np.lexsort((spot, d))
    d, spot, stop = d[order], spot[order], (spot + size)[order]
    out = ([], [], [])
    if len(d):
        text = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
        # Reach within a text: later texts start above, as their rank is put in front.
        rank = np.repeat(np.arange(len(text)), np.diff(np.append(text, len(d)))) << 33
        start, reach = rank + spot, np.maximum.accumulate(rank + stop)
        head = np.flatnonzero(np.concatenate(([True], start[1:] > reach[:-1])))
        last = np.append(head[1:], len(d)) - 1
        out = (d[head], spot[head], (reach[last] - rank[last]) - spot[head])
    return tuple(np.asarray(x, np.int64) for x in out)


def own_strings(low: np.ndarray, window: np.ndarray, trigger: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of trigger, first, last): the strings, by their start, whose leftmost least gram is at the trigger.

    low: least gram hash of the string that starts at window[i]; window is sorted. Neighbouring strings share
    their trigger until its hash or the string passes it, so only those places are looked at.
    """
    n = len(window)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    change = np.ones(n, bool)
    change[1:] = (low[1:] != low[:-1]) | (window[1:] != window[:-1] + 1)
    past = np.searchsorted(window, trigger + 1)
    change[past[past < n]] = True
    begin = np.flatnonzero(change)
    end = np.append(begin[1:], n) - 1
    at = np.searchsorted(trigger, window[begin])
    wrong = np.flatnonzero(grams[at] != low[begin])
    while len(wrong):
        at[wrong] += 1
        wrong = wrong[grams[at[wrong]] != low[begin[wrong]]]
    # Looking twice may find the same trigger again: its strings stay together.
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    head = np.flatnonzero(new)
    return at[head], window[begin[head]], window[end[np.append(head[1:], len(at)) - 1]]


def parse(base: DataFrame) -> DataFrame:
    """Phrase occurrences of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            ids = batch.column(0).to_numpy()
            found: list[tuple[np.ndarray, ...]] = []
            for a, b in chunks(offsets):
                text, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                width = LENGTH - GRAM + 1
                n = len(text) - GRAM + 1
                if n < width:
                    continue
                document = np.repeat(np.arange(b - a), np.diff(at))
                prefix = prefix_hash(BYTE_CODES[text])
                where = np.flatnonzero(document[:n] == document[GRAM - 1 :])
                grams, of = slice_hash(prefix, where, where + GRAM), document[where]
                minima = local_minima(grams, of, width)
                if len(where) < width:
                    continue
                inside = np.flatnonzero(of[: len(of) - width + 1] == of[width - 1 :])
                which, first, last = own_strings(sliding(grams, width, np.minimum)[inside], where[inside], where[minima], grams[minima])
                trigger, core, doc = where[minima][which], grams[minima][which], of[minima][which]
                place = pack(first - at[doc], trigger - first, last - first + 1)
                found.append((core >> np.uint64(32), slice_hash(prefix, first, last + LENGTH), ids[a + doc], place))
            if found:
                yield entries(*map(np.concatenate, zip(*found, strict=True)))

    return base.select("d", "text").mapInArrow(run, _ENTRIES)


def sorted_runs(found: DataFrame) -> DataFrame:
    """Occurrences in order of (core, phrase, corpus place): kind 1 repeats an earlier one, kind 2 is the first of
    one of several phrases with its core; first occurrences of single phrases are settled and left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core_before = phrase_before = None
        origin = (0, 0)  # document and start of the first occurrence of phrase_before
        held: tuple[int, int] | None = None  # the only first occurrence so far of core_before
        for batch in batches:
            core, phrase, d, place, size = (c.to_numpy() for c in batch.columns)
            span = size > 0
            out = [(d[span], place[span], size[span], np.ones(int(span.sum()), np.int32))]
            core, phrase, d, place = core[~span], phrase[~span], d[~span], place[~span]
            n = len(core)
            if n:
                new_core, new = np.ones(n, bool), np.ones(n, bool)
                new_core[1:] = core[1:] != core[:-1]
                new[1:] = new_core[1:] | (phrase[1:] != phrase[:-1])
                new_core[0] = core_before is None or core[0] != core_before
                new[0] = new_core[0] or phrase[0] != phrase_before
                # The same bytes found through two triggers are one occurrence.
                first = np.maximum.accumulate(np.where(new, np.arange(n), -1))
                first_d = np.where(first < 0, origin[0], d[first])
                first_start = np.where(first < 0, origin[1], place[first] >> 14)
                kind = np.where(new | ((d == first_d) & (place >> 14 == first_start)), 0, 1).astype(np.int32)
                origin = (first_d[-1], first_start[-1])
                group = np.cumsum(new_core)  # group 0 goes on from the batch before
                firsts = np.flatnonzero(new)
                counts = np.bincount(group[firsts], minlength=int(group[-1]) + 1)
                if counts[0] and held:
                    out.append((np.array([held[0]]), np.array([held[1]]), np.zeros(1, np.int32), np.full(1, 2, np.int32)))
                    held = None
                multiple = counts >= 2
                multiple[0] = True  # an earlier phrase of this core has been seen
                kind[firsts[multiple[group[firsts]]]] = 2
                if group[-1] > 0:
                    only = firsts[group[firsts] == group[-1]]
                    held = (int(d[only[0]]), int(place[only[0]])) if len(only) == 1 else None
                core_before, phrase_before = core[-1], phrase[-1]
                kept = kind > 0
                out.append((d[kept], place[kept], np.where(kind[kept] == 1, unpack(place[kept])[2] - 1 + LENGTH, 0).astype(np.int32), kind[kept]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["d", "place", "size", "kind"])

    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return store(found.repartition(parts, "core").sortWithinPartitions("core", "phrase", "d", "place").mapInArrow(run, _FLAGS), "runs")


def joined(base: DataFrame, keys: DataFrame, flags: DataFrame, columns: list[str], how: str) -> DataFrame:
    """Documents with the places flagged in them, an array per text.

    Places are dealt to the texts' bucket columns, so documents stay where they are.
    """
    places = flags.groupBy("d").agg(F.collect_list("place").alias("places"), F.collect_list("size").alias("sizes"))
    return base.select("id", "xx", "d", *columns).join(places.join(keys, "d").drop("d"), ["id", "xx"], how).drop("id", "xx")


def flat_places(places: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(flagged places, one row after the other; their number in each row)."""
    return places.flatten().to_numpy(), places.value_lengths().to_numpy(zero_copy_only=False)


def blocks(base: DataFrame, keys: DataFrame, flags: DataFrame) -> DataFrame:
    """The strings of flagged phrases as entries of their own, BLOCK neighbours at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            ids = batch.column(0).to_numpy()
            flat, sizes = flat_places(batch.column(2))
            ends = np.concatenate(([0], np.cumsum(sizes)))
            found: list[tuple[np.ndarray, ...]] = []
            for a, b in chunks(offsets):
                text, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                prefix = prefix_hash(BYTE_CODES[text])
                start, back, count = unpack(flat[ends[a] : ends[b]])
                doc = np.repeat(np.arange(b - a), sizes[a:b])
                first, trigger = at[doc] + start, at[doc] + start + back
                # Blocks count backwards from the trigger: equal strings fall into the same block of equal triggers.
                low, high = (trigger - first - count + 1) // BLOCK, (trigger - first) // BLOCK
                each = np.repeat(np.arange(len(doc)), high - low + 1)
                step = np.arange(len(each)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1) + low[each]
                far = trigger[each] - step * BLOCK  # the block's last string start, before clipping
                begin = np.maximum(far - BLOCK + 1, first[each])
                end = np.minimum(far, first[each] + count[each] - 1)
                core = slice_hash(prefix, far, far - BLOCK + 1 + LENGTH)
                place = pack(begin - at[doc[each]], np.zeros(len(each), np.int64), end - begin + 1)
                found.append((core >> np.uint64(32), slice_hash(prefix, begin, end + LENGTH), ids[a + doc[each]], place))
            if found:
                yield entries(*map(np.concatenate, zip(*found, strict=True)))

    return joined(base, keys, flags, ["text"], "inner").select("d", "text", "places").mapInArrow(run, _ENTRIES)


def single_starts(base: DataFrame, keys: DataFrame, flags: DataFrame) -> DataFrame:
    """Each string of flagged blocks as an entry: its own bytes are core and phrase at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            ids = batch.column(0).to_numpy()
            flat, sizes = flat_places(batch.column(2))
            ends = np.concatenate(([0], np.cumsum(sizes)))
            found: list[tuple[np.ndarray, ...]] = []
            for a, b in chunks(offsets):
                text, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                prefix = prefix_hash(BYTE_CODES[text])
                start, _, count = unpack(flat[ends[a] : ends[b]])
                doc = np.repeat(np.arange(b - a), sizes[a:b])
                each = np.repeat(np.arange(len(doc)), count)
                begin = (at[doc] + start)[each] + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
                begin = np.unique(begin)
                doc = np.searchsorted(at, begin, "right") - 1
                zero = np.zeros(len(begin), np.int64)
                hashes = slice_hash(prefix, begin, begin + LENGTH)
                found.append((hashes >> np.uint64(32), hashes, ids[a + doc], pack(begin - at[doc], zero, zero + 1)))
            if found:
                yield entries(*map(np.concatenate, zip(*found, strict=True)))

    return joined(base, keys, flags, ["text"], "inner").select("d", "text", "places").mapInArrow(run, _ENTRIES)


def removed_spans(places: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of removed bytes."""
    _, start, size = merged(np.zeros(len(places), np.int64), unpack(places)[0], sizes.astype(np.int64))
    return list(zip(start.tolist(), (start + size).tolist(), strict=True))


def whole_characters(data: np.ndarray, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans made smaller so that no character is cut; a character stays unless all its bytes go."""
    out = []
    for a, b in spans:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b < len(data) and b > a and data[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """Rows of docs with doc_id, n_bytes, n_removed, n_spans and kept_sha256 of the remaining bytes.

    keep_text: instead, docs' own columns with `text` cut at whole characters (null stays null).
    """
    spark = docs.sparkSession
    names = docs.columns if keep_text else ["doc_id", "text"]
    # The caller's columns go under names of their own, so none can clash.
    inner = {n: "text" if n == "text" else f"column_{i}" for i, n in enumerate(names)}
    text_keys = [F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64("text").alias("xx")]
    # Each text of an id has a number of its own, in corpus order: a range sort of ids and hashes, no text is moved.
    # Numbers are unique and ordered, not dense: partition above, row below.
    keys = docs.select(*text_keys).distinct().orderBy("id", "xx").withColumn("d", F.monotonically_increasing_id())
    keys = store(keys, "text-numbers")
    # A bucketed table: the three joins with flagged places deal out only the places.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(*[F.col(n).alias(c) for n, c in inner.items()], *text_keys).repartition(parts, "id", "xx").join(keys, ["id", "xx"])
    table = f"suffix_dedup_{uuid.uuid4().hex}"
    base.write.bucketBy(parts, "id", "xx").sortBy("id", "xx").format("parquet").option("compression", "zstd").option("path", new_folder(spark, "bucketed")).saveAsTable(table)
    base = spark.table(table)

    runs = sorted_runs(parse(base))
    block_runs = sorted_runs(blocks(base, keys, runs.where("kind = 2")))
    string_runs = sorted_runs(single_starts(base, keys, block_runs.where("kind = 2")))
    flags = runs.union(block_runs).union(string_runs).where("kind = 1")

    if keep_text:
        schema = T.StructType(docs.schema.fields)
    else:
        schema = T._parse_datatype_string("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, places, sizes = batch.column("text"), batch.column("places"), batch.column("sizes")
            data, offsets = utf8(texts)
            valid = texts.is_valid().to_pylist()
            out, rows = [], []
            for i, (flagged, size) in enumerate(zip(places, sizes, strict=True)):
                text = data[offsets[i] : offsets[i + 1]]
                spans = []
                if flagged.is_valid:
                    spans = removed_spans(flagged.values.to_numpy(), size.values.to_numpy())
                if keep_text:
                    spans = whole_characters(text, spans)
                edges = [0, *(x for s in spans for x in s), len(text)]
                kept = b"".join(text[x:y].tobytes() for x, y in zip(edges[::2], edges[1::2], strict=True))
                if keep_text:
                    out.append(kept.decode("utf-8", "replace") if valid[i] else None)
                else:
                    rows.append((len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
            if keep_text:
                columns = [pa.array(out, pa.string()) if n == "text" else batch.column(c) for n, c in inner.items()]
                yield pa.RecordBatch.from_arrays(columns, names=names)
            else:
                sums = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
                yield pa.RecordBatch.from_arrays([batch.column(inner["doc_id"]).cast(pa.int64()), *sums, pa.array([r[3] for r in rows], pa.string())], names=schema.names)

    return joined(base, keys, flags, list(inner.values()), "left").drop("d").mapInArrow(run, schema)

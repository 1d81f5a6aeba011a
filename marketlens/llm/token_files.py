"""Token ids as Parquet list columns, in id order, with shard offsets: selective reads of tokens and metadata.

A file holds one row per document: doc_id, shard, local_start, n_tokens and the list of ids. Spark's own
Parquet writer is told to keep the dictionary (ids fit one), small pages for the page index and bounded
row groups, so a reader of one document or of the metadata columns skips the rest. One manifest row per
shard turns shard-local starts into global ones. The number of shards follows from the bytes of the texts.

Defined results: null text is empty and holds only the end id; rows with the same doc_id are ordered by
text; null doc_ids come first; a text of any length is one row; other columns are not written.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens.llm.common import chunks, new_folder, utf8
from marketlens.llm.pieces import BatchEncoder, byte_level_encoder

#: Bytes of a row group and of a page; the Parquet settings of the token files.
ROW_GROUP_BYTES, PAGE_BYTES, DICTIONARY_BYTES = 32 << 20, 64 << 10, 1 << 20

#: Text bytes of a shard: at least so many, and more for large tables, so that there are at most about sqrt(bytes) / SHARD_ROOT shards.
LEAST_SHARD_BYTES, SHARD_ROOT = 16 << 20, 32

#: Leading characters by which ranges split the rows of one doc_id; more would only swell the samples of the ranges.
RANGE_CHARACTERS = 64


@dataclass(frozen=True)
class TokenFiles:
    """Folders of a written token table."""

    data: str

    def metadata(self, spark: SparkSession) -> DataFrame:
        """Document rows without their ids: the list column is not read."""
        return spark.read.parquet(self.data).drop("ids")

    def manifest(self, spark: SparkSession) -> DataFrame:
        """(shard, base, shard_tokens): tokens before each shard. One row per shard."""
        per_shard = self.metadata(spark).groupBy("shard").agg(F.sum("n_tokens").alias("shard_tokens"))
        before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        return per_shard.select("shard", "shard_tokens", F.coalesce(F.sum("shard_tokens").over(before), F.lit(0)).alias("base"))

    def read(self, spark: SparkSession, where=None) -> DataFrame:
        """(doc_id, start, n_tokens, ids); a condition on doc_id reaches the page index."""
        rows = spark.read.parquet(self.data)
        rows = rows if where is None else rows.where(where)
        return rows.join(F.broadcast(self.manifest(spark)), "shard").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


@lru_cache(maxsize=2)
def encoder(path: str) -> BatchEncoder:
    return byte_level_encoder(path)


def write(docs: DataFrame, path: str, end_id: int, folder: str | None = None) -> TokenFiles:
    """Encode `text`, end each document with end_id, write in ascending doc_id order."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(size / max(LEAST_SHARD_BYTES, SHARD_ROOT * math.isqrt(size))))
    ordered = docs.selectExpr("cast(doc_id as long) as doc_id", "text").repartitionByRange(parts, F.col("doc_id"), F.substring("text", 1, RANGE_CHARACTERS)).sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, done = encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            _, offsets = utf8(batch.column(1))
            for start, stop in chunks(offsets):
                ids, sizes = encode([t or "" for t in batch.column(1).slice(start, stop - start).to_pylist()])
                ids, sizes = np.insert(ids, np.cumsum(sizes), end_id), sizes + 1
                ends = np.cumsum(sizes)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids, pa.int32()))
                columns = [batch.column(0).slice(start, stop - start), pa.array(np.full(len(sizes), shard), pa.int32()), pa.array(done + ends - sizes), pa.array(sizes), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "shard", "local_start", "n_tokens", "ids"])
                done += int(ends[-1])

    rows = ordered.mapInArrow(run, "doc_id long, shard int, local_start long, n_tokens long, ids array<int>")
    options = {"parquet.block.size": ROW_GROUP_BYTES, "parquet.page.size": PAGE_BYTES, "parquet.dictionary.page.size": DICTIONARY_BYTES, "parquet.enable.dictionary": "true", "parquet.writer.version": "PARQUET_2_0"}
    rows.write.options(**{k: str(v) for k, v in options.items()}).parquet(folder)
    return TokenFiles(folder)


def checksums(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of rows read from token files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
            found = [zlib.crc32(flat[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(found, pa.int64())], names=["d", "s", "n", "c"])

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")

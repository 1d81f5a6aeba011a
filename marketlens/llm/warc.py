"""WARC archives: a deterministic sharded writer with committed manifests, and a streaming reader.

Write: pages are range-sorted by (page_id, payload hash) and their bytes added up, which cuts shards of about
equal size wherever the ids lie; task i sorts the records of shard i, writes gzip members and rolls to the next
file by compressed size. Headers, digests and record ids follow from the rows alone, so equal tables give
equal files. A file is written under a temporary name of the task attempt; the manifest names those of
successful attempts only, and the commit moves each to its final name and can be repeated.

Defined results: null html is an empty payload; null URLs leave the target header out; rows without
page_id come first and are responses unless a row with an id has the same payload; repeated rows with
the smallest page_id of a payload are all responses. Rows that agree in page_id and payload share a shard. A
payload of any length is one record; a task holds one record at a time besides its batch of rows. Other columns
are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm.common import new_folder, salted, store

#: Compressed bytes after which a file is closed; html bytes of a shard; bytes counted for the headers of a record.
FILE_BYTES, SHARD_BYTES, HEAD_BYTES = 16 << 20, 64 << 20, 400
#: Equal payloads of fewer bytes are stored again rather than referred to.
LEAST_REVISIT_BYTES = 0
#: The capture date of records whose table has none.
DATE = "2020-01-01T00:00:00Z"


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def record(page_id: int | None, url: str | None, html: str | None, first: int | None, response: bool) -> bytes:
    """One record. A revisit has the response's HTTP headers but no payload."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if response else http
    lines = ["WARC/1.1", f"WARC-Type: {'response' if response else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, url, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    if not response:
        lines += [f"WARC-Refers-To-Page-ID: {first}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without a time stamp."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def records(stream: BinaryIO) -> Iterator[bytes]:
    """The records of an archive of gzip members, one after the other, in bounded memory."""
    z, got = zlib.decompressobj(31), []
    while data := stream.read(1 << 20):
        while data:
            got.append(z.decompress(data))
            data = z.unused_data
            if z.eof:
                yield b"".join(got)
                z, got = zlib.decompressobj(31), []
    if any(got):
        raise ValueError("the archive ends inside a record")


def parse(data: bytes) -> dict:
    """Fields of a record, with its digests checked against its bytes."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
    response = fields["WARC-Type"] == "response"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if rest[len(block) :] != b"\r\n\r\n" or base32_sha1(block) != fields["WARC-Block-Digest"].removeprefix("sha1:"):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    if response and (len(payload) != stated or base32_sha1(payload) != digest):
        raise ValueError(f"damaged payload {fields['WARC-Record-ID']}")
    number = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": number("Page-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": stated, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To-Page-ID"), "payload": payload if response else None}


def copies(pages: DataFrame) -> DataFrame:
    """(page_id, mark, digest, first): the smallest page_id with the same payload, for payloads met twice.

    Copies are counted per payload before the shuffle; payloads are looked up under as many sub-keys as
    their rows use, so that the copies of one payload go to many tasks. No html is moved here.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.where(F.octet_length(payload) >= LEAST_REVISIT_BYTES).select(F.col("page_id").cast("long").alias("page_id"), F.xxhash64(payload).alias("mark"), F.sha1(payload.cast("binary")).alias("digest"))
    found = salted(rows, ["digest"], [F.min("page_id").alias("first")], F.coalesce("page_id", "mark"), 2)
    return found.where("first is not null").select("page_id", "mark", "digest", "first").distinct()


def shard_starts(pages: DataFrame, shard_bytes: int) -> list[tuple[bool, int, int]]:
    """The first (has an id, page_id, payload hash) of every shard of about `shard_bytes`, in order.

    No html moves: sorted keys with running byte counts are stored, and a number per partition and then a
    key per shard come to the driver.
    """
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    payload = F.coalesce("html", F.lit(""))
    order = ["known", "page_id", "mark"]
    keys = pages.select(F.col("page_id").isNotNull().alias("known"), F.coalesce(F.col("page_id").cast("long"), F.lit(0)).alias("page_id"), F.xxhash64(payload).alias("mark"), (F.octet_length(payload) + F.lit(HEAD_BYTES)).cast("long").alias("size"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            ends = done + np.cumsum(batch.column(3).to_numpy())
            before = ends - batch.column(3).to_numpy()
            done = int(ends[-1]) if len(ends) else done
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.full(len(ends), part, np.int32)), pa.array(before), pa.array(ends)], names=[*order, "part", "before", "end"])

    sorted_ = keys.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    counted = store(sorted_.mapInArrow(run, "known boolean, page_id long, mark long, part int, before long, end long"), "warc-bytes")
    held = {r.part: r.size for r in counted.groupBy("part").agg(F.max("end").alias("size")).collect()}
    bases, total = [0] * (max(held, default=0) + 1), 0
    for i in range(len(bases)):
        bases[i], total = total, total + held.get(i, 0)
    place = F.element_at(F.lit(bases), F.col("part") + 1) + F.col("before")
    firsts = counted.groupBy(F.floor(place / F.lit(shard_bytes)).alias("shard")).agg(F.min(F.struct(*order)).alias("first")).collect()
    return sorted({(r.first.known, r.first.page_id, r.first.mark) for r in firsts})


def shard_of(starts: list[tuple[bool, int, int]]) -> Column:
    """The shard of a row of (page_id, mark): the last one that starts at or before it."""

    @F.pandas_udf("int")
    def find(known: pd.Series, page_id: pd.Series, mark: pd.Series) -> pd.Series:
        return pd.Series([max(bisect_right(starts, key) - 1, 0) for key in zip(known.tolist(), page_id.tolist(), mark.tolist(), strict=True)], dtype="int32")

    return find(F.col("page_id").isNotNull(), F.coalesce("page_id", F.lit(0)), "mark")


def write(pages: DataFrame, folder: str | None = None, file_bytes: int = FILE_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the archives of (page_id, url, html) and return their manifest: file, shard, records, bytes, sha256."""
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    starts = shard_starts(pages, shard_bytes)
    parts = max(len(starts), 1)
    # Facts about copies travel beside the records: sorted together, a page's facts come right before it.
    records_ = pages.selectExpr("cast(page_id as long) as page_id", "xxhash64(coalesce(html, '')) as mark", "url", "html", "cast(null as string) as digest", "cast(null as long) as first", "1 as kind")
    facts = copies(pages).selectExpr("page_id", "mark", "cast(null as string) as url", "cast(null as string) as html", "digest", "first", "0 as kind")
    dealt = records_.union(facts).withColumn("shard", shard_of(starts)).repartitionById(parts, F.col("shard")).sortWithinPartitions("shard", "page_id", "kind", "url", "html")
    schema = "shard int, part int, temporary string, records long, bytes long, sha256 string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store_at, root = file_system(folder)
        attempt, out, made = uuid.uuid4().hex, None, []
        store_at.create_dir(f"{root}/_temporary/{attempt}")

        def close() -> None:
            nonlocal out
            if out:
                out.pop("stream").close()
                made.append(out | {"sha256": out["sha256"].hexdigest()})
                out = None

        part, of_page, firsts = 0, None, {}
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.page_id != of_page:
                    of_page, firsts = row.page_id, {}
                if row.kind == 0:
                    firsts[row.digest] = int(row.first)
                    continue
                if out and (row.shard != out["shard"] or out["bytes"] >= file_bytes):
                    part = part + 1 if row.shard == out["shard"] else 0
                    close()
                if not out:
                    name = f"_temporary/{attempt}/{row.shard}-{part}"
                    out = {"shard": row.shard, "part": part, "temporary": name, "records": 0, "bytes": 0, "sha256": hashlib.sha256(), "stream": store_at.open_output_stream(f"{root}/{name}")}
                page_id = None if row.page_id is None else int(row.page_id)
                first = firsts.get(hashlib.sha1((row.html or "").encode("utf-8", "surrogatepass")).hexdigest())
                data = member(record(page_id, row.url, row.html, first, first is None or first == page_id))
                out["stream"].write(data)
                out["sha256"].update(data)
                out["records"] += 1
                out["bytes"] += len(data)
        close()
        yield pd.DataFrame(made, columns=["shard", "part", "temporary", "records", "bytes", "sha256"])

    # Ids travel as text: pandas would make floats of a nullable long column.
    sent = dealt.selectExpr("shard", "cast(page_id as string) page_id", "kind", "url", "html", "digest", "cast(first as string) first")
    found = store(sent.mapInPandas(run, schema), "warc-manifest")

    def commit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store_at, root = file_system(folder)
        for batch in batches:
            batch["file"] = [f"warc-{s:06d}-{p:05d}.warc.gz" for s, p in zip(batch["shard"], batch["part"], strict=True)]
            for row in batch.itertuples(index=False):
                there = store_at.get_file_info(f"{root}/{row.temporary}").type != fs.FileType.NotFound
                if there:
                    store_at.move(f"{root}/{row.temporary}", f"{root}/{row.file}")
                elif store_at.get_file_info(f"{root}/{row.file}").size != row.bytes:
                    raise OSError(f"{row.file} is neither there nor to be committed")
            yield batch.assign(folder=folder)[["folder", "file", "shard", "records", "bytes", "sha256"]]

    spread = found.repartition(parts, "shard", "part")
    done = store(spread.mapInPandas(commit, "folder string, file string, shard int, records long, bytes long, sha256 string"), "warc-files")
    # What is left are files of failed attempts.
    store_at, root = file_system(folder)
    if store_at.get_file_info(f"{root}/_temporary").type != fs.FileType.NotFound:
        store_at.delete_dir(f"{root}/_temporary")
    return done


def read(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of the archives a manifest lists: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload."""
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if payloads else [])]
    types = dict(page_id="long", url="string", payload_bytes="long", payload_digest="string", record_type="string", refers_to="long", payload="binary")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                store_at, root = file_system(row.folder)
                with store_at.open_input_stream(f"{root}/{row.file}", compression=None) as stream:
                    rows = []
                    for data in records(stream):
                        rows.append(parse(data))
                        if len(rows) == 256:
                            yield frame(rows)
                            rows = []
                    if rows:
                        yield frame(rows)

    def frame(rows: list[dict]) -> pd.DataFrame:
        found = pd.DataFrame(rows, columns=columns)
        return found.astype({"page_id": "Int64", "refers_to": "Int64"})

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("folder", "file").repartition(parts, "file").mapInPandas(run, ", ".join(f"{c} {types[c]}" for c in columns))


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return read(write(pages), payloads=False).drop("url")


#: What `op3_warc` returns for pages with an id each; base32 letters come from groups of five of the digest's bits.
ORACLE = """
WITH hashed AS (SELECT page_id, strlen(ifnull(html, '')) AS size, sha1(ifnull(html, '')) AS hex FROM pages),
named AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM hashed)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes,
       list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                              1 + CAST((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT), 1)
                       for i in range(32)], 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM named"""

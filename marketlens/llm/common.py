"""Shared pieces of the training-data operators: stored tables, text batches, hashes, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handled at once inside a task; one longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Sub-keys of a group when its aggregates go back to its rows.
SALTS = 32


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; without that setting, one under the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return folder.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def store(df: DataFrame, what: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here and lost executors cost nothing."""
    path = new_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and at[-1] > 0 else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about `size` bytes together."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1
        stop = min(max(stop, start + 1), n)
        yield start, stop
        start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS = {"n": -1}
#: One odd 64-bit value per byte, so that a polynomial over them does not see the byte order of the alphabet.
BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i below n."""
    if _POWERS["n"] < n:
        m = max(n, CHUNK_BYTES + 1)
        up, down = np.full(m, _BASE), np.full(m, _INVERSE)
        up[0] = down[0] = 1
        _POWERS.update(n=m, up=np.cumprod(up), down=np.cumprod(down))
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """Prefix sums of code[i] * B**i; slices of it give the hash of any substring."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(len(codes))[0], out=out[1:])
    return out


def slice_hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return mix((prefix[stop] - prefix[start]) * powers(len(prefix))[1][start])


def sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick (minimum or maximum) over every window of `width` values."""
    out, span = values, 1
    while span < width:
        step = min(span, width - span)
        out = pick(out[:-step], out[step:])
        span += step
    return out


def local_minima(hashes: np.ndarray, group: np.ndarray, window: int) -> np.ndarray:
    """Positions that hold the least hash of some window of `window` neighbours of one group.

    Every such window has at least one of them. A group (a document) with fewer positions than the
    window gives its own least ones. Equal least hashes are all kept, so the choice depends on content alone.
    """
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.int64)
    starts = np.concatenate(([0], np.flatnonzero(group[1:] != group[:-1]) + 1))
    sizes = np.diff(np.append(starts, n))
    chosen = np.zeros(n, bool)
    if n >= window:
        low = sliding(hashes, window, np.minimum)
        # A window counts only if it ends in the group in which it begins.
        inside = group[: n - window + 1] == group[window - 1 :]
        wide = np.zeros(n + window - 1, np.uint64)
        wide[window - 1 : n] = np.where(inside, low, np.uint64(0))
        some = np.zeros(n + window - 1, bool)
        some[window - 1 : n] = inside
        chosen = (sliding(wide, window, np.maximum) == hashes) & ((hashes > 0) | sliding(some, window, np.logical_or))
    for i in np.flatnonzero(sizes < window):
        part = slice(starts[i], starts[i] + sizes[i])
        chosen[part] = hashes[part] == hashes[part].min()
    return np.flatnonzero(chosen)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i] + lengths[i] - 1, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def salted(rows: DataFrame, keys: list[str], values: list[Column], salt: Column, least: int) -> DataFrame:
    """Rows with aggregates of their group, for groups of `least` rows and more.

    Aggregates are combined before the shuffle and come back under the sub-keys that the group's rows use.
    """
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
    groups = rows.groupBy(*keys).agg(*values, F.count("*").alias("_n"), F.collect_set("_salt").alias("_salts")).where(F.col("_n") >= least)
    return rows.join(groups.withColumn("_salt", F.explode("_salts")).drop("_salts", "_n"), [*keys, "_salt"]).drop("_salt")


def connected_components(edges: DataFrame, what: str = "components") -> DataFrame:
    """(id, component): the smallest id reachable over undirected edges (a, b).

    Each round takes the least label among neighbours and then the label of that label; both are grouped
    minima that Spark combines before the shuffle. Rounds are stored in the shared folder, and only the
    number of changed labels comes to the driver.
    """
    pairs = edges.select("a", "b").where("a <> b")
    both = store(pairs.union(pairs.select("b", "a")).distinct(), what)
    label = store(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")), what)
    while True:
        near = both.join(label, both.b == label.id).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = label.join(near, "id").select("id", F.col("component").alias("before"), F.least("component", "near").alias("to"))
        up = label.select(F.col("id").alias("to"), F.col("component").alias("over"))
        # A label is an id of some edge, so the jump finds its row.
        after = store(step.join(up, "to", "left").select("id", "before", F.least("to", F.coalesce("over", "to")).alias("component")), what)
        changed = after.where("component <> before").limit(1).count()
        label = after.select("id", "component")
        if not changed:
            return label

"""Exact quantiles of several columns by narrowing histograms, and approximate ones in one pass."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quantile_name(column: str, p: float) -> str:
    return f"{column}_q{int(round(p * 10000)):05d}"


#: Buckets of a histogram, and the rows of a bucket that are counted value by value instead of being split again.
BUCKETS, KEEP = 256, 1_000_000


@dataclass
class _Bracket:
    """Where the wanted ranks of one column and quantile lie: ``below`` values are less than ``low``."""

    column: str
    p: float
    low: float | None = None
    high: float | None = None
    below: int = 0
    inside: int = 0
    total: int = 0

    def value(self) -> Column:
        """The column's value where it is a number inside the bracket, else NULL."""
        v = F.col(self.column).cast("double")
        held = ~F.isnan(v)
        if self.low is not None:
            held = held & v.between(F.lit(self.low), F.lit(self.high))
        return F.when(held, v)

    @property
    def ranks(self) -> tuple[int, int]:
        position = self.p * (self.total - 1)
        return math.floor(position), math.ceil(position)

    def narrow(self, edges: list[float]) -> bool:
        """Keep the bucket that holds the ranks; false where it is no smaller. Edges are off by a fraction of a bucket at most."""
        first, last = ((rank - self.below) / max(1, self.inside - 1) * BUCKETS for rank in self.ranks)
        low, high = edges[max(0, math.floor(first - 0.25))], edges[min(BUCKETS, math.ceil(last + 0.25))]
        smaller = (low, high) != (self.low, self.high)
        self.low, self.high = low, high
        return smaller


def _histograms(df: DataFrame, brackets: list[_Bracket]) -> list[list[float] | None]:
    """One scan: rows below and inside each bracket, and edges that deal the rows inside into BUCKETS equal parts."""
    levels = [i / BUCKETS for i in range(BUCKETS + 1)]
    wanted = []
    for i, b in enumerate(brackets):
        v = F.col(b.column).cast("double")
        less = (v < F.lit(b.low)) if b.low is not None else F.lit(False)
        wanted += [
            F.count(F.when(less, 1)).alias(f"below_{i}"),
            F.count(b.value()).alias(f"inside_{i}"),
            F.count(v).alias(f"total_{i}"),
            F.percentile_approx(b.value(), levels, 16 * BUCKETS).alias(f"edges_{i}"),
        ]
    row = df.agg(*wanted).first()
    for i, b in enumerate(brackets):
        b.below, b.inside, b.total = row[f"below_{i}"], row[f"inside_{i}"], row[f"total_{i}"]
    return [row[f"edges_{i}"] for i in range(len(brackets))]


def _ranked_values(df: DataFrame, brackets: list[_Bracket]) -> dict[tuple[int, int], float]:
    """(bracket, rank) -> value, from counts of the distinct values inside the brackets: at most KEEP rows for each."""
    held = [F.struct(F.lit(i).alias("bracket"), b.value().alias("value")) for i, b in enumerate(brackets)]
    rows = df.select(F.explode(F.filter(F.array(*held), lambda h: h.value.isNotNull())).alias("h")).select("h.*")
    order = Window.partitionBy("bracket").orderBy("value")
    counts = rows.groupBy("bracket", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(order))
    wanted = F.lit(False)
    for i, b in enumerate(brackets):
        for rank in b.ranks:
            at = rank - b.below
            wanted = wanted | ((F.col("bracket") == i) & (F.col("upto") - F.col("n") <= at) & (F.lit(at) < F.col("upto")))
    found = {}
    for row in counts.where(wanted).collect():  # two rows of a bracket at most
        b = brackets[row["bracket"]]
        found |= {(row["bracket"], r): row["value"] for r in b.ranks if row["upto"] - row["n"] <= r - b.below < row["upto"]}
    return found


def exact_quantiles(df: DataFrame, requests: dict[str, list[float]]) -> DataFrame:
    """One row with linearly interpolated quantiles, columns named by ``quantile_name``.

    NULLs are left out; a column without values gives NULL; NaN is larger than all numbers. Histograms narrow
    to the bucket that holds the rank: each scan counts the rows below and inside every bracket and deals the
    inside into 256 parts, so brackets shrink a hundredfold a scan, whatever the values' spread. Once one
    holds KEEP rows or a single value its values are counted and ranked. Nothing is written; ``df`` is read
    two times, three from some 10**8 rows on, so it should be a stored or cheap table. Values are doubles.
    """
    brackets = [_Bracket(column, p) for column, ps in requests.items() for p in ps]
    open_ones = brackets
    while open_ones:
        edges = _histograms(df, open_ones)
        large = [(b, e) for b, e in zip(open_ones, edges, strict=True) if b.inside > KEEP and (b.low is None or b.low != b.high)]
        # Ranks beyond all numbers are NaN and need no bracket.
        open_ones = [b for b, e in large if b.ranks[0] < b.below + b.inside and b.narrow(e)]
    values = _ranked_values(df, brackets) if any(b.inside for b in brackets) else {}

    def result(i: int, b: _Bracket) -> float | None:
        if not b.total:
            return None
        low, high = (values.get((i, rank), math.nan) for rank in b.ranks)
        return low if low == high else low + (high - low) * (b.p * (b.total - 1) - b.ranks[0])

    names = [quantile_name(b.column, b.p) for b in brackets]
    schema = ", ".join(f"`{name}` double" for name in names)
    return df.sparkSession.createDataFrame([[result(i, b) for i, b in enumerate(brackets)]], schema)


def approx_quantiles(df: DataFrame, requests: dict[str, list[float]], accuracy: int = 10_000) -> DataFrame:
    """The same row from one aggregation: actual values whose rank is off by at most n/accuracy."""
    if accuracy < 1 or not math.isfinite(accuracy):
        raise ValueError("accuracy must be a positive number")
    return df.agg(
        *[
            F.percentile_approx(F.col(c).cast("double"), p, accuracy).alias(quantile_name(c, p))
            for c, ps in requests.items()
            for p in ps
        ]
    )


def quantiles(df: DataFrame, requests: dict[str, list[float]], method: str = "exact") -> DataFrame:
    if method == "exact":
        return exact_quantiles(df, requests)
    if method == "approx":
        return approx_quantiles(df, requests)
    raise ValueError(f"Unknown quantile method: {method}")


def with_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row frame to every row (a broadcast of that one row)."""
    return df.crossJoin(F.broadcast(one_row.limit(1)))


def frozen(one_row: DataFrame) -> DataFrame:
    """Compute a one-row frame of fitted values now, so that later jobs do not compute it again."""
    return one_row.sparkSession.createDataFrame([one_row.first()], one_row.schema)

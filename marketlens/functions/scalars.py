"""Column expressions shared by the plans. All of them run in generated JVM code."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- money ---------------------------------------------------------------------------------------


def known(c: ColumnOrName) -> Column:
    """A number, or NULL where it is not one."""
    return F.nanvl(_col(c).cast("double"), F.lit(None).cast("double"))


def money_sum(c: ColumnOrName) -> Column:
    """SUM of amounts as they are, without rounding; NULL for a group without any value."""
    return F.sum(known(c))


def money_avg(c: ColumnOrName) -> Column:
    return F.avg(known(c))


# --- flags, bands, bounds ------------------------------------------------------------------------


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it is false or NULL."""
    return F.when(condition, 1).otherwise(0)


def late_delivery(delivered: ColumnOrName, estimated: ColumnOrName) -> Column:
    return flag(_col(delivered) > _col(estimated))


def band(c: ColumnOrName, steps: list[tuple[float, str]], default: str) -> Column:
    """Label of the first threshold reached, tested from the highest down."""
    out = F.lit(default)
    for threshold, label in sorted(steps):
        out = F.when(_col(c) >= threshold, label).otherwise(out)
    return out


def propensity_band(percentile: ColumnOrName) -> Column:
    return band(percentile, [(0.90, "High"), (0.60, "Medium")], "Low")


def band_order(c: ColumnOrName) -> Column:
    """Sort key of the ordered bands Low < Medium < High."""
    return F.when(_col(c) == "Low", 1).when(_col(c) == "Medium", 2).when(_col(c) == "High", 3)


def clip(c: ColumnOrName, lower: float | None = None, upper: float | None = None) -> Column:
    """Bound a value; NULL stays NULL."""
    out = _col(c)
    if lower is not None:
        out = F.when(out.isNotNull(), F.greatest(out, F.lit(lower)))
    if upper is not None:
        out = F.when(out.isNotNull(), F.least(out, F.lit(upper)))
    return out


def member(c: ColumnOrName, values: Iterable[str]) -> Column:
    return flag(_col(c).isin(list(values)))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, 0.0 where the denominator is 0 or NULL."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


# --- dates ---------------------------------------------------------------------------------------


def timestamp_or_null(c: ColumnOrName) -> Column:
    """Wall-clock timestamp; text that is no timestamp becomes NULL."""
    return _col(c).try_cast("timestamp_ntz")


def day_difference(end: ColumnOrName, start: ColumnOrName, mode: str = "calendar") -> Column:
    """Days between two timestamps: calendar days, or whole elapsed days rounded down."""
    if mode == "calendar":
        return F.datediff(_col(end), _col(start))
    if mode == "elapsed":
        seconds = F.timestamp_diff("SECOND", _col(start), _col(end))
        return F.floor(seconds / 86400).cast("int")
    raise ValueError(f"Unknown day difference mode: {mode}")


def within_dates(c: ColumnOrName, first: str | None, last: str | None) -> Column:
    """Inclusive date range as a half-open test on the raw timestamp, which scans can use."""
    out = F.lit(True)
    if first is not None:
        out = out & (_col(c) >= F.lit(first).cast("timestamp_ntz"))
    if last is not None:
        out = out & (_col(c) < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp_ntz"))
    return out


# --- text ----------------------------------------------------------------------------------------


def _capitalize(c: Column) -> Column:
    text = F.replace(c, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 2**31 - 1)))


def category_label(c: ColumnOrName) -> Column:
    """health_beauty -> 'Health beauty'; NULL -> 'Unknown'."""
    return F.coalesce(_capitalize(_col(c)), F.lit("Unknown"))


def feature_label(c: ColumnOrName) -> Column:
    """'state=SP' -> 'State: Sp'; names without '=' are only capitalised."""
    text = _col(c)
    parts = F.split(text, "=", 2)
    pair = F.concat(_capitalize(parts[0]), F.lit(": "), category_label(parts[1]))
    return F.when(text.isNull(), "Unknown").when(F.contains(text, F.lit("=")), pair).otherwise(_capitalize(text))


# Prefixes of encoded feature names and what replaces them, in this order.
FEATURE_PREFIXES = [
    ("numeric__", ""),
    ("categorical__", ""),
    ("first_product_category_", "first_category="),
    ("first_customer_state_", "state="),
    ("first_payment_type_", "payment="),
]


def clean_feature_name(c: ColumnOrName) -> Column:
    out = _col(c)
    for old, new in FEATURE_PREFIXES:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


# Column headers that do not follow the general rule.
SPECIAL_HEADERS = {
    "customer_unique_id": "Customer ID",
    "roc_auc": "ROC AUC",
    "avg_order_value": "Avg order value",
    "avg_repeat_probability": "Avg repeat probability",
    "abs_coefficient": "Absolute coefficient",
    "cvr": "CVR",
}


def header(name: str) -> str:
    return SPECIAL_HEADERS.get(name) or name.replace("_", " ").capitalize()


def percent_label(share: Column) -> Column:
    """0.1234 -> '12.3%'; rounded half up before formatting."""
    return F.format_string("%.1f%%", F.floor(share * 1000 + 0.5) / 10)


# --- seeded randomness ---------------------------------------------------------------------------


def hash_bucket(c: Column) -> Column:
    """First 32 bits of the md5 of a value, as a long: equal in every engine with md5."""
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("long")


def uniform(key: ColumnOrName, seed: int, stream: str) -> Column:
    """Uniform number in [0, 1) that depends only on key, seed and stream."""
    text = F.concat_ws("|", _col(key).cast("string"), F.lit(str(seed)), F.lit(stream))
    return hash_bucket(text) / F.lit(4294967296.0)

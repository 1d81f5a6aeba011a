"""URL filter: longest-rule verdicts, and gradient-boosted trees on lexical features for the rest.

Only DataFrame functions and Spark's own tree learner run here. Trees learn from the URLs that a rule
decides (label 1: blocked). Suffix statistics are the smoothed blocked share of a host's last label,
counted over the whole labelled part.

Defined results: a null URL, or one without "://", has an empty host and path and the trees judge it by
these; an empty table gives an empty result; repeated rows are judged row by row. Without labelled URLs
of both kinds there is nothing to learn from, and every URL that no rule decides is allowed.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import store

#: The trees are fitted on at most so many labelled URLs, those of the least hashes; every URL is judged.
FIT_ROWS = 8_000
TREES, DEPTH = 12, 4


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with all its subdomains, below a path."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def with_rules(pages: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """Adds host, path, rule and ruled (allow, block or null); the longest fitting rule wins, of equal ones the first."""
    ordered = sorted(rules, key=lambda r: -len(r.text))
    parts = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    first = [F.when(r.fits(F.col("host"), F.col("path")), F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("ruled"))) for r in ordered]
    none = F.lit(None).cast("struct<rule:string,ruled:string>")
    return parts.withColumn("_rule", F.coalesce(*first, none)).withColumns({"rule": F.col("_rule.rule"), "ruled": F.col("_rule.ruled")}).drop("_rule")


def entropy(text: Column) -> Column:
    """Bits per character of a string's characters."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(letters).cast("double")
    shares = F.transform(F.array_distinct(letters), lambda c: F.size(F.filter(letters, lambda x: x == c)) / n)
    return F.coalesce(-F.aggregate(shares, F.lit(0.0), lambda total, p: total + p * F.log2(p)), F.lit(0.0))


def features(rows: DataFrame, url: str = "url") -> DataFrame:
    """Adds the lexical features as double columns named f_*."""
    whole, host, path = F.coalesce(F.col(url), F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(whole, r"\?([^#]*)", 1)
    many = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    length = lambda text: F.length(text).cast("double")
    found = {
        "f_length": length(whole),
        "f_host_length": length(host),
        "f_path_length": length(path),
        "f_labels": many(host, r"[^.]+"),
        "f_depth": many(path, r"/[^/]+"),
        "f_digits": many(whole, "[0-9]") / F.greatest(length(whole), F.lit(1.0)),
        "f_host_digits": many(host, "[0-9]") / F.greatest(length(host), F.lit(1.0)),
        "f_hyphens": many(whole, "-"),
        "f_parameters": many(query, r"[^&]+"),
        "f_host_entropy": entropy(host),
        "f_path_entropy": entropy(path),
        "f_first_part": length(F.regexp_extract(path, r"^/([^/]*)", 1)),
        "f_secure": whole.startswith("https").cast("double"),
        "f_suffix_length": length(F.col("suffix")),
    }
    return rows.withColumn("suffix", F.regexp_extract("host", r"([^.]*)\.?$", 1)).withColumns(found)


def judge(pages: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """Every row of pages with host, path, rule, verdict and score (null where no model could be learned)."""
    if {"host", "path", "rule", "verdict", "score", "suffix"} & set(pages.columns) or any(c.startswith("f_") for c in pages.columns):
        raise ValueError("pages has columns with names of this operator's results")
    ruled = with_rules(pages, rules, url)
    labelled = ruled.where("ruled is not null").select(url, "host", "path", (F.col("ruled") == "block").cast("double").alias("label"))
    per_suffix = labelled.groupBy(F.regexp_extract("host", r"([^.]*)\.?$", 1).alias("suffix")).agg(F.count("*").alias("n"), F.sum("label").alias("blocked"))
    known = store(per_suffix, "suffixes")
    sample = store(labelled.orderBy(F.xxhash64(url, F.lit(17)), url).limit(FIT_ROWS), "labelled-urls")
    total = known.agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked")).first()
    out = pages.columns
    if not total.n or total.blocked in (0, total.n):
        return ruled.select(*out, "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("score"))
    overall = total.blocked / total.n
    shares = known.select("suffix", ((F.col("blocked") + 20 * overall) / (F.col("n") + 20)).alias("f_suffix_share"), F.log1p("n").alias("f_suffix_seen"))

    def prepared(rows: DataFrame) -> DataFrame:
        return features(rows, url).join(shares, "suffix", "left").fillna({"f_suffix_share": overall, "f_suffix_seen": 0.0})

    train = prepared(sample)
    names = sorted(c for c in train.columns if c.startswith("f_"))
    vector = VectorAssembler(inputCols=names, outputCol="f_vector")
    trees = GBTClassifier(featuresCol="f_vector", labelCol="label", maxIter=TREES, maxDepth=DEPTH, maxBins=32, stepSize=0.3, seed=7)
    # One sorted partition: equal samples give equal trees whatever the cluster; at most FIT_ROWS rows.
    fitted = vector.transform(store(train.coalesce(1).sortWithinPartitions(F.xxhash64(url, F.lit(17)), url), "url-features"))
    model = trees.fit(fitted.select("f_vector", "label"))
    scored = model.transform(vector.transform(prepared(ruled))).withColumn("score", vector_to_array("probability")[1])
    verdict = F.coalesce("ruled", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select(*out, "host", "path", "rule", verdict.alias("verdict"), "score")

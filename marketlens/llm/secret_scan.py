"""Secret scan: fixed patterns, and a battery of randomness tests with false-discovery control. DataFrame functions only.

Every run of at least TOKEN characters of an encoding is a candidate. Its encoding is the smallest alphabet
that holds it. Three tests ask whether its symbols could be uniform draws: chi-squared over the alphabet, runs
of lower and upper half, serial correlation of neighbours; Fisher's sum joins their p-values. A candidate that
could be random is then weighed against ordinary strings of its encoding and length: the p-value is the chance
that symbols as uneven as ordinary ones (ORDINARY: their share of equal pairs) come out as even as these.
Benjamini and Hochberg's rule at LEVEL, applied to the distinct candidates of each (encoding, octave of
lengths) over all documents, decides. So short strings, of which chance makes many even ones, need more
company of secrets than long ones, and do not spoil the threshold of long ones.

p-values enter the rule as whole hundredths of their logarithm, rounded to the safe side, so that it needs one
count per hundredth; thresholds (a few hundred numbers) go through the driver, candidates never do.

Defined results: null and empty texts have no spans; repeated rows and null ids are rows of their own, equal
candidates count once in the rule (by 64-bit hash); texts of any length are scanned whole; ties of equal
starts go by kind; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import store

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "random")
#: Least characters of a candidate; least joint p-value of the battery; level of the false-discovery rule.
TOKEN, CONSISTENT, LEVEL = 20, 0.001, 0.01
#: Steps of a tenfold in the p-values of the rule, and the smallest p-value told apart (10 ** -SMALLEST).
STEPS, SMALLEST = 100, 60
#: Elements of an array whose running sums are made at once.
_RUN = 128


@dataclass(frozen=True)
class Encoding:
    """Symbols in the order of their values; equal_pairs: share of equal pairs of symbols in ordinary strings of it."""

    symbols: str
    pattern: str
    equal_pairs: float


_LOW, _UP, _NUM = string.ascii_lowercase, string.ascii_uppercase, string.digits
#: The first whose pattern fits is a candidate's encoding. Prose has some 0.066 equal pairs of letters; dates and padded counters some 0.2 of digits.
ENCODINGS = (
    Encoding(_NUM, "^[0-9]+$", 0.2),
    Encoding(_NUM + "abcdef", "^[0-9a-f]+$", 0.2),
    Encoding(_NUM + "ABCDEF", "^[0-9A-F]+$", 0.2),
    Encoding(_LOW, "^[a-z]+$", 0.066),
    Encoding(_UP, "^[A-Z]+$", 0.066),
    Encoding(_UP + "234567", "^[A-Z2-7]+$", 0.066),
    Encoding(_NUM + _LOW, "^[0-9a-z]+$", 0.06),
    Encoding(_NUM + _UP, "^[0-9A-Z]+$", 0.06),
    Encoding(_UP + _LOW + _NUM, "^[0-9A-Za-z]+$", 0.055),
    Encoding(_UP + _LOW + _NUM + "+/", "^[0-9A-Za-z+/]+$", 0.055),
    Encoding(_UP + _LOW + _NUM + "-_", "^[0-9A-Za-z_-]+$", 0.055),
    Encoding(_UP + _LOW + _NUM + "+/-_", "", 0.055),
)


def running_sums(steps: Column) -> Column:
    """Sums of the elements before each one; blocks keep the work far below the square of the length."""
    n = F.size(steps)

    def block(c: Column) -> Column:
        start = F.aggregate(F.slice(steps, 1, c * _RUN), F.lit(0), lambda s, x: s + x)
        grown = F.aggregate(F.slice(steps, c * _RUN + 1, _RUN), F.array(start), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
        return F.slice(grown, 1, F.size(grown) - 1)

    blocks = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / _RUN).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(blocks, block))


def matches(text: Column, pattern: str, possible: Column, kind: int, least_group: int = 0) -> Column:
    """Array of (start, kind, stop, secret) of the leftmost non-overlapping matches, in code points.

    possible: a cheap condition that every text with a match meets. least_group: least length of group 2; shorter ones drop.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    # (length of the match, of the gap before it, the match, whether it stays)
    parts = F.zip_with(gaps, whole, lambda gap, found: F.struct(F.length(found).alias("n"), F.length(gap).alias("gap"), found.alias("secret"), F.lit(True).alias("stays")))
    if least_group:
        group = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
        parts = F.zip_with(parts, group, lambda p, g: F.struct(p.n.alias("n"), p.gap.alias("gap"), p.secret.alias("secret"), (F.length(g) >= least_group).alias("stays")))
    parts = F.filter(parts, lambda p: p.n.isNotNull())  # the gap after the last match
    before = running_sums(F.transform(parts, lambda p: p.n + p.gap))
    spans = F.zip_with(parts, before, lambda p, at: F.struct((at + p.gap).alias("start"), F.lit(kind).alias("kind"), (at + p.gap + p.n).alias("stop"), p.secret.alias("secret"), p.stays.alias("stays")))
    kept = F.transform(F.filter(spans, lambda s: s.stays), lambda s: s.dropFields("stays"))
    return F.when(possible, kept).otherwise(F.array().cast("array<struct<start:int,kind:int,stop:int,secret:string>>"))


def upper_tail(z: str) -> str:
    """SQL for the normal chance of more than z: complementary error function by a fitted exponential, 1e-7 relative."""
    # The coefficients of that well-known fit, the constant term first.
    fit = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    x, t = f"(abs({z}) / sqrt(2D))", f"(1 / (1 + 0.5D * abs({z}) / sqrt(2D)))"
    poly = f"{fit[-1]}D"
    for c in reversed(fit[:-1]):
        poly = f"({c}D + {t} * {poly})"
    tail = f"(0.5D * {t} * exp(-{x} * {x} + {poly}))"
    return f"(CASE WHEN {z} >= 0 THEN {tail} ELSE 1 - {tail} END)"


def battery(spans: str) -> Column:
    """SQL over an array column of spans: adds encoding, n, p_random (joint p-value of the tests) and p_ordinary to each."""
    pick = lambda values: f"element_at(array({', '.join(values)}), c.encoding)"
    which = " ".join(f"WHEN rlike(c.body, '{e.pattern}') THEN {i}" for i, e in enumerate(ENCODINGS[:-1], 1))
    tiny = f"1e-{5 * SMALLEST}D"
    ratios = [(1 - e.equal_pairs) / (1 + e.equal_pairs) for e in ENCODINGS]  # ordinary symbols fall off geometrically
    triples = [f"{(1 - r) ** 3 / (1 - r**3)!r}D" for r in ratios]
    pairs = [f"{e.equal_pairs!r}D" for e in ENCODINGS]
    symbols = [repr(e.symbols) for e in ENCODINGS]
    halves = [repr("0" * (len(e.symbols) // 2) + "1" * (len(e.symbols) - len(e.symbols) // 2)) for e in ENCODINGS]
    # Each step binds names for the next one; c is a candidate.
    steps = [
        "named_struct('span', c, 'body', trim(TRAILING '=' FROM c.secret))",
        f"named_struct('span', c.span, 'body', c.body, 'n', cast(length(c.body) as double), 'encoding', CASE {which} ELSE {len(ENCODINGS)} END)",
        f"named_struct('own', c, 'symbols', {pick(symbols)}, 'halves', translate(c.body, {pick(symbols)}, {pick(halves)}), 'pairs', {pick(pairs)}, 'triples', {pick(triples)})",
        # Counts: symbols of the upper half, changes of half, squared counts of every symbol, values of the symbols.
        "named_struct('own', c.own, 'n', c.own.n, 'k', cast(length(c.symbols) as double), 'pairs', c.pairs, 'triples', c.triples, 'ones', length(replace(c.halves, '0', '')),"
        " 'changes', (2 * length(c.halves) - length(replace(c.halves, '01', '')) - length(replace(c.halves, '10', ''))) / 2D,"
        " 'squares', aggregate(sequence(1, length(c.symbols)), 0D, (s, i) -> s + power(length(c.own.body) - length(replace(c.own.body, substring(c.symbols, i, 1), '')), 2)),"
        " 'x', transform(filter(split(c.own.body, ''), s -> s <> ''), s -> cast(instr(c.symbols, s) as double)))",
        "named_struct('own', c.own, 'n', c.n, 'k', c.k, 'pairs', c.pairs, 'triples', c.triples, 'changes', c.changes, 'split', 2 * c.ones * (c.n - c.ones), 'chi', greatest(0D, c.k / c.n * c.squares - c.n),"
        " 'sum', aggregate(c.x, 0D, (s, v) -> s + v), 'squared', aggregate(c.x, 0D, (s, v) -> s + v * v),"
        " 'lagged', aggregate(zip_with(c.x, concat(slice(c.x, 2, size(c.x)), slice(c.x, 1, 1)), (a, b) -> a * b), 0D, (s, v) -> s + v))",
        # Normal scores: cube root of chi-squared, runs, circular serial correlation; then chi-squared against ordinary strings.
        "named_struct('own', c.own, 'n', c.n, 'z_chi', (power(c.chi / (c.k - 1), 1 / 3D) - 1 + 2 / (9 * (c.k - 1))) / sqrt(2 / (9 * (c.k - 1))),"
        " 'z_runs', CASE WHEN c.split > c.n THEN abs(c.changes - c.split / c.n) / sqrt(c.split * (c.split - c.n) / (c.n * c.n * (c.n - 1))) END,"
        " 'z_serial', CASE WHEN c.n * c.squared > c.sum * c.sum THEN abs((c.n * c.lagged - c.sum * c.sum) / (c.n * c.squared - c.sum * c.sum) + 1 / (c.n - 1)) * (c.n - 1) * sqrt(c.n - 2) / c.n END,"
        " 'z_even', ((c.k - 1) + (c.n - 1) * (c.k * c.pairs - 1) - c.chi) / (c.k / c.n * sqrt(2 * c.n * (c.n - 1) * (c.pairs + 2 * (c.n - 2) * c.triples - (2 * c.n - 3) * c.pairs * c.pairs))))",
        # A string of one half, or of one symbol, has no score: its chance is that of such a string.
        f"named_struct('own', c.own, 'p_ordinary', {upper_tail('c.z_even')}, 'logs', ln(greatest({tiny}, {upper_tail('c.z_chi')}))"
        f" + ln(greatest({tiny}, coalesce(2 * {upper_tail('c.z_runs')}, power(2D, 1 - c.n)))) + ln(greatest({tiny}, coalesce(2 * {upper_tail('c.z_serial')}, 0D))))",
        "named_struct('start', c.own.span.start, 'kind', c.own.span.kind, 'stop', c.own.span.stop, 'secret', c.own.span.secret, 'encoding', c.own.encoding, 'n', c.own.n,"
        " 'p_random', exp(c.logs) * (1 - c.logs + c.logs * c.logs / 2), 'p_ordinary', c.p_ordinary)",
    ]
    for step in steps:
        spans = f"transform({spans}, c -> {step})"
    return F.expr(spans)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, base, candidates) of every document: spans of the fixed patterns, and candidates with their p-values."""
    text, small = F.col("text"), F.lower("text")
    rows = docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text"))
    # One pass that most texts fail: a secret of the last three kinds holds a long run.
    rows = rows.withColumn("long", text.rlike(f"[A-Za-z0-9+/_-]{{{TOKEN}}}"))
    named = F.lit(False)
    for word in KEYWORDS:
        named = named | small.contains(word)
    fixed = [matches(text, ASSIGN, named, 0, 6), matches(text, ACCESS, F.col("long") & text.contains("AKIA"), 1), matches(text, HEX, F.col("long"), 2)]
    run = matches(text, rf"[A-Za-z0-9+/_-]{{{TOKEN},}}={{0,2}}", F.col("long"), 3)
    found = rows.select("doc_id", F.array_sort(F.concat(*fixed)).alias("base"), run.alias("runs"))
    score = (
        "transform(tested, c -> named_struct('start', c.start, 'kind', c.kind, 'stop', c.stop, 'secret', c.secret, 'stratum', 64 * c.encoding + cast(floor(log2(c.n)) as int),"
        f" 'p_random', c.p_random, 'p_ordinary', c.p_ordinary, 'step', CASE WHEN c.p_random < {CONSISTENT}D THEN 0 ELSE"
        f" least({STEPS * SMALLEST}, greatest(0, cast(floor(-{STEPS} * log10(greatest(1e-300D, c.p_ordinary))) as int))) END))"
    )
    return found.withColumn("tested", battery("runs")).select("doc_id", "base", F.expr(score).alias("candidates"))


def thresholds(scanned: DataFrame, level: float = LEVEL) -> dict[int, int]:
    """Least step of each stratum that the false-discovery rule takes; strata without any are left out.

    A stratum's counts are at most STEPS * SMALLEST rows, and strata are a few hundred.
    """
    each = scanned.select(F.explode("candidates").alias("c")).select("c.stratum", "c.step", F.xxhash64("c.secret").alias("token")).distinct()
    counts = each.groupBy("stratum", "step").agg(F.count("*").alias("n"))
    by = Window.partitionBy("stratum")
    counts = counts.withColumns({"all": F.sum("n").over(by), "up": F.sum("n").over(by.orderBy(F.desc("step")))})
    taken = counts.where(F.pow(F.lit(10.0), -F.col("step") / STEPS) * F.col("all") <= level * F.col("up"))
    return {r.stratum: r.step for r in taken.groupBy("stratum").agg(F.min("step").alias("step")).collect()}


def find(docs: DataFrame, level: float = LEVEL) -> DataFrame:
    """(doc_id, spans), a row per row of docs (doc_id, text).

    spans: array of (start, kind, stop, secret) by start, then kind; places in KINDS, code points, end exclusive.
    A random candidate that a fixed pattern already covers in part is left out.
    """
    scanned = store(scan(docs), "secret-scan")
    limits = thresholds(scanned, level)
    if limits:
        pairs = [F.lit(v) for item in sorted(limits.items()) for v in item]
        limit = lambda c: F.try_element_at(F.create_map(*pairs), c.stratum)
        free = lambda c: ~F.exists("base", lambda b: (b.start < c.stop) & (b.stop > c.start))
        more = F.filter("candidates", lambda c: (c.step >= limit(c)) & free(c))
        more = F.transform(more, lambda c: F.struct(c.start.alias("start"), c.kind.alias("kind"), c.stop.alias("stop"), c.secret.alias("secret")))
        spans = F.array_sort(F.concat("base", more))
    else:
        spans = F.col("base")
    return scanned.select("doc_id", spans.alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of rows of find()."""
    kinds = F.array(*map(F.lit, KINDS))
    base = F.filter("spans", lambda s: s.kind < 3)
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s.kind + 1), s.start, s.stop)), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed("spans").alias("spans"))

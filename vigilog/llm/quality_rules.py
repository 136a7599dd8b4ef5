"""Quality rules: robust multivariate outliers per language and source.

A document's statistics are turned into a vector of log rates. For every group a minimum
covariance determinant estimate is found by concentration steps: start from medians and
quartiles, take the CORE share of rows nearest to the centre, estimate mean and covariance from
them, and repeat until the centre stands still. Documents far from their group's estimate, by
Mahalanobis distance, are rejected. DataFrame functions only.

Vectors are whole numbers of 1/SCALE and distances are compared by bins, so sums are exact and
the estimates don't depend on the order of rows.
"""

from __future__ import annotations

from functools import reduce
from math import exp, lgamma, log
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .base import Registry, documents, join_small, staged

ops = Registry()

CORE = 0.75  # share of a group's rows that the estimate rests on
FAR = 1e-6  # chance that a row of a normal group is rejected
MIN_ROWS = 200  # groups with fewer rows are judged by their language, then by all rows
STEPS = 30  # at most
STILL = 0.01  # an estimate stands when its centre moves by less than this share of the least deviations
SCALE = 256
BINS = 128  # per unit of the distance's logarithm
PRIOR_WORDS = 50.0  # rates of short documents are drawn down as by so many more words
SPREAD = (0.35, 0.35, 0.35, 0.35, 0.35)  # least standard deviation of each statistic
SIZE = len(SPREAD)
_BLANK = r"[\x20\x09-\x0D]"
_LEVELS = ("lang and source", "lang", "all")


def base_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    Words are runs without blanks; null text has none. Windows of three words are compared by
    hashes of at least 44 bits, up to texts of a million words.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split(text, f"{_BLANK}+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    docs = docs.withColumn("__words", words).withColumn("__lines", lines).withColumn("__n", F.size("__words"))
    bits = F.ceil(F.log2(F.col("__n") + 1.0)).cast("int")
    windows = F.transform(
        F.when(F.col("__n") > 2, F.sequence(F.lit(0), F.col("__n") - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.call_function(
            "shiftleft",
            F.xxhash64(*(F.get("__words", i + k) for k in range(3))),
            F.col("__bits"),
        ).bitwiseOR(i.cast("bigint")),
    )
    docs = docs.withColumn("__bits", bits).withColumn("__sorted", F.sort_array(windows))

    def window(v: Column) -> Column:
        return F.call_function("shiftright", v, F.col("__bits"))

    again = F.filter(
        "__sorted",
        lambda v, k: (window(v) == window(F.get("__sorted", k - 1))) | (window(v) == window(F.get("__sorted", k + 1))),
    )
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("__bits")) - 1
    places = F.sort_array(F.transform(again, lambda v: v.bitwiseAND(mask)))
    docs = docs.withColumn("__places", places)
    covered = F.aggregate(
        F.transform("__places", lambda p, k: F.least(F.lit(3).cast("bigint"), F.coalesce(p - F.get("__places", k - 1), F.lit(3).cast("bigint")))),
        F.lit(0).cast("bigint"),
        lambda s, x: s + x,
    )
    docs = (
        docs.withColumn("n_words", F.col("__n").cast("bigint"))
        .withColumn("word_chars", F.char_length(F.array_join("__words", "")).cast("bigint"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint"))
        .withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"))
        .withColumn("n_lines", F.size("__lines").cast("bigint"))
        .withColumn("n_repeat_words", covered)
        .withColumn("n_capitals", F.regexp_count(text, F.lit(r"\p{Lu}")).cast("bigint"))
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return docs.withColumn("base_failed", failed).drop("__words", "__lines", "__n", "__bits", "__sorted", "__places")


def vector() -> list[Column]:
    """The transformed statistics, in whole numbers of 1/SCALE."""

    def rate(part: str, of: str, prior: float, least: float) -> Column:
        return F.log(F.col(part) / (F.col(of) + prior) + least)

    stats = (
        2 * F.log((F.col("word_chars") + 5.5 * PRIOR_WORDS) / (F.col("n_words") + PRIOR_WORDS)),
        rate("n_symbols", "n_words", PRIOR_WORDS, 0.02),
        rate("n_repeat_words", "n_words", PRIOR_WORDS, 0.1),
        rate("n_dup_lines", "n_lines", 5.0, 0.1),
        rate("n_capitals", "word_chars", 5.5 * PRIOR_WORDS, 0.03),
    )
    return [F.round(x * SCALE).cast("bigint") for x in stats]


def _chi_square(p: int, share: float) -> float:
    """Quantile of the chi-square law with p degrees of freedom, by bisection on its series."""

    def below(x: float) -> float:
        term = total = exp(-x / 2 + p / 2 * log(x / 2) - lgamma(p / 2 + 1))
        k = 1
        while term > 1e-17 * total and k < 10_000:
            term *= x / 2 / (p / 2 + k)
            total += term
            k += 1
        return total

    low, high = 1e-6, 400.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < share else (low, mid)
    return low


def _consistency(p: int, share: float) -> float:
    """Factor from the covariance of the nearest ``share`` of normal rows to that of all."""
    q = _chi_square(p, share)
    low, high = 0.0, 1.0
    for _ in range(60):  # share of the law with p + 2 degrees below q
        mid = (low + high) / 2
        low, high = (mid, high) if 0 < mid < 1 and _chi_square(p + 2, mid) < q else (low, mid)
    return share / low


def _distance() -> Column:
    """Squared Mahalanobis distance of the vector x from (centre, inverse)."""
    off = [F.col("x")[i] / float(SCALE) - F.col("centre")[i] for i in range(SIZE)]
    total = F.lit(0.0)
    for i in range(SIZE):
        for j in range(i, SIZE):
            total = total + (1 if i == j else 2) * F.col("inverse")[i * SIZE + j] * off[i] * off[j]
    return total


def _starts(rows: DataFrame) -> DataFrame:
    """Per group: rows, median and inverse of the squared quartile spread of each statistic."""
    values = rows.select("group", F.posexplode("x").alias("i", "v")).groupBy("group", "i", "v").agg(F.count("*").alias("n"))
    order = W.partitionBy("group", "i").orderBy("v")
    values = values.withColumn("upto", F.sum("n").over(order)).withColumn("of", F.sum("n").over(W.partitionBy("group", "i")))
    marks = values.groupBy("group", "i").agg(
        F.max("of").alias("rows"),
        *[F.min(F.when(4 * F.col("upto") >= q * F.col("of"), F.col("v"))).alias(f"q{q}") for q in (1, 2, 3)],
    )
    least = F.array(*[F.lit(s) for s in SPREAD])
    spread = F.greatest((F.col("q3") - F.col("q1")) / (SCALE * 1.349), F.get(least, F.col("i")))
    marks = marks.select("group", "rows", "i", (F.col("q2") / float(SCALE)).alias("m"), (1 / (spread * spread)).alias("w"))
    centre = [F.max(F.when(F.col("i") == i, F.col("m"))) for i in range(SIZE)]
    inverse = [F.max(F.when(F.col("i") == i // SIZE, F.col("w"))) if i // SIZE == i % SIZE else F.lit(0.0) for i in range(SIZE * SIZE)]
    return marks.groupBy("group").agg(F.max("rows").alias("rows"), F.array(*centre).alias("centre"), F.array(*inverse).alias("inverse"))


def _sweep(matrix: str, k: int) -> Column:
    """One Gauss-Jordan step over a flat positive definite matrix; all SIZE of them invert it."""

    def at(i, j) -> Column:
        return F.get(matrix, (i * SIZE + j).cast("int"))

    d = at(F.lit(k), F.lit(k))

    def entry(t: Column) -> Column:
        i, j = F.floor(t / SIZE), t % SIZE
        row, column = i == k, j == k
        rest = at(i, j) - at(i, F.lit(k)) * at(F.lit(k), j) / d
        return F.when(row & column, 1 / d).when(row, at(i, j) / d).when(column, -at(i, j) / d).otherwise(rest)

    return F.transform(F.sequence(F.lit(0), F.lit(SIZE * SIZE - 1)), entry)


def _concentrated(rows: DataFrame, now: DataFrame, factor: float) -> DataFrame:
    """One concentration step: mean and covariance of the nearest CORE share of each group."""
    bin_ = F.floor(F.log(_distance() + 1e-3) * BINS)
    pairs = [(i, j) for i in range(SIZE) for j in range(i, SIZE)]
    sums = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(SIZE)]
    sums += [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"p{i}_{j}") for i, j in pairs]
    binned = rows.join(now, "group").groupBy("group", "rows", bin_.alias("bin")).agg(F.count("*").alias("n"), *sums)
    before = F.sum("n").over(W.partitionBy("group").orderBy("bin")) - F.col("n")
    core = binned.withColumn("before", before).where(F.col("before") < F.lit(CORE) * F.col("rows"))
    names = ["n", *[f"s{i}" for i in range(SIZE)], *[f"p{i}_{j}" for i, j in pairs]]
    core = core.groupBy("group", "rows").agg(*[F.sum(c).alias(c) for c in names])
    mean = [F.col(f"s{i}") / F.col("n") / SCALE for i in range(SIZE)]
    spread = [
        factor * (F.col(f"p{min(i, j)}_{max(i, j)}") / F.col("n") / (SCALE * SCALE) - mean[i] * mean[j])
        + (SPREAD[i] ** 2 if i == j else 0.0)
        for i in range(SIZE)
        for j in range(SIZE)
    ]
    found = core.select("group", "rows", F.array(*mean).alias("centre"), F.array(*spread).alias("inverse"))
    for k in range(SIZE):
        found = found.withColumn("inverse", _sweep("inverse", k))
    return found


def estimates(rows: DataFrame) -> DataFrame:
    """Per group of ``rows`` (group, x): rows, centre, inverse covariance."""
    factor = _consistency(SIZE, CORE)
    now = staged(_starts(rows), "mcd")
    for _ in range(STEPS):
        after = staged(_concentrated(rows, now, factor), "mcd")
        near = [F.abs(F.col("a.centre")[i] - F.col("b.centre")[i]) <= STILL * SPREAD[i] for i in range(SIZE)]
        same = reduce(and_, near)
        moved = after.alias("a").join(now.alias("b"), "group").where(~same).limit(1).count()
        now = after
        if not moved:
            break
    return now


def judged(docs: DataFrame) -> DataFrame:
    """``docs`` with the base statistics, the squared ``distance``, ``level`` and ``kept``.

    Documents that fail the base rules are rejected and don't enter the estimates. A group of
    fewer than MIN_ROWS such documents is judged by the estimate of its language, or of all. Null
    language or source is a group of its own. With no estimate at all (no document passes the base
    rules) nothing more is rejected. The text is not returned; of other columns doc_id, lang and
    source stay. Repeated rows count as often as they occur.
    """
    stats = base_statistics(docs.select("doc_id", "text", "lang", "source", F.xxhash64("doc_id", "text", "lang", "source").alias("row_hash")))
    stats = stats.drop("text").withColumn("x", F.array(*vector()))
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("lang", "source"))
    names = F.array(F.to_json(F.struct(lang.alias("l"), source.alias("s"))), F.to_json(F.struct(lang.alias("l"))), F.lit("all"))
    stats = staged(stats.withColumn("groups", names), "statistics")
    rows = stats.where("NOT base_failed").select("x", F.explode("groups").alias("group"))
    rows = staged(rows, "vectors")
    found = staged(estimates(rows).where((F.col("rows") >= MIN_ROWS) | (F.col("group") == "all")), "estimates")
    cut = _chi_square(SIZE, 1 - FAR)
    for level in range(3):
        keys = found.select(F.col("group").alias(f"g{level}"), F.struct("centre", "inverse").alias(f"e{level}"))
        stats = join_small(stats.withColumn(f"g{level}", F.col("groups")[level]), keys, f"g{level}", "left")
    e = F.coalesce("e0", "e1", "e2")
    level = F.when(F.col("e0").isNotNull(), _LEVELS[0]).when(F.col("e1").isNotNull(), _LEVELS[1]).when(F.col("e2").isNotNull(), _LEVELS[2])
    stats = stats.withColumn("level", level).withColumn("__e", e)
    stats = stats.withColumn("centre", F.col("__e.centre")).withColumn("inverse", F.col("__e.inverse"))
    stats = stats.withColumn("distance", _distance())
    keep = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cut)
    return stats.select(
        "doc_id", "lang", "source", "row_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "n_capitals", "base_failed", "level", "distance", keep.alias("kept"), "x",
    )


@ops.add()
def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return judged(documents(spark, folder)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance", 3).alias("distance")
    )

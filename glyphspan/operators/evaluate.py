"""Evaluation and statistics: tallies, percentiles, deviations, comparisons by position, runs, carried values."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tally(df: DataFrame, key: str, threshold: int = 1) -> DataFrame:
    """(key, n) of keys seen at least ``threshold`` times."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= threshold)


def percentiles(df: DataFrame, by: str, value: str, points=(50, 90, 99)) -> DataFrame:
    """Nearest-rank percentiles."""
    each = [F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY {value})").alias(f"p{p}") for p in points]
    return df.groupBy(by).agg(F.count(value).alias("n"), *each)


def zip_compare(left: DataFrame, right: DataFrame, key: str, words: str = "words") -> DataFrame:
    """(key, correct, incorrect, total): two word arrays of a key by position; the longer one's surplus is incorrect."""
    both = left.select(key, F.col(words).alias("a")).join(right.select(key, F.col(words).alias("b")), key)
    total = F.greatest(F.size("a"), F.size("b"))
    correct = F.size(F.filter(F.arrays_zip("a", "b"), lambda x: x["a"] == x["b"]))
    return both.select(key, correct.alias("correct"), (total - correct).alias("incorrect"), total.alias("total"))


def runs(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """(by, run, value, first, last, n): stretches of equal values in order."""
    w = Window.partitionBy(by).orderBy(order)
    new = F.coalesce((F.lag(value).over(w) != F.col(value)).cast("int"), F.lit(1))
    marked = df.withColumn("__new", new).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(by, "run", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))


def carried(value: str | Column, by: str, order: list[str]) -> Column:
    """The last value that was not null."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(value, ignorenulls=True).over(w)


def compare_groups(df: DataFrame, by: str, group: str, value: str) -> DataFrame:
    """(by, n_a, n_b, mean_a, mean_b): samples of two groups, ``group`` being a Boolean column."""
    of = lambda f, b: f(F.when(F.col(group) == b, F.col(value)))
    return df.groupBy(by).agg(of(F.count, False).alias("n_a"), of(F.count, True).alias("n_b"), F.round(of(F.avg, False), 6).alias("mean_a"), F.round(of(F.avg, True), 6).alias("mean_b"))


def tag_profile(pages: DataFrame, html: str = "html") -> DataFrame:
    """(tag, n, pages): element names, how often and in how many pages."""
    tags = pages.select("page_id", F.explode(F.regexp_extract_all(F.lower(html), F.lit("<([a-z][a-z0-9]*)"), F.lit(1))).alias("tag"))
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page_id").alias("pages"))


def accuracy(compared: DataFrame, doc: str) -> DataFrame:
    """(doc, correct, incorrect, total, accuracy) by document and, with a null document, over all."""
    sums = compared.rollup(doc).agg(*[F.sum(c).alias(c) for c in ("correct", "incorrect", "total")])
    return sums.withColumn("accuracy", F.when(F.col("total") > 0, F.col("correct") / F.col("total")))


def errors_in_context(golden: DataFrame, versions: DataFrame, key: str, words: str = "words", size: int = 4) -> DataFrame:
    """(key, pos, expected, processor, got, context): words in which a version (key, processor, words) differs from the golden one.

    The context has ``size`` words before and, from the word on, ``size`` words; the word itself stands between asterisks.
    """
    gold = golden.select(F.col(key).alias("key"), F.col(words).alias("gold"))
    both = gold.join(versions.select(F.col(key).alias("key"), "processor", F.col(words).alias("own")), "key")
    each = both.select("key", "processor", "gold", F.posexplode(F.arrays_zip("gold", "own")).alias("pos", "w")).where(~F.col("w.gold").eqNullSafe(F.col("w.own")) & (F.col("pos") < F.size("gold")))
    first = F.greatest(F.col("pos") - size, F.lit(0))
    marked = F.concat(F.slice("gold", first + 1, F.col("pos") - first), F.array(F.concat(F.lit("*"), F.col("w.gold"), F.lit("*"))), F.slice("gold", F.col("pos") + 2, F.lit(size - 1)))
    return each.select(F.col("key").alias(key), "pos", F.col("w.gold").alias("expected"), "processor", F.col("w.own").alias("got"), F.array_join(marked, " ").alias("context"))


def t_test(df: DataFrame, by: str, group: str, value: str) -> DataFrame:
    """(by, mean_a, mean_b, diff_percent, t, freedom, samples, p_value): the two-sample t-test of equal variances.

    ``group`` is a Boolean column; ``samples`` is the lesser number of values.  Nothing can be said of fewer than two values.
    """
    of = lambda f, b: f(F.when(F.col(group) == b, F.col(value)))
    each = df.groupBy(by).agg(*[of(f, b).alias(f"{n}_{x}") for x, b in (("a", False), ("b", True)) for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))])
    freedom = F.col("n_a") + F.col("n_b") - 2
    pooled = ((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b")) / freedom
    t = (F.col("mean_b") - F.col("mean_a")) / F.sqrt(pooled * (1 / F.col("n_a") + 1 / F.col("n_b")))
    ok = (F.col("n_a") > 1) & (F.col("n_b") > 1) & (pooled > 0)
    out = each.select(by, "mean_a", "mean_b", ((F.col("mean_b") - F.col("mean_a")) / F.col("mean_a") * 100).alias("diff_percent"), F.when(ok, t).alias("t"), freedom.alias("freedom"), F.least("n_a", "n_b").alias("samples"))

    @F.pandas_udf("double")
    def two_sided(ts: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(t) else beta_share(n / (n + t * t), n / 2, 0.5) for t, n in zip(ts, ns, strict=True)], dtype="float64")

    return out.withColumn("p_value", two_sided("t", "freedom"))


def beta_share(x: float, a: float, b: float) -> float:
    """The regularized incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    value = 0.0
    for m in range(300, 0, -1):  # from the inside out
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m - 1) * (a + b + m - 1) * x / ((a + 2 * m - 2) * (a + 2 * m - 1))
        value = odd / (1 + even / (1 + value)) if m > 0 else value
    return front / (1 + value)


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """(key, n, exact): keys of several rows, and whether the rows are all alike."""
    rest = [c for c in df.columns if c != key]
    found = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.to_json(F.struct(*rest))).alias("kinds")).where("n > 1")
    return found.select(key, "n", (F.col("kinds") == 1).alias("exact"))


def line_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, line, a, b): lines of two texts (key, line, text) that differ at the same place, or stand in one alone."""
    both = a.select(key, "line", F.col("text").alias("a")).join(b.select(key, "line", F.col("text").alias("b")), [key, "line"], "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b")))


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(test, metric, mean_a, mean_b, diff_percent, t, freedom, samples, p_value): samples (test, metric, value) of two runs compared.

    A test's samples of one metric are pooled, in however many rows they come.  Metrics of one run alone are left out.
    """
    both = a.select("test", "metric", "value", F.lit(False).alias("later")).unionByName(b.select("test", "metric", "value", F.lit(True).alias("later")))
    rows = t_test(both.withColumn("k", F.struct("test", "metric")), "k", "later", "value").where("samples > 0")
    return rows.select("k.*", *[c for c in rows.columns if c != "k"])


def unmatched_tests(a: DataFrame, b: DataFrame) -> DataFrame:
    """(test) of run ``b`` that ``a`` does not have; comparing them would be a mistake."""
    return b.select("test").distinct().join(a.select("test").distinct(), "test", "left_anti")


def report(compared: DataFrame, metrics: list[str], most_p: float = 0.01, least_percent: float = 1.0) -> DataFrame:
    """(metric, outcome, tests): in how many tests each of ``metrics`` improved (is less) or regressed beyond chance and noise."""
    told = compared.where(F.col("metric").isin(metrics) & (F.col("p_value") <= most_p) & (F.abs("diff_percent") >= least_percent))
    outcome = F.when(F.col("diff_percent") > 0, "regressed").otherwise("improved")
    return told.groupBy("metric", outcome.alias("outcome")).agg(F.count_distinct("test").alias("tests"))


def ordinals(df: DataFrame, key: str | Column, order: str, block: int = 100_000) -> DataFrame:
    """``df`` with ``ordinal``: how many rows of the same key come before, by a whole number ``order`` that no two of them share.

    Rows are counted in blocks of ``order`` first, so a key with a large part of all rows is not one task's work.
    """
    marked = df.withColumns({"__key": F.col(key) if isinstance(key, str) else key, "__block": F.floor(F.col(order) / block)})
    sizes = marked.groupBy("__key", "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__key").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__key", "__block", F.coalesce(before, F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__key", "__block").orderBy(order)) - 1
    numbered = marked.withColumn("__at", inside).alias("m").join(starts.alias("s"), F.col("m.__key").eqNullSafe(F.col("s.__key")) & F.col("m.__block").eqNullSafe(F.col("s.__block")))
    return numbered.select(*[f"m.{c}" for c in df.columns], (F.col("__start") + F.col("__at")).alias("ordinal"))

"""Summaries of result tables: grouped, bucketed, ranked and compared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_runs(results: DataFrame, key: str, counters: list[str], time: str) -> DataFrame:
    """One row per key: counters averaged and truncated, the least time over the runs."""
    return results.groupBy(key).agg(*(F.floor(F.avg(c)).cast("bigint").alias(c) for c in counters), F.min(time).alias(time))


def bucketed(results: DataFrame, depth: str, value: str, step: int) -> DataFrame:
    """(bucket, n, mean, sd) over buckets [1 + i * step, 1 + (i + 1) * step); nulls and NaNs are left out."""
    clean = results.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & F.col(depth).isNotNull())
    bucket = (F.floor((F.col(depth) - 1) / step) * step + 1).cast("bigint")
    return clean.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))


def summary(results: DataFrame, by: str, value: str, at_least: int = 1) -> DataFrame:
    """n, min, q1, median, mean, q3, max, sd per group; quantiles interpolate; small groups go."""
    q = lambda p: F.percentile(F.col(value), F.lit(p))
    out = results.where(F.col(value).isNotNull()).groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.min(value).alias("min"), q(0.25).alias("q1"), q(0.5).alias("median"), F.avg(value).alias("mean"),
        q(0.75).alias("q3"), F.max(value).alias("max"), F.stddev_samp(value).alias("sd"),
    )
    return out.where(F.col("n") >= at_least)


def outliers(results: DataFrame, by: str, value: str, width: float = 1.5) -> DataFrame:
    """Rows with ``outlier``: beyond ``width`` quartile ranges outside the quartiles of their group, or null."""
    q = results.groupBy(by).agg(F.percentile(F.col(value), F.lit(0.25)).alias("q1"), F.percentile(F.col(value), F.lit(0.75)).alias("q3"))
    spread = (F.col("q3") - F.col("q1")) * width
    flag = F.col(value).isNull() | (F.col(value) < F.col("q1") - spread) | (F.col(value) > F.col("q3") + spread)
    return results.join(q, by).select(*results.columns, flag.alias("outlier"))


def group_apply(results: DataFrame, by: str, function: Callable, schema: str) -> DataFrame:
    """Any function of one group's rows; a group must fit a task."""
    return results.groupBy(by).applyInPandas(function, schema)


def average_series(results: DataFrame, series: str, order: list[str], value: str) -> DataFrame:
    """(place, n, mean): the k-th values of all series averaged."""
    place = F.row_number().over(Window.partitionBy(series).orderBy(*order))
    return results.select(place.alias("place"), value).groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def chunk_means(results: DataFrame, series: str, order: list[str], value: str, size: int) -> DataFrame:
    """(series, chunk, n, mean) over chunks of fixed size."""
    place = F.row_number().over(Window.partitionBy(series).orderBy(*order))
    return results.select(series, F.floor((place - 1) / size).cast("bigint").alias("chunk"), value).groupBy(series, "chunk").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def runs_as_columns(results: DataFrame, key: str, run: str, runs: list, value: str) -> DataFrame:
    """One column run_<r> per run with its sum; the runs are named, so no pass is spent to find them."""
    return results.groupBy(key).agg(*(F.sum(F.when(F.col(run) == r, F.col(value))).alias(f"run_{r}") for r in runs))


def speedup(base: DataFrame, other: DataFrame, key: str, depth: str, value: str, step: int) -> DataFrame:
    """Bucketed mean of base / other on the same instance."""
    both = base.select(key, depth, F.col(value).alias("b")).join(other.select(key, F.col(value).alias("o")), key).where("o <> 0")
    return bucketed(both.withColumn("ratio", F.col("b") / F.col("o")), depth, "ratio", step)


def distribution(results: DataFrame, value: str) -> DataFrame:
    """(value, freq, probability); the total is one aggregated row, not a window over all rows."""
    freq = results.groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("freq"))
    total = results.count()
    return freq.withColumn("probability", F.col("freq") / F.lit(total))


def sigma_coverage(results: DataFrame, value: str) -> DataFrame:
    """One row: the shares of values within one, two and three standard deviations of the mean."""
    m = results.agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s")).first()
    far = F.abs(F.col(value) - F.lit(m["m"]))
    return results.agg(*(F.avg(F.when(far <= F.lit(k * (m["s"] or 0.0)), 1.0).otherwise(0.0)).alias(f"within_{k}") for k in (1, 2, 3)))


def statistics(stats: DataFrame) -> DataFrame:
    """(category, owner, total, most, n, mean, sd) of stats(category, owner, value); sd over the whole population."""
    return stats.groupBy("category", "owner").agg(
        F.sum("value").alias("total"), F.max("value").alias("most"), F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd")
    )


def chosen(stats: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    out = stats if include is None else stats.where(F.col("category").isin(include))
    return out if exclude is None else out.where(~F.col("category").isin(exclude))


def category_ratio(stats: DataFrame, over: str, under: str) -> DataFrame:
    """(owner, ratio): mean of one category over the mean of another."""
    mean = lambda c: F.avg(F.when(F.col("category") == c, F.col("value")))
    return stats.where(F.col("category").isin(over, under)).groupBy("owner").agg((mean(over) / mean(under)).alias("ratio")).where("ratio is not null")


def last_values(stats: DataFrame) -> DataFrame:
    """(category, owner, value) of the last entry by seq."""
    return stats.groupBy("category", "owner").agg(F.max_by("value", "seq").alias("value"))


def with_neighbours(stats: DataFrame) -> DataFrame:
    """stats with the values before and after of the same category and owner."""
    w = Window.partitionBy("category", "owner").orderBy("seq")
    return stats.select("*", F.lag("value").over(w).alias("before"), F.lead("value").over(w).alias("after"))


def accumulated(stats: DataFrame) -> DataFrame:
    """stats with the running total of the same category and owner."""
    w = Window.partitionBy("category", "owner").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return stats.select("*", F.sum("value").over(w).alias("running"))


def stats_table(stats: DataFrame, categories: list[str]) -> DataFrame:
    """One row per owner, one column per named category, of summed values."""
    return stats.groupBy("owner").agg(*(F.sum(F.when(F.col("category") == c, F.col("value"))).alias(c) for c in categories))


def differences(a: DataFrame, b: DataFrame, key: str, value: str, eps: float = 1e-8) -> DataFrame:
    """(key, a, b) where two result tables differ by more than ``eps`` or one lacks the key."""
    both = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key, "full")
    return both.where(F.col("a").isNull() | F.col("b").isNull() | (F.abs(F.col("a") - F.col("b")) > eps))


def with_provenance(parts: dict[str, DataFrame]) -> DataFrame:
    """Union of result tables by name, with the column ``file`` telling whence a row came."""
    out = None
    for name, part in parts.items():
        named = part.withColumn("file", F.lit(name))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out


def share(value: Column, partition: list[str]) -> Column:
    return value / F.sum(value).over(Window.partitionBy(*partition))

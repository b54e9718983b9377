"""Complete key x hour grids, their measures, and the keys that make up a share of the volume."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import running_totals


def hourly_counts(accepted: DataFrame, key: str = "key", hour: str = "hour_utc") -> DataFrame:
    """key, target_utc, n."""
    return accepted.groupBy(F.col(key).alias("key"), F.col(hour).alias("target_utc")).agg(F.count("*").alias("n"))


def demand_grid(counts: DataFrame, keys: DataFrame, axis: DataFrame) -> DataFrame:
    """key, target_utc, available, demand for every key and hour.

    An hour without records is 0; an unavailable hour is null, not 0. ``axis`` (target_utc, available) has one row
    for each hour of the panel, so it is the side that is broadcast.
    """
    grid = keys.select("key").distinct().crossJoin(F.broadcast(axis.select("target_utc", "available")))
    joined = grid.join(counts, ["key", "target_utc"], "left")
    return joined.select("key", "target_utc", "available", F.when(F.col("available"), F.coalesce("n", F.lit(0).cast("long"))).alias("demand"))


def grid_metrics(grid: DataFrame) -> DataFrame:
    return grid.agg(F.count("*").alias("n_rows"), F.count_if(F.col("demand") == 0).alias("n_zero"), F.count_if(~F.col("available")).alias("n_unavailable"), F.countDistinct("key").alias("n_keys"), F.countDistinct("target_utc").alias("n_hours"))


def active_hours(grid: DataFrame) -> DataFrame:
    """key, hours with demand, available hours, and their rate."""
    per = grid.groupBy("key").agg(F.count_if(F.col("demand") > 0).alias("n_active"), F.count_if("available").alias("n_available"))
    return per.withColumn("active_rate", F.try_divide(F.col("n_active"), F.col("n_available")))


def ranked_shares(totals: DataFrame, key: str = "key", n: str = "n") -> DataFrame:
    """Keys by descending volume, ties by key, with rank, cumulative volume and total; no task holds all keys."""
    return running_totals(totals, [F.desc(n), F.asc(key)], n)


def covering_keys(totals: DataFrame, percent: int, key: str = "key", n: str = "n") -> DataFrame:
    """The fewest keys that reach ``percent`` of the volume, with the key that crosses it. Compared in integers."""
    shares = ranked_shares(totals, key, n)
    return shares.filter((F.col("cumulative") - F.col(n)) * 100 < F.col("total") * percent)


def coverage_sets(totals: DataFrame, percents: tuple[int, ...], key: str = "key", n: str = "n", rate: str | None = None) -> DataFrame:
    """For each percent: number of keys, the volume they reach, and the lowest ``rate`` among them. One pass."""
    shares = ranked_shares(totals, key, n).withColumn("percent", F.explode(F.array(*map(F.lit, percents))))
    inside = shares.filter((F.col("cumulative") - F.col(n)) * 100 < F.col("total") * F.col("percent"))
    lowest = [F.min(rate).alias("lowest_rate")] if rate else []
    return inside.groupBy("percent").agg(F.count("*").alias("n_keys"), F.max("cumulative").alias("covered"), F.max("total").alias("total"), *lowest)

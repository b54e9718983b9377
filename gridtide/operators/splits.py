"""Chronological splits, the paired population, and what is left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import to_local, wall_time
from ..spec import PanelSpec


def assign_split(df: DataFrame, spec: PanelSpec, instant: str = "target_utc") -> DataFrame:
    """Adds split by half-open ranges of local time; null outside all."""
    local, split = to_local(F.col(instant), spec.tz), None
    for name, start, end in spec.splits:
        bounds = [wall_time(x) for x in (start, end)]
        inside = (local >= bounds[0]) & (local < bounds[1])
        split = F.when(inside, name) if split is None else split.when(inside, name)
    return df.withColumn("split", F.lit(None).cast("string") if split is None else split)


def paired_population(features: DataFrame) -> DataFrame:
    """Rows on which feature sets with and without forecasts can be compared."""
    return features.filter("paired")


def exclusions(features: DataFrame) -> DataFrame:
    """Per split and horizon: rows, paired rows, and reasons for leaving out, each alone and exclusively."""
    history, forecast = ~F.col("history_complete"), ~F.col("forecast_complete")
    return features.groupBy("split", "horizon_hours").agg(
        F.count("*").alias("n_rows"), F.count_if("paired").alias("n_paired"), F.count_if(history).alias("n_history"), F.count_if(forecast).alias("n_forecast"),
        F.count_if(history & ~forecast).alias("n_only_history"), F.count_if(forecast & ~history).alias("n_only_forecast"), F.count_if(history & forecast).alias("n_both"),
    )


def split_overlap(features: DataFrame) -> DataFrame:
    """Hours that fall in more than one split, by pair of splits; a row for each pair."""
    names = F.sort_array(F.collect_set("split"))
    per = features.filter(F.col("split").isNotNull()).groupBy("target_utc").agg(names.alias("s"))
    pairs = F.flatten(F.transform("s", lambda a, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    overlapping = per.filter(F.size("s") > 1).select(F.explode(pairs).alias("p")).select("p.a", "p.b").groupBy("a", "b").agg(F.count("*").alias("n"))
    known = features.filter(F.col("split").isNotNull()).select("split").distinct()
    every = known.select(F.col("split").alias("a")).join(known.select(F.col("split").alias("b")), F.col("a") < F.col("b"))
    return every.join(overlapping, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0).cast("long")).alias("n_shared"))


def shared_hours(features: DataFrame) -> DataFrame:
    """Hours that fall in more than one split."""
    return features.filter(F.col("split").isNotNull()).groupBy("target_utc").agg(F.countDistinct("split").alias("n")).filter("n > 1")


def split_ranges(features: DataFrame) -> DataFrame:
    """First and last hour and rows of each split, and whether it ends before the next begins."""
    per = features.filter(F.col("split").isNotNull()).groupBy("split").agg(F.min("target_utc").alias("first_utc"), F.max("target_utc").alias("last_utc"), F.count("*").alias("n_rows"))
    after = F.lead("first_utc").over(Window.orderBy("first_utc"))
    return per.withColumn("in_order", F.coalesce(F.col("last_utc") < after, F.lit(True)))


def definition_mismatches(features: DataFrame) -> DataFrame:
    """By horizon: rows, and rows whose paired flag isn't what history and forecasts say."""
    formula = F.col("history_complete") & ~F.coalesce("any_missing", F.lit(True))
    return features.groupBy("horizon_hours").agg(F.count("*").alias("n_rows"), F.count_if(~F.col("paired").eqNullSafe(formula)).alias("n_mismatch"))


def forbidden_periods(features: DataFrame, spec: PanelSpec) -> DataFrame:
    """By split: rows, rows of the first split after its end, and rows of the last one before its start."""
    local, (first, _, end), (last, start, _) = to_local(F.col("target_utc"), spec.tz), spec.splits[0], spec.splits[-1]
    return features.groupBy("split").agg(F.count("*").alias("n_rows"), F.count_if((F.col("split") == first) & (local >= wall_time(end))).alias(f"n_late_{first}"), F.count_if((F.col("split") == last) & (local < wall_time(start))).alias(f"n_early_{last}"))

"""Profiles of raw records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import running_totals
from .quality import null_counts


def profile_nulls(df: DataFrame) -> DataFrame:
    return null_counts(df, df.columns)


def profile_time(df: DataFrame, columns: list[str], start: Column, end: Column) -> DataFrame:
    """Per time column: first, last, and rows outside [start, end)."""
    figures = df.agg(*[f.alias(f"{c}_{name}") for c in columns for name, f in (("first", F.min(c)), ("last", F.max(c)), ("out", F.count_if((F.col(c) < start) | (F.col(c) >= end))))])
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"{c}_first").alias("first"), F.col(f"{c}_last").alias("last"), F.col(f"{c}_out").alias("n_outside")) for c in columns]
    return figures.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def profile_keys(df: DataFrame, key: str, lookup: DataFrame) -> DataFrame:
    """Each value with count, percent of all rows, rank by (-count, value), and whether the lookup knows it; no task holds all values."""
    counts = df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))
    ranked = running_totals(counts, [F.desc("n"), F.asc_nulls_first("key")], "n").select("key", "n", (F.col("n") * 100.0 / F.col("total")).alias("percent"), "rank")
    known = lookup.select(F.col("key").alias("__key")).distinct()
    return ranked.join(known, F.col("key") == F.col("__key"), "left").select("key", "n", "percent", "rank", F.col("__key").isNotNull().alias("known"))


def screen(df: DataFrame, measures: dict[str, tuple[str, float]]) -> DataFrame:
    """Per measure (a SQL expression and a limit): zero, negative and over-limit rows, least and most; one aggregate."""
    figures = df.agg(*[f.alias(f"{name}_{k}") for name, (e, limit) in measures.items() for k, f in (("zero", F.count_if(F.expr(f"({e}) = 0"))), ("negative", F.count_if(F.expr(f"({e}) < 0"))), ("over", F.count_if(F.expr(f"({e}) > {limit}"))), ("least", F.min(F.expr(e)).cast("double")), ("most", F.max(F.expr(e)).cast("double")))])
    rows = [F.struct(F.lit(name).alias("measure"), *[F.col(f"{name}_{k}").alias(a) for k, a in (("zero", "n_zero"), ("negative", "n_negative"), ("over", "n_over"), ("least", "least"), ("most", "most"))]) for name in measures]
    return figures.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def sparsity(df: DataFrame, key: str, time: str, lookup: DataFrame) -> DataFrame:
    """Per key of the lookup: records, active hours, and their share of the hours that any key is active in."""
    hours = df.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).alias("key"), F.date_trunc("hour", time).alias("hour"))
    counts = hours.groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("hour").alias("n_hours"))
    total = hours.agg(F.countDistinct("hour").alias("all_hours"))
    joined = lookup.join(counts, "key", "left").join(F.broadcast(total), F.lit(True))
    return joined.select("key", "zone", "area", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("n_hours", F.lit(0).cast("long")).alias("n_hours"), F.try_divide(F.coalesce("n_hours", F.lit(0).cast("long")), F.col("all_hours")).alias("active_rate"))


def lookup_profile(lookup: DataFrame) -> DataFrame:
    return lookup.groupBy("area").agg(F.count("*").alias("n_keys"))

"""Audits and gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import FeatureContract


class GateError(ValueError):
    """A gate found violations."""


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n_null; all columns in one aggregate."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_null")) for c in columns])).alias("x")).select("x.*")


def leakage_audit(features: DataFrame) -> DataFrame:
    """Rows whose sources lie after the cutoff, by source; trailing windows have to end at the cutoff. One aggregate."""
    cutoff = F.col("cutoff_utc")
    checks = {c: F.col(c) > cutoff for c in ("demand_at_cutoff_source", "demand_1h_source", "demand_2h_source", "demand_day_source", "demand_week_source")}
    checks["mean_24h_end"] = F.col("mean_24h_end") != cutoff
    counts = features.agg(*[F.count_if(v).alias(c) for c, v in checks.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("source"), F.col(c).alias("n_late")) for c in checks])).alias("x")).select("x.*")


def eligibility_accounting(panel: DataFrame) -> DataFrame:
    """All rows, rows with an available target, and the rest, by horizon."""
    return panel.groupBy("horizon_hours").agg(F.count("*").alias("n_rows"), F.count_if("available").alias("n_eligible"), F.count_if(~F.col("available")).alias("n_unavailable"))


def keyed_counts(df: DataFrame) -> DataFrame:
    """Rows by horizon, by month, by key, and by horizon and month: one grouping-sets aggregate."""
    h, m, k = F.col("horizon_hours"), F.col("local_month"), F.col("key")
    return df.groupingSets([[h], [m], [k], [h, m]], h, m, k).agg(F.count("*").alias("n"), F.grouping_id().alias("grouping"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, with multiplicity."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def wrong_cardinality(grid: DataFrame, joined: DataFrame, horizons: int) -> DataFrame:
    """One row unless joined has exactly one matched row for each grid row and horizon."""
    sides = grid.select(F.lit(horizons).alias("wanted"), F.lit(0).alias("found"), F.lit(0).alias("unmatched")).unionByName(
        joined.select(F.lit(0).alias("wanted"), F.lit(1).alias("found"), F.col("source_available").isNull().cast("int").alias("unmatched")))
    return sides.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("wanted", "found", "unmatched")]).filter("wanted <> found OR unmatched > 0")


def unequal_counts(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Groups of which the two sides don't hold the same number of rows."""
    signed = a.select(*by, F.lit(1).alias("n")).unionByName(b.select(*by, F.lit(-1).alias("n")))
    return signed.groupBy(*by).agg(F.sum("n").alias("n")).filter("n <> 0")


def unequal_slots(completed: DataFrame, slots: DataFrame, variables: tuple[str, ...]) -> DataFrame:
    """Variables whose detailed missing slots don't add up to the missing flags."""
    flags = completed.select(F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(f"{v}_missing").alias("missing")) for v in variables])).alias("v")).filter("v.missing")
    return unequal_counts(flags.select("v.variable"), slots, ["variable"])


def _listed(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(x,) for x in names], "column string")


def contract_difference(spark: SparkSession, a: FeatureContract, b: FeatureContract, wanted: tuple[str, ...]) -> DataFrame:
    """Columns by which b minus a differs from the wanted ones, and columns of a that b lacks."""
    wrong = (set(b.columns) - set(a.columns)) ^ set(wanted) | (set(a.columns) - set(b.columns))
    return _listed(spark, sorted(wrong))


def label_difference(spark: SparkSession, a: dict[str, list[str]], b: dict[str, list[str]]) -> DataFrame:
    """column, position, value: labels of two fitted indexers that the other doesn't give that place. A label for each category value."""
    sides = [{(c, k, v) for c, labels in x.items() for k, v in enumerate(labels)} for x in (a, b)]
    return spark.createDataFrame(sorted(sides[0] ^ sides[1]), "column string, position int, value string")


def invalid_predictions(predicted: DataFrame) -> DataFrame:
    return predicted.filter("actual IS NULL OR prediction IS NULL OR isnan(prediction) OR prediction < 0")


def target_among_features(spark: SparkSession, *contracts: FeatureContract) -> DataFrame:
    return _listed(spark, [c.name for c in contracts if c.target in c.columns])


def empty_populations(rows: DataFrame, names: list[str], horizons: tuple[int, ...]) -> DataFrame:
    """Pairs of split and horizon without a row."""
    wanted = rows.sparkSession.createDataFrame([(s, h) for s in names for h in horizons], "split string, horizon_hours int")
    return wanted.join(rows.select("split", "horizon_hours").distinct(), ["split", "horizon_hours"], "left_anti")


def gates(checks: dict[str, DataFrame]) -> DataFrame:
    """gate, n_violations for each named frame of violations. Nothing is raised here."""
    rows = [df.agg(F.count("*").alias("n_violations")).select(F.lit(name).alias("gate"), "n_violations") for name, df in checks.items()]
    return reduce(DataFrame.unionByName, rows)


def enforce(results: DataFrame) -> None:
    """Raise if any gate has violations; for the edge of a job."""
    failed = results.filter("n_violations > 0").collect()
    if failed:
        raise GateError(", ".join(f"{x.gate}: {x.n_violations}" for x in failed))

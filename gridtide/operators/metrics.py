"""Baselines, errors, selection and comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Baseline, its prediction, and the time it was known.
BASELINES = (("persistence", "demand_at_cutoff", "demand_at_cutoff_source"), ("day_before", "demand_day_before", "demand_day_source"), ("week_before", "demand_week_before", "demand_week_source"))


def baselines_long(features: DataFrame) -> DataFrame:
    """One row for each feature row and baseline, from one scan."""
    entries = F.array(*[F.struct(F.lit(name).alias("baseline"), F.col(value).cast("double").alias("prediction"), F.col(source).alias("source_utc")) for name, value, source in BASELINES])
    keys = [c for c in ("key", "target_utc", "horizon_hours", "cutoff_utc", "split") if c in features.columns]
    return features.select(*keys, F.col("demand").cast("double").alias("actual"), F.explode(entries).alias("b")).select(*keys, "actual", "b.*")


def errors(actual: str = "actual", prediction: str = "prediction") -> list:
    gap = F.col(actual) - F.col(prediction)
    return [F.count("*").alias("n_rows"), F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse")]


def baseline_metrics(long: DataFrame) -> DataFrame:
    """MAE and RMSE by split and baseline, for each horizon and over all (horizon null), in one grouping-sets aggregate."""
    split, baseline, horizon = F.col("split"), F.col("baseline"), F.col("horizon_hours")
    return long.groupingSets([[split, baseline, horizon], [split, baseline]], split, baseline, horizon).agg(*errors())


def baseline_audit(long: DataFrame) -> DataFrame:
    """Per baseline: rows, null predictions, and sources after the cutoff."""
    return long.groupBy("baseline").agg(F.count("*").alias("n_rows"), F.count_if(F.col("prediction").isNull()).alias("n_null"), F.count_if(F.col("source_utc") > F.col("cutoff_utc")).alias("n_late"))


def key_mae_summary(long: DataFrame) -> DataFrame:
    """Per split and baseline: spread of the keys' own MAE."""
    per = long.groupBy("split", "baseline", "key").agg(F.avg(F.abs(F.col("actual") - F.col("prediction"))).alias("mae"))
    at = [F.expr(f"percentile_approx(mae, {p}, 10000)").alias(name) for p, name in ((0.25, "p25"), (0.5, "median"), (0.75, "p75"))]
    return per.groupBy("split", "baseline").agg(F.count("*").alias("n_keys"), F.avg("mae").alias("mean"), F.min("mae").alias("least"), *at, F.max("mae").alias("most"))


def select_best(metrics: DataFrame, by: list[str], criteria: list[str]) -> DataFrame:
    """The first row by the criteria in each group."""
    best = F.row_number().over(Window.partitionBy(*by).orderBy(*criteria))
    return metrics.withColumn("__n", best).filter("__n = 1").drop("__n")


def clip(df: DataFrame, raw: str = "raw_prediction") -> DataFrame:
    """Adds prediction: the raw one, 0 at least. A null stays null."""
    return df.withColumn("prediction", F.when(F.col(raw).isNotNull(), F.greatest(F.col(raw), F.lit(0.0))))


def prediction_metrics(df: DataFrame, by: list[str], actual: str = "actual", raw: str = "raw_prediction") -> DataFrame:
    """Per group: rows, negative and invalid raw predictions, MAE and RMSE of the clipped ones."""
    clipped = clip(df, raw)
    invalid = F.col(raw).isNull() | F.isnan(raw)
    return clipped.groupBy(*by).agg(F.count_if(F.col(raw) < 0).alias("n_negative"), F.count_if(invalid).alias("n_invalid"), *errors(actual))


def ab_deltas(metrics: DataFrame, by: list[str]) -> DataFrame:
    """B minus A of mae and rmse, from rows with feature_set A and B; one pivoting aggregate."""
    sides = [F.max(F.when(F.col("feature_set") == s, F.col(m))).alias(f"{m}_{s.lower()}") for s in ("A", "B") for m in ("mae", "rmse")]
    return metrics.groupBy(*by).agg(*sides).withColumns({"mae_delta": F.col("mae_b") - F.col("mae_a"), "rmse_delta": F.col("rmse_b") - F.col("rmse_a")})


def baseline_improvement(model: DataFrame, baseline: DataFrame, by: list[str]) -> DataFrame:
    """Model rows with the baseline's MAE of the same group, and how much lower the model's is, absolute and in percent."""
    other = baseline.select(*by, F.col("mae").alias("baseline_mae"))
    lower = F.col("baseline_mae") - F.col("mae")
    return model.join(other, by).withColumns({"improvement": lower, "improvement_percent": F.try_divide(lower * 100, F.col("baseline_mae"))})


def numbered(report: DataFrame, by: list[str]) -> DataFrame:
    """A report's rows in order, with their line; for reports, which are a few rows however large the data."""
    return report.withColumn("line", F.row_number().over(Window.orderBy(*by))).orderBy("line")

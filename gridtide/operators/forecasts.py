"""Forecast runs: parsing, planning under a publication lag, completion without imputation, coverage."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import epoch, floor_cycle, shift_hours
from ..spec import PanelSpec

VARIABLES = ("forecast_value", "forecast_k")


def parse_runs(runs: DataFrame, variables: tuple[str, ...] = VARIABLES) -> DataFrame:
    """run_utc, point, hourly{time, one array for each variable} to one row for each hour. Short arrays end in nulls."""
    zipped = F.arrays_zip(F.col("hourly.time").alias("time"), *[F.col(f"hourly.{v}").alias(v) for v in variables])
    rows = runs.select("run_utc", "point", F.explode(zipped).alias("h"))
    return rows.select("run_utc", "point", F.col("h.time").alias("target_utc"), *[F.col(f"h.{v}").alias(v) for v in variables])


def forecast_plan(axis: DataFrame, spec: PanelSpec) -> DataFrame:
    """For each hour and horizon: the cutoff, and the newest run that is published by then.

    A closed formula, not a search: if that run is unavailable, its slot stays missing.
    """
    planned = axis.select("target_utc", F.explode(F.array(*map(F.lit, spec.horizons))).alias("horizon_hours"))
    cutoff = shift_hours(F.col("target_utc"), -F.col("horizon_hours"))
    with_cutoff = planned.withColumn("cutoff_utc", cutoff)
    return with_cutoff.withColumn("run_utc", floor_cycle(shift_hours(F.col("cutoff_utc"), -spec.lag_hours), spec.cycle_hours))


def complete_forecasts(expected: DataFrame, observed: DataFrame, variables: tuple[str, ...] = VARIABLES) -> DataFrame:
    """expected (run_utc, target_utc, horizon_hours, point, ...) with the variables, a missing flag for each, and
    source_available and any_missing. Nothing is filled in."""
    keys = ["run_utc", "target_utc", "point"]
    seen = observed.select(*keys, *variables, F.lit(True).alias("__seen"))
    joined = expected.join(seen, keys, "left")
    flags = {f"{v}_missing": F.col(v).isNull() for v in variables}
    available = F.coalesce("__seen", F.lit(False))
    return joined.withColumns(flags | {"source_available": available, "any_missing": reduce(or_, flags.values())}).drop("__seen")


def leaks(spec: PanelSpec):
    """True where a run was not published by the cutoff."""
    return epoch(F.col("run_utc")) + spec.lag_hours * 3600 > epoch(F.col("target_utc")) - F.col("horizon_hours") * 3600


def forecast_metrics(completed: DataFrame, spec: PanelSpec) -> DataFrame:
    return completed.agg(F.count("*").alias("n_rows"), F.count_if("any_missing").alias("n_any_missing"), F.count_if(~F.col("source_available")).alias("n_unavailable"), F.count_if(leaks(spec)).alias("n_leaks"))


def missing_slots(completed: DataFrame, variables: tuple[str, ...] = VARIABLES) -> DataFrame:
    """One row for each required slot without a value: where, which variable, and why."""
    long = completed.select("run_utc", "target_utc", "horizon_hours", "point", "source_available", F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value")) for v in variables])).alias("v"))
    reason = F.when(F.col("source_available"), "null_in_response").otherwise("run_unavailable")
    return long.filter(F.col("v.value").isNull()).select("run_utc", "target_utc", "horizon_hours", "point", F.col("v.variable").alias("variable"), reason.alias("reason"))


def missing_by_dimension(slots: DataFrame) -> DataFrame:
    """Counts by run, by target hour, by horizon, by point, by variable, by reason, and in all: one grouping-sets aggregate."""
    dims = [F.col(c) for c in ("run_utc", "target_utc", "horizon_hours", "point", "variable", "reason")]
    sets = slots.groupingSets([[d] for d in dims] + [[]], *dims)
    return sets.agg(F.count("*").alias("n"))


def join_panel(grid: DataFrame, key_points: DataFrame, forecasts: DataFrame, plan: DataFrame) -> DataFrame:
    """One row for each key, hour and horizon, with its point's forecast.

    It starts from the plan, so no row can lack a horizon.
    """
    slots = plan.select("target_utc", "horizon_hours", "cutoff_utc").distinct()
    with_point = grid.join(key_points.select("key", "point"), "key")
    planned = with_point.join(slots, "target_utc")
    measures = [c for c in forecasts.columns if c not in ("target_utc", "horizon_hours", "point", "cutoff_utc")]
    return planned.join(forecasts.select("target_utc", "horizon_hours", "point", *measures), ["target_utc", "horizon_hours", "point"], "left")


def spatial_spread(values: DataFrame, threshold: float) -> DataFrame:
    """Across points in each hour: mean, 95th percentile and maximum of the range, hours at or over the threshold, and
    hours in which points disagree on being positive."""
    per = values.groupBy("target_utc").agg((F.max("value") - F.min("value")).alias("spread"), F.bool_or(F.col("value") > 0).alias("some"), F.bool_and(F.col("value") > 0).alias("all"))
    return per.agg(F.count("*").alias("n_hours"), F.avg("spread").alias("mean_range"), F.expr("percentile_approx(spread, 0.95, 10000)").alias("p95_range"), F.max("spread").alias("max_range"), F.count_if(F.col("spread") >= threshold).alias("n_over"), F.count_if(F.col("some") & ~F.col("all")).alias("n_disagree"))


def forecast_profile(runs: DataFrame, variables: tuple[str, ...] = VARIABLES, sentinel: float = -999.0) -> DataFrame:
    """Per point: hours, first and last hour, and nulls of each variable; the sentinel counts as null."""
    rows = parse_runs(runs, variables)
    nulls = [F.count_if(F.col(v).isNull() | (F.col(v) == sentinel)).alias(f"{v}_nulls") for v in variables]
    return rows.groupBy("point").agg(F.count("*").alias("n_hours"), F.min("target_utc").alias("first_utc"), F.max("target_utc").alias("last_utc"), *nulls)

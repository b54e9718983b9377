"""Hour axes and calendar fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import is_fold, to_local, to_utc, wall_time
from ..spec import PanelSpec


def hours_between(bounds: DataFrame, start: str, end: str, name: str = "target_utc") -> DataFrame:
    """Each hour from start up to end, which is left out, for each row of bounds."""
    last = F.col(end) - F.expr("INTERVAL 1 HOUR")
    steps = F.when(F.col(start) <= last, F.sequence(F.col(start), last, F.expr("INTERVAL 1 HOUR"))).otherwise(F.array().cast("array<timestamp>"))
    return bounds.select(F.explode(steps).alias(name))


def hour_axis(spark: SparkSession, spec: PanelSpec) -> DataFrame:
    """target_utc: every instant of the panel's local window, on the hour; days of 23 and 25 hours come out right."""
    at = [to_utc(wall_time(x), spec.tz) for x in (spec.start, spec.end)]
    return hours_between(spark.range(1).select(at[0].alias("a"), at[1].alias("b")), "a", "b")


def with_availability(axis: DataFrame, tz: str) -> DataFrame:
    """Adds available: false for hours whose wall-clock hour occurs twice, as records can't be told apart there."""
    return axis.withColumn("available", ~is_fold(to_local(F.col("target_utc"), tz), tz))


def with_calendar(df: DataFrame, tz: str, instant: str = "target_utc") -> DataFrame:
    """Adds hour, weekday (1 is Sunday), weekend and month of the local time."""
    local = to_local(F.col(instant), tz)
    return df.withColumns({"local_hour": F.hour(local), "local_weekday": F.dayofweek(local), "local_weekend": F.dayofweek(local).isin(1, 7), "local_month": F.month(local)})

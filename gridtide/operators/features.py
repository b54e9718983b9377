"""Features that use only what is known at the cutoff.

Windows are ranges of seconds, not rows, so a missing hour gives a null, never the value of another hour.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import epoch, shift_hours, to_local
from ..spec import CALENDAR_COLUMNS, HISTORY_COLUMNS, PanelSpec
from .timeaxis import with_calendar

HOUR = 3600


def history_at_cutoff(grid: DataFrame) -> DataFrame:
    """For each key and cutoff: demand then, one and two hours before, trailing means and deviation, and their source times.

    A trailing figure needs all its hours. One sort by key and time serves all windows.
    """
    at = grid.withColumn("__s", epoch(F.col("target_utc")))
    by_key = Window.partitionBy("key").orderBy("__s")

    def back(hours: int):
        return F.first("demand").over(by_key.rangeBetween(-hours * HOUR, -hours * HOUR))

    def trailing(hours: int, f):
        frame = by_key.rangeBetween(-(hours - 1) * HOUR, 0)
        return F.when(F.count("demand").over(frame) == hours, f("demand").over(frame))

    def source(value: str, hours: int):
        return F.when(F.col(value).isNotNull(), shift_hours(F.col("cutoff_utc"), -hours))

    figures = at.select(
        "key", F.col("target_utc").alias("cutoff_utc"), F.col("demand").alias("demand_at_cutoff"), back(1).alias("demand_1h_before"), back(2).alias("demand_2h_before"),
        trailing(3, F.avg).alias("mean_3h"), trailing(6, F.avg).alias("mean_6h"), trailing(24, F.avg).alias("mean_24h"), trailing(24, F.stddev_pop).alias("std_24h"),
    )
    return figures.withColumns({
        "demand_at_cutoff_source": source("demand_at_cutoff", 0), "demand_1h_source": source("demand_1h_before", 1), "demand_2h_source": source("demand_2h_before", 2),
        "mean_3h_start": source("mean_3h", 2), "mean_6h_start": source("mean_6h", 5), "mean_24h_start": source("mean_24h", 23), "mean_24h_end": source("mean_24h", 0),
    })


def local_hours(grid: DataFrame, tz: str) -> DataFrame:
    """key, local_hour_time, demand and source_utc for local hours that one available instant shows; others give null."""
    local = grid.withColumn("local_hour_time", to_local(F.col("target_utc"), tz))
    per = local.groupBy("key", "local_hour_time").agg(F.count("*").alias("n_instants"), F.count_if("available").alias("n_available"), F.sum("demand").alias("__demand"), F.max("target_utc").alias("__source"))
    single = (F.col("n_instants") == 1) & (F.col("n_available") == 1)
    return per.select("key", "local_hour_time", "n_instants", "n_available", F.when(single, F.col("__demand")).alias("demand"), F.when(single, F.col("__source")).alias("source_utc"))


LAGS = ("demand_day_before", "demand_day_source", "demand_week_before", "demand_week_source")


def _lagged(hours: DataFrame) -> DataFrame:
    """hours (key, __local, __source, demand, available) with the lags: values of the one available hour that shows the local time a day or a week before."""
    by_key = Window.partitionBy("key").orderBy("__local")
    for name, days in (("day", 1), ("week", 7)):
        at = by_key.rangeBetween(-days * 24 * HOUR, -days * 24 * HOUR)
        single = (F.count("__source").over(at) == 1) & (F.count(F.when(F.col("available"), 1)).over(at) == 1)
        hours = hours.withColumns({f"demand_{name}_before": F.when(single, F.max("demand").over(at)), f"demand_{name}_source": F.when(single, F.max("__source").over(at))})
    return hours


def seasonal_lags(grid: DataFrame, tz: str) -> DataFrame:
    """key, target_utc and the lags of every hour of the grid."""
    return _lagged(grid.withColumns({"__local": epoch(to_local(F.col("target_utc"), tz)), "__source": F.col("target_utc")})).select("key", "target_utc", *LAGS)


def with_seasonal_lags(rows: DataFrame, grid: DataFrame, tz: str) -> DataFrame:
    """Adds demand at the same local hour a day and a week before, and its source time.

    Rows and grid stand in one window by key and local time, in which only the grid's hours are looked at, so there is one exchange and no join. Local times that no
    instant shows (a gap) or that two show (a fold) give null, and so does an unavailable hour. rows need not be hours of the grid.
    """
    held = F.struct(*[rows[c] for c in rows.columns])
    local = epoch(to_local(F.col("target_utc"), tz)).alias("__local")
    hours = grid.select("key", local, F.col("target_utc").alias("__source"), "demand", "available", F.lit(None).cast(rows.select(held.alias("r")).schema[0].dataType).alias("__row"))
    wanted = rows.select("key", local, F.lit(None).cast("timestamp").alias("__source"), F.lit(None).cast(grid.schema["demand"].dataType).alias("demand"), F.lit(None).cast("boolean").alias("available"), held.alias("__row"))
    return _lagged(hours.unionByName(wanted)).filter("__row IS NOT NULL").select("__row.*", *LAGS)


def build_features(panel: DataFrame, grid: DataFrame, spec: PanelSpec, stored: bool = False) -> DataFrame:
    """panel rows (key, target_utc, horizon_hours, cutoff_utc, demand, forecasts) with history, calendar and flags.

    ``stored`` says that both are tables bucketed by key alike (:func:`gridtide.sources.io.write_bucketed`), and that the panel's hours are those of the grid: then
    history and lags are windows over the grid's buckets that the panel's buckets are joined to, and nothing is exchanged.
    """
    joined = panel.join(history_at_cutoff(grid), ["key", "cutoff_utc"], "left")
    lagged = joined.join(seasonal_lags(grid, spec.tz), ["key", "target_utc"], "left") if stored else with_seasonal_lags(joined, grid, spec.tz)
    dated = with_calendar(lagged, spec.tz)
    history_complete = reduce(and_, [F.col(c).isNotNull() for c in HISTORY_COLUMNS])
    calendar_complete = reduce(and_, [F.col(c).isNotNull() for c in CALENDAR_COLUMNS])
    forecast_complete = ~F.coalesce(F.col("any_missing"), F.lit(True))
    return dated.withColumns({"history_complete": history_complete, "forecast_complete": forecast_complete, "paired": history_complete & calendar_complete & forecast_complete})

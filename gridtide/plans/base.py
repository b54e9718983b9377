"""The tables of the library's queries, built from events, nation, region, customer, orders and lineitem."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import epoch, floor_cycle, hour_of, shift_hours, wall_clock
from ..operators import classify, features, forecasts, geo, grid, splits, timeaxis
from ..spec import PanelSpec

TZ = "America/New_York"
SPEC = PanelSpec(
    tz=TZ, start=datetime(2024, 3, 2), end=datetime(2024, 3, 30),
    splits=(("train", datetime(2024, 3, 2), datetime(2024, 3, 20)), ("validation", datetime(2024, 3, 20), datetime(2024, 3, 25)), ("test", datetime(2024, 3, 25), datetime(2024, 3, 30))),
)
FOLD_SPEC = PanelSpec(tz=TZ, start=datetime(2024, 10, 29), end=datetime(2024, 11, 25))
#: Days added to events.ts, so that the data cover a spring gap or an autumn fold.
GAP_DAYS, FOLD_DAYS = 60, 300
AREAS = ("AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
#: Coordinates given to the five event types, which stand for forecast points.
POINTS = [("click", 40.7, -74.0), ("error", 51.5, -0.1), ("purchase", 35.7, 139.7), ("signup", -33.9, 151.2), ("view", -23.5, -46.6)]
RUN_HOURS = 24
COVERAGE = 95


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def naive(df: DataFrame) -> DataFrame:
    """Instants as timestamps without zone, for results."""
    instants = [c for c, kind in df.dtypes if kind == "timestamp"]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in instants}) if instants else df


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places and instants without zone, for results."""
    doubles = [c for c, kind in df.dtypes if kind == "double"]
    return naive(df.withColumns({c: F.round(c, 6) for c in doubles}) if doubles else df)


def records(spark: SparkSession, sf_dir: str, days: int = GAP_DAYS) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(
        "event_id", F.when(F.col("event_id") % 101 != 0, F.col("ts") + F.expr(f"INTERVAL {days} DAYS")).alias("local_time"),
        F.when(F.col("event_id") % 97 != 0, (F.col("user_id") % 27).cast("int")).alias("key"),
        F.col("event_type").alias("point"), "value", F.regexp_extract("props", "-?[0-9]+", 0).cast("double").alias("k"),
    )


def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("zone"), F.col("r_name").alias("area"))


def classified(spark: SparkSession, sf_dir: str, days: int = GAP_DAYS) -> DataFrame:
    spec = SPEC if days == GAP_DAYS else FOLD_SPEC
    return classify.classify_records(records(spark, sf_dir, days), lookup(spark, sf_dir), spec, areas=AREAS)


def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).filter(F.col("status") == classify.ACCEPTED)


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.hourly_counts(accepted(spark, sf_dir))


def axis(spark: SparkSession) -> DataFrame:
    return timeaxis.with_availability(timeaxis.hour_axis(spark, SPEC), TZ)


def panel_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup(spark, sf_dir).filter(F.col("area").isin(*AREAS))


def demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.demand_grid(counts(spark, sf_dir), panel_keys(spark, sf_dir), axis(spark))


def key_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = lookup(spark, sf_dir).select("key", ((F.col("key") * 7) % 120 - 60).cast("double").alias("lat"), ((F.col("key") * 29) % 360 - 180).cast("double").alias("lon"))
    return geo.nearest_point(places, POINTS)


def hourly_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """point, target_utc and mean figures of each hour, which stand for what a forecast run says."""
    shifted = table(spark, sf_dir, "events").select(F.col("event_type").alias("point"), hour_of(wall_clock(F.col("ts") + F.expr(f"INTERVAL {GAP_DAYS} DAYS"))).alias("target_utc"), "value", F.regexp_extract("props", "-?[0-9]+", 0).cast("double").alias("k"))
    return shifted.groupBy("point", "target_utc").agg(F.round(F.avg("value"), 6).alias("forecast_value"), F.round(F.avg("k"), 6).alias("forecast_k"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested forecast runs: run_utc, point, hourly{time, forecast_value, forecast_k}. Every eleventh run is dropped; some lack the end of an array."""
    hourly = hourly_values(spark, sf_dir)
    bounds = hourly.agg(shift_hours(floor_cycle(F.min("target_utc"), 6), -24).alias("a"), F.max("target_utc").alias("b"))
    starts = bounds.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 6 HOURS"))).alias("run_utc")).withColumn("n", (epoch(F.col("run_utc")) / 21600).cast("long")).filter("n % 11 <> 5")
    points = hourly.select("point").distinct()
    hours = starts.join(F.broadcast(points), F.lit(True)).withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(RUN_HOURS - 1)))).withColumn("target_utc", shift_hours(F.col("run_utc"), F.col("offset")))
    filled = hours.join(hourly, ["point", "target_utc"], "left")
    nested = filled.groupBy("run_utc", "n", "point").agg(F.sort_array(F.collect_list(F.struct("target_utc", "forecast_value", "forecast_k"))).alias("h"))
    kept = F.when(F.col("n") % 7 == 3, F.lit(20)).otherwise(F.lit(RUN_HOURS))
    return nested.select("run_utc", "point", F.struct(F.col("h.target_utc").alias("time"), F.col("h.forecast_value").alias("forecast_value"), F.slice(F.col("h.forecast_k"), F.lit(1), kept).alias("forecast_k")).alias("hourly"))


def plan(spark: SparkSession) -> DataFrame:
    return forecasts.forecast_plan(axis(spark).select("target_utc"), SPEC)


def completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "events").select(F.col("event_type").alias("point")).distinct()
    expected = plan(spark).join(F.broadcast(points), F.lit(True))
    return forecasts.complete_forecasts(expected, forecasts.parse_runs(runs(spark, sf_dir)))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecasts.join_panel(demand(spark, sf_dir), key_points(spark, sf_dir), completed(spark, sf_dir), plan(spark))


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    eligible = panel(spark, sf_dir).filter("available")
    return splits.assign_split(features.build_features(eligible, demand(spark, sf_dir), SPEC), SPEC)

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridtide.functions import time as t
from gridtide.operators import classify, features, forecasts, geo, grid, metrics, profiling, quality, splits, timeaxis
from gridtide.spec import CONTRACT_A, CONTRACT_B, FeatureContract, PanelSpec

NY = "America/New_York"
YEAR = PanelSpec(tz=NY, start=datetime(2025, 1, 1), end=datetime(2026, 1, 1), splits=(("train", datetime(2025, 1, 1), datetime(2025, 9, 1)), ("validation", datetime(2025, 9, 1), datetime(2025, 11, 1)), ("test", datetime(2025, 11, 1), datetime(2026, 1, 1))))


def at(*x):
    return datetime(*x)


def test_spec_rejects_what_would_leak():
    for horizons in ((), (0,), (24,)):
        with pytest.raises(ValueError):
            PanelSpec(tz=NY, start=at(2025, 1, 1), end=at(2026, 1, 1), horizons=horizons)
    with pytest.raises(ValueError):
        PanelSpec(tz=NY, start=at(2026, 1, 1), end=at(2025, 1, 1))
    with pytest.raises(ValueError):
        FeatureContract("x", ("demand",), ())
    assert set(CONTRACT_B.columns) - set(CONTRACT_A.columns) == {"forecast_value", "forecast_k"}


@pytest.mark.parametrize(("zone", "wall", "gap", "fold"), [
    (NY, "2025-03-09 01:59:00", False, False), (NY, "2025-03-09 02:30:00", True, False), (NY, "2025-03-09 03:00:00", False, False), (NY, "2025-11-02 01:30:00", False, True),
    (NY, "2025-11-02 02:00:00", False, False), ("Europe/Berlin", "2023-03-26 02:10:00", True, False), ("Europe/Berlin", "2023-10-29 02:10:00", False, True), ("UTC", "2025-03-09 02:30:00", False, False),
])
def test_gap_and_fold(spark, zone, wall, gap, fold):
    c = F.lit(wall).cast("timestamp")
    assert tuple(spark.range(1).select(t.is_gap(c, zone), t.is_fold(c, zone)).first()) == (gap, fold)


def test_axis_has_days_of_23_and_25_hours(spark):
    axis = timeaxis.with_availability(timeaxis.hour_axis(spark, YEAR), NY)
    assert axis.count() == 8760 and axis.filter("not available").count() == 2
    days = {x.d: x["count"] for x in axis.groupBy(F.to_date(t.to_local(F.col("target_utc"), NY)).cast("string").alias("d")).count().collect()}
    assert days["2025-03-09"] == 23 and days["2025-11-02"] == 25 and days["2025-06-01"] == 24


def test_first_rule_names_the_reason(spark):
    rows = [(1, at(2025, 1, 1)), (1, at(2025, 3, 9, 2, 30)), (1, at(2025, 11, 2, 1, 30)), (1, at(2024, 12, 31, 23, 59)), (1, at(2026, 1, 1)), (1, None), (None, at(2025, 2, 1)), (9, at(2025, 2, 1)), (2, at(2025, 2, 1)), (3, at(2025, 2, 1))]
    records = spark.createDataFrame(rows, "key int, local_time timestamp_ntz")
    lookup = spark.createDataFrame([(1, "z", "in"), (2, "y", "out"), (3, "x", None)], "key int, zone string, area string")
    got = classify.classify_records(records, lookup, YEAR, areas=("in",))
    reasons = sorted(x.reason for x in got.collect())
    assert reasons == sorted(["accepted", "quarantined_gap", "quarantined_fold", "rejected_outside_window", "rejected_outside_window", "rejected_missing_time", "rejected_missing_key", "rejected_unknown_key", "rejected_outside_area", "rejected_outside_area"])
    only = got.filter("time_utc is not null").collect()
    assert [(x.time_utc, x.hour_utc) for x in only] == [(at(2025, 1, 1, 5), at(2025, 1, 1, 5))]


def test_zero_is_not_unavailable(spark):
    axis = spark.createDataFrame([(at(2025, 11, 2, 4), True), (at(2025, 11, 2, 5), False), (at(2025, 11, 2, 6), False)], "target_utc timestamp, available boolean")
    counts = spark.createDataFrame([(1, at(2025, 11, 2, 4), 3)], "key int, target_utc timestamp, n long")
    rows = grid.demand_grid(counts, spark.createDataFrame([(1,), (2,), (2,)], "key int"), axis).collect()
    assert sorted((x.key, x.target_utc.hour, x.demand) for x in rows if x.demand is not None) == [(1, 4, 3), (2, 4, 0)] and len(rows) == 6
    m = grid.grid_metrics(grid.demand_grid(counts, spark.createDataFrame([(1,), (2,)], "key int"), axis)).first()
    assert (m.n_rows, m.n_zero, m.n_unavailable, m.n_keys, m.n_hours) == (6, 1, 4, 2, 3)


def test_covering_keys_hold_the_crossing_one(spark):
    totals = spark.createDataFrame([(1, 50), (2, 30), (3, 15), (4, 5)], "key int, n long")
    assert sorted(x.key for x in grid.covering_keys(totals, 80).collect()) == [1, 2]
    assert sorted(x.key for x in grid.covering_keys(totals, 81).collect()) == [1, 2, 3]
    ties = spark.createDataFrame([(2, 1), (1, 1)], "key int, n long")
    assert [x.key for x in grid.covering_keys(ties, 50).collect()] == [1]
    assert {x.percent: x.n_keys for x in grid.coverage_sets(totals, (90, 95, 99)).collect()} == {90: 3, 95: 3, 99: 4}


def history(spark, skip=()):
    rows = [(k, at(2025, 1, 1, 5) + timedelta(hours=h), True, 1000 * (k - 1) + h) for k in (1, 2) for h in range(200) if h not in skip]
    return spark.createDataFrame(rows, "key int, target_utc timestamp, available boolean, demand long")


def test_history_ends_at_the_cutoff(spark):
    cutoff = at(2025, 1, 1, 5) + timedelta(hours=195)
    row = features.history_at_cutoff(history(spark)).filter((F.col("key") == 1) & (F.col("cutoff_utc") == F.lit(cutoff))).first()
    assert (row.demand_at_cutoff, row.demand_1h_before, row.demand_2h_before, row.mean_3h, row.mean_6h, row.mean_24h) == (195, 194, 193, 194.0, 192.5, 183.5)
    assert row.std_24h == pytest.approx(47.9166667**0.5) and row.mean_24h_end == cutoff


def test_a_missing_hour_gives_null_not_its_neighbour(spark):
    cutoff = at(2025, 1, 1, 5) + timedelta(hours=195)
    row = features.history_at_cutoff(history(spark, skip=(194,))).filter((F.col("key") == 2) & (F.col("cutoff_utc") == F.lit(cutoff))).first()
    assert row.demand_1h_before is None and row.demand_2h_before == 1193 and row.mean_3h is None


def test_seasonal_lags_go_by_local_hour(spark):
    rows = [(1, at(2025, 3, 1) + timedelta(hours=h), True, h) for h in range(24 * 20)]
    g = spark.createDataFrame(rows, "key int, target_utc timestamp, available boolean, demand long")
    wanted = spark.createDataFrame([(1, at(2025, 3, 10, 5, 0)), (1, at(2025, 3, 10, 6, 0))], "key int, target_utc timestamp")  # 01:00 and 02:00 local, the day after the gap
    got = sorted((x.target_utc.hour, x.demand_day_before, x.demand_week_before) for x in features.with_seasonal_lags(wanted, g, NY).collect())
    assert got == [(5, 24 * 8 + 6, 24 * 2 + 6), (6, None, 24 * 2 + 7)]


def test_plan_uses_published_runs(spark):
    axis = timeaxis.hour_axis(spark, YEAR)
    plan = forecasts.forecast_plan(axis, YEAR)
    assert plan.count() == 8760 * 3 and plan.select("run_utc").distinct().count() == 1462
    assert plan.filter(forecasts.leaks(YEAR)).count() == 0
    lead = plan.select(((t.epoch(F.col("target_utc")) - t.epoch(F.col("run_utc"))) / 3600).alias("h")).agg(F.min("h"), F.max("h")).first()
    assert tuple(lead) == (7.0, 17.0)
    late = plan.limit(1).withColumn("run_utc", F.col("cutoff_utc") - F.expr("INTERVAL 5 HOURS"))
    assert late.filter(forecasts.leaks(YEAR)).count() == 1


def test_forecasts_are_not_filled_in(spark):
    expected = spark.createDataFrame([(at(2024, 12, 31, 18), at(2025, 1, 1, 5), p, 1, at(2025, 1, 1, 4)) for p in "ab"], "run_utc timestamp, target_utc timestamp, point string, horizon_hours int, cutoff_utc timestamp")
    seen = spark.createDataFrame([(at(2024, 12, 31, 18), at(2025, 1, 1, 5), "a", None, 2.0)], "run_utc timestamp, target_utc timestamp, point string, forecast_value double, forecast_k double")
    done = forecasts.complete_forecasts(expected, seen)
    got = {x.point: (x.source_available, x.any_missing, x.forecast_value_missing, x.forecast_k_missing, x.forecast_value) for x in done.collect()}
    assert got == {"a": (True, True, True, False, None), "b": (False, True, True, True, None)}
    slots = forecasts.missing_slots(done)
    assert sorted((x.point, x.variable, x.reason) for x in slots.collect()) == [("a", "forecast_value", "null_in_response"), ("b", "forecast_k", "run_unavailable"), ("b", "forecast_value", "run_unavailable")]
    by = forecasts.missing_by_dimension(slots)
    assert by.filter("horizon_hours is null and point is null and variable is null and reason is null").first().n == slots.count()


def test_short_arrays_end_in_nulls(spark):
    runs = spark.createDataFrame([(at(2025, 1, 1), "a", ([at(2025, 1, 1, 1), at(2025, 1, 1, 2)], [1.0], [3.0, 4.0]))], "run_utc timestamp, point string, hourly struct<time:array<timestamp>,forecast_value:array<double>,forecast_k:array<double>>")
    assert [(x.forecast_value, x.forecast_k) for x in forecasts.parse_runs(runs).orderBy("target_utc").collect()] == [(1.0, 3.0), (None, 4.0)]


def test_nearest_point_ties_go_to_the_first_name(spark):
    places = spark.createDataFrame([(0.0, 5.0), (None, 1.0)], "lat double, lon double")
    rows = geo.nearest_point(places, [("b", 0.0, 0.0), ("a", 0.0, 10.0), ("c", 50.0, 50.0)]).collect()
    assert rows[0].point == "a" and rows[0].distance_km == pytest.approx(555.97, abs=0.1) and rows[1].point is None


def test_split_edges(spark):
    edges = [at(2025, 9, 1, 3, 59), at(2025, 9, 1, 4), at(2025, 11, 1, 3, 59), at(2025, 11, 1, 4), at(2026, 1, 1, 4, 59), at(2026, 1, 1, 5)]
    df = spark.createDataFrame([(x,) for x in edges], "target_utc timestamp")
    assert [x.split for x in splits.assign_split(df, YEAR).orderBy("target_utc").collect()] == ["train", "validation", "validation", "test", "test", None]
    ranges = splits.split_ranges(splits.assign_split(df, YEAR))
    assert all(x.in_order for x in ranges.collect())
    assert {(x.a, x.b): x.n_shared for x in splits.split_overlap(splits.assign_split(df, YEAR)).collect()} == {("test", "train"): 0, ("test", "validation"): 0, ("train", "validation"): 0}


def test_clip_and_selection(spark):
    rows = spark.createDataFrame([("x", 2.0, -1.0), ("x", 4.0, 5.0), ("y", 1.0, None), ("y", 1.0, float("nan"))], "g string, actual double, raw_prediction double")
    got = {x.g: x for x in metrics.prediction_metrics(rows, ["g"]).collect()}
    assert (got["x"].n_negative, got["x"].mae, got["x"].rmse) == (1, 1.5, pytest.approx(2.5**0.5)) and got["y"].n_invalid == 2
    scores = spark.createDataFrame([(1, "a", 1.0, 3.0), (1, "b", 1.0, 2.0), (2, "c", 5.0, 5.0)], "h int, name string, mae double, rmse double")
    assert sorted((x.h, x.name) for x in metrics.select_best(scores, ["h"], ["mae", "rmse", "name"]).collect()) == [(1, "b"), (2, "c")]


def test_gates(spark):
    two = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    results = quality.gates({"duplicates": quality.duplicate_keys(two, ["k"]), "none": two.filter("k > 5")})
    assert {x.gate: x.n_violations for x in results.collect()} == {"duplicates": 1, "none": 0}
    with pytest.raises(quality.GateError, match="duplicates: 1"):
        quality.enforce(results)
    quality.enforce(results.filter("gate = 'none'"))
    assert quality.symmetric_difference(two, spark.createDataFrame([(1,), (3,)], "k int")).count() == 3


def test_profiles(spark):
    df = spark.createDataFrame([(1, at(2025, 1, 1, 1)), (1, at(2025, 1, 1, 2)), (None, at(2025, 2, 1)), (7, None)], "key int, time timestamp")
    lookup = spark.createDataFrame([(1, "z", "a"), (2, "y", "a")], "key int, zone string, area string")
    assert {x.column: x.n_null for x in profiling.profile_nulls(df).collect()} == {"key": 1, "time": 1}
    assert [(x.key, x.n, x.rank, x.known) for x in profiling.profile_keys(df, "key", lookup).orderBy("rank").collect()] == [(1, 2, 1, True), (None, 1, 2, False), (7, 1, 3, False)]
    assert {x.key: (x.n, x.n_hours, x.active_rate) for x in profiling.sparsity(df, "key", "time", lookup).collect()} == {1: (2, 2, 1.0), 2: (0, 0, 0.0)}
    s = profiling.screen(df, {"k": ("key - 1", 3.0)}).first()
    assert (s.n_zero, s.n_negative, s.n_over, s.most) == (2, 0, 1, 6.0)

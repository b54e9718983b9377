"""Every operator as a query over the given tables, with its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import is_fold, is_gap, to_utc, wall_clock
from ..operators import classify, features, forecasts, geo, grid, metrics, ml, profiling, quality, ridge, splits, timeaxis
from ..sources import io
from ..spec import CALENDAR_COLUMNS, CONTRACT_A, CONTRACT_B, HISTORY_COLUMNS
from . import base, oracle
from .base import SPEC, TZ, naive, rounded, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, body: str | None = None, plain: bool = False) -> Callable[[Query], Query]:
    """Register a query, and its oracle: SQL over the shared tables, or as it stands if ``plain``."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if body is not None:
            ORACLES[name] = body if plain else oracle.sql(body)
        return f

    return register


# Sources, sinks and inventories


@query("src_provenance", "SELECT 'events.parquet' AS source_file, '' AS source_month, count(*) AS n_rows, min(ts) AS first_ts FROM events", plain=True)
def src_provenance(spark, sf):
    table(spark, sf, "events")
    rows = io.read_with_provenance(spark, f"{sf}/events.parquet")
    return rows.groupBy("source_file", "source_month").agg(F.count("*").alias("n_rows"), F.min("ts").alias("first_ts"))


@query("src_months", "SELECT strftime(o_orderdate, '%Y-%m') AS source_month, count(*) AS n_rows, min(o_orderdate) AS first_ts, max(o_orderdate) AS last_ts FROM orders GROUP BY 1", plain=True)
def src_months(spark, sf):
    """Files of a folder for each month, read by a glob; the month comes from the path."""
    path = io.shared_path(spark, "monthly")
    io.write_partitioned(table(spark, sf, "orders").select("o_orderkey", "o_orderdate", F.date_format("o_orderdate", "yyyy-MM").alias("month")), path, ["month"])
    rows = io.read_with_provenance(spark, f"{path}/month=*", from_folder=True)
    return rows.groupBy("source_month").agg(F.count("*").alias("n_rows"), F.min("o_orderdate").alias("first_ts"), F.max("o_orderdate").alias("last_ts"))


@query("forecast_parse", "SELECT run_utc, point, target_utc, forecast_value, forecast_k FROM parsed")
def forecast_parse(spark, sf):
    return naive(forecasts.parse_runs(base.runs(spark, sf)))


@query("pruned_scan", "SELECT CAST(month(o_orderdate) AS INT) AS order_month, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE month(o_orderdate) <= 3 GROUP BY 1", plain=True)
def pruned_scan(spark, sf):
    path = io.shared_path(spark, "orders")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.month("o_orderdate").alias("order_month"))
    io.write_partitioned(orders, path, ["order_month"])
    pruned = io.read_partitions(spark, path, F.col("order_month") <= 3)
    return pruned.groupBy("order_month").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("stage_report", """SELECT 'grid' AS stage, m.metric, '' AS dims, CAST(m.value AS DOUBLE) AS value FROM (SELECT unnest([
  {'metric': 'n_rows', 'value': count(*)}, {'metric': 'n_zero', 'value': count(*) FILTER (demand = 0)}, {'metric': 'n_unavailable', 'value': count(*) FILTER (NOT available)},
  {'metric': 'n_keys', 'value': count(DISTINCT key)}, {'metric': 'n_hours', 'value': count(DISTINCT target_utc)}]) AS m FROM grid)
  UNION ALL SELECT 'classify', 'n', 'status=' || status || ',reason=' || reason, CAST(count(*) AS DOUBLE) FROM classified GROUP BY status, reason""")
def stage_report(spark, sf):
    return io.report("grid", grid.grid_metrics(base.demand(spark, sf))).unionByName(io.report("classify", classify.reason_counts(base.classified(spark, sf)), ["status", "reason"]))


_INVENTORY = "SELECT CAST(o_orderkey AS VARCHAR) AS name, o_custkey {a} AS bytes, sha256(o_orderstatus || CAST(o_custkey {b} AS VARCHAR)) AS sha256, o_orderkey FROM orders"


def _files(spark, sf, found: bool) -> DataFrame:
    orders = table(spark, sf, "orders")
    off = (lambda n: F.when(F.col("o_orderkey") % n == 0, 1).otherwise(0)) if found else (lambda n: F.lit(0))
    rows = orders.filter("o_orderkey % 13 <> 0") if found else orders
    return rows.select(F.col("o_orderkey").cast("string").alias("name"), (F.col("o_custkey") + off(17)).alias("bytes"), F.sha2(F.concat("o_orderstatus", (F.col("o_custkey") + off(19)).cast("string")), 256).alias("sha256"))


@query("inventory_check", f"""WITH m AS ({_INVENTORY.format(a="", b="")}), f AS ({_INVENTORY.format(a="+ (CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END)", b="+ (CASE WHEN o_orderkey % 19 = 0 THEN 1 ELSE 0 END)")} WHERE o_orderkey % 13 <> 0)
  SELECT m.name, CASE WHEN f.name IS NULL THEN 'missing' WHEN f.bytes <> m.bytes THEN 'size' WHEN f.sha256 <> m.sha256 THEN 'checksum' END AS problem FROM m LEFT JOIN f USING (name)""", plain=True)
def inventory_check(spark, sf):
    return io.check_inventory(_files(spark, sf, False), _files(spark, sf, True)).select("name", "problem")


@query("plan_missing", "SELECT DISTINCT run_utc FROM plan WHERE run_utc NOT IN (SELECT run_utc FROM parsed)")
def plan_missing(spark, sf):
    planned = base.plan(spark).select("run_utc").distinct()
    return naive(io.still_missing(planned, base.runs(spark, sf).select("run_utc").distinct(), ["run_utc"]))


@query("file_contract", """SELECT 'orders_' || year(o_orderdate) AS file, count(*) AS n_rows, min(o_orderdate) AS first, max(o_orderdate) AS last,
  min(o_orderdate) < TIMESTAMP '1998-01-01' AND max(o_orderdate) >= TIMESTAMP '1996-01-01' AS valid FROM orders GROUP BY 1""", plain=True)
def file_contract(spark, sf):
    files = table(spark, sf, "orders").withColumn("file", F.concat(F.lit("orders_"), F.year("o_orderdate").cast("string")))
    return io.file_contract(files, "file", "o_orderdate", F.expr("TIMESTAMP_NTZ '1996-01-01'"), F.expr("TIMESTAMP_NTZ '1998-01-01'"))


# Classification and time axis


@query("classify", "SELECT event_id, key, zone, area, reason, status FROM classified")
def classify_(spark, sf):
    return base.classified(spark, sf).select("event_id", "key", "zone", "area", "reason", "status")


@query("classify_utc", "SELECT event_id, local_time, time_utc, hour_utc FROM classified")
def classify_utc(spark, sf):
    return naive(base.classified(spark, sf).select("event_id", "local_time", "time_utc", "hour_utc"))


@query("dst_gap", f"SELECT event_id, local_time FROM records WHERE local_time IS NOT NULL AND {oracle.BACK('u')} <> local_time")
def dst_gap(spark, sf):
    return base.records(spark, sf).filter(is_gap(wall_clock(F.col("local_time")), TZ)).select("event_id", "local_time")


@query("dst_fold", f"SELECT event_id, local_time FROM records_fold WHERE {oracle.BACK('u + INTERVAL 1 HOUR')} = local_time OR {oracle.BACK('u - INTERVAL 1 HOUR')} = local_time")
def dst_fold(spark, sf):
    return base.records(spark, sf, base.FOLD_DAYS).filter(is_fold(wall_clock(F.col("local_time")), TZ)).select("event_id", "local_time")


@query("reason_counts", "SELECT 'gap' AS year_part, status, reason, count(*) AS n FROM classified GROUP BY ALL UNION ALL SELECT 'fold', status, reason, count(*) FROM classified_fold GROUP BY ALL")
def reason_counts(spark, sf):
    parts = [classify.reason_counts(base.classified(spark, sf, days)).select(F.lit(name).alias("year_part"), "status", "reason", "n") for name, days in (("gap", base.GAP_DAYS), ("fold", base.FOLD_DAYS))]
    return parts[0].unionByName(parts[1])


@query("hour_axis", f"""WITH b AS (SELECT (date_trunc('day', min(ts) + INTERVAL 60 DAY) AT TIME ZONE '{TZ}') AT TIME ZONE 'UTC' AS a,
  ((date_trunc('day', max(ts) + INTERVAL 60 DAY) + INTERVAL 1 DAY) AT TIME ZONE '{TZ}') AT TIME ZONE 'UTC' AS z FROM events),
  h AS (SELECT unnest(generate_series(a, z - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS target_utc FROM b)
  SELECT target_utc, count(*) OVER (PARTITION BY {oracle.BACK('target_utc')}) = 1 AS available FROM h""", plain=True)
def hour_axis(spark, sf):
    day = lambda c: F.date_trunc("day", wall_clock(c + F.expr(f"INTERVAL {base.GAP_DAYS} DAYS")))
    bounds = table(spark, sf, "events").agg(to_utc(day(F.min("ts")), TZ).alias("a"), to_utc(day(F.max("ts")) + F.expr("INTERVAL 1 DAY"), TZ).alias("b"))
    return naive(timeaxis.with_availability(timeaxis.hours_between(bounds, "a", "b"), TZ))


@query("calendar_features", f"""SELECT key, target_utc, n, CAST(hour(l) AS INT) AS local_hour, CAST(dayofweek(l) + 1 AS INT) AS local_weekday, dayofweek(l) IN (0, 6) AS local_weekend, CAST(month(l) AS INT) AS local_month
  FROM (SELECT *, {oracle.BACK('target_utc')} AS l FROM counts)""")
def calendar_features(spark, sf):
    return naive(timeaxis.with_calendar(base.counts(spark, sf), TZ))


# Grid and coverage


@query("hourly_counts", "SELECT key, target_utc, n FROM counts")
def hourly_counts(spark, sf):
    return naive(base.counts(spark, sf))


@query("demand_grid", "SELECT key, target_utc, available, demand FROM grid")
def demand_grid(spark, sf):
    return naive(base.demand(spark, sf))


@query("grid_metrics", "SELECT count(*) AS n_rows, count(*) FILTER (demand = 0) AS n_zero, count(*) FILTER (NOT available) AS n_unavailable, count(DISTINCT key) AS n_keys, count(DISTINCT target_utc) AS n_hours FROM grid")
def grid_metrics(spark, sf):
    return grid.grid_metrics(base.demand(spark, sf))


@query("active_hours", "SELECT key, count(*) FILTER (demand > 0) AS n_active, count(*) FILTER (available) AS n_available, round(count(*) FILTER (demand > 0) / count(*) FILTER (available), 6) AS active_rate FROM grid GROUP BY key")
def active_hours(spark, sf):
    return rounded(grid.active_hours(base.demand(spark, sf)))


def _key_totals(spark, sf) -> DataFrame:
    return base.accepted(spark, sf).groupBy("key").agg(F.count("*").alias("n"))


@query("coverage_select", "SELECT key, n, rank, cumulative, total FROM shares WHERE (cumulative - n) * 100 < total * 95")
def coverage_select(spark, sf):
    return grid.covering_keys(_key_totals(spark, sf), base.COVERAGE).withColumn("rank", F.col("rank").cast("long"))


@query("coverage_sets", """WITH u AS (SELECT user_id AS key, count(*) AS n, count(DISTINCT date_trunc('hour', ts)) / 720.0 AS rate FROM events GROUP BY 1),
  s AS (SELECT *, sum(n) OVER (ORDER BY n DESC, key ROWS UNBOUNDED PRECEDING) AS c, sum(n) OVER () AS t FROM u)
  SELECT CAST(p AS INT) AS percent, count(*) AS n_keys, CAST(max(c) AS BIGINT) AS covered, CAST(max(t) AS BIGINT) AS total, round(min(rate), 6) AS lowest_rate
  FROM s CROSS JOIN (SELECT unnest([90, 95, 99]) AS p) WHERE (c - n) * 100 < t * p GROUP BY p""", plain=True)
def coverage_sets(spark, sf):
    users = table(spark, sf, "events").groupBy(F.col("user_id").alias("key")).agg(F.count("*").alias("n"), (F.countDistinct(F.date_trunc("hour", F.col("ts"))) / F.lit(720.0)).alias("rate"))
    return rounded(grid.coverage_sets(users, (90, 95, 99), rate="rate"))


@query("scope_filter", "SELECT key, target_utc, demand FROM grid WHERE key IN (SELECT key FROM shares WHERE (cumulative - n) * 100 < total * 95)")
def scope_filter(spark, sf):
    keys = grid.covering_keys(_key_totals(spark, sf), base.COVERAGE).select("key")
    return naive(base.demand(spark, sf).join(keys, "key", "left_semi").select("key", "target_utc", "demand"))


# Forecasts


@query("forecast_plan", "SELECT DISTINCT p.target_utc, p.horizon_hours, p.cutoff_utc, p.run_utc FROM plan p SEMI JOIN counts c ON c.target_utc = p.target_utc")
def forecast_plan(spark, sf):
    hours = base.counts(spark, sf).select("target_utc").distinct()
    return naive(forecasts.forecast_plan(hours, SPEC))


@query("forecast_complete", "SELECT run_utc, target_utc, point, horizon_hours, cutoff_utc, forecast_value, forecast_k, forecast_value_missing, forecast_k_missing, source_available, any_missing FROM completed")
def forecast_complete(spark, sf):
    return naive(base.completed(spark, sf))


@query("forecast_metrics", """SELECT count(*) AS n_rows, count(*) FILTER (any_missing) AS n_any_missing, count(*) FILTER (NOT source_available) AS n_unavailable,
  count(*) FILTER (run_utc + INTERVAL 6 HOUR > cutoff_utc) AS n_leaks FROM completed""")
def forecast_metrics(spark, sf):
    return forecasts.forecast_metrics(base.completed(spark, sf), SPEC)


@query("missing_slots", "SELECT run_utc, target_utc, horizon_hours, point, variable, reason FROM slots")
def missing_slots(spark, sf):
    return naive(forecasts.missing_slots(base.completed(spark, sf)))


@query("missing_by_dim", "SELECT run_utc, target_utc, horizon_hours, point, variable, reason, count(*) AS n FROM slots GROUP BY GROUPING SETS ((run_utc), (target_utc), (horizon_hours), (point), (variable), (reason), ())")
def missing_by_dim(spark, sf):
    return naive(forecasts.missing_by_dimension(forecasts.missing_slots(base.completed(spark, sf))))


_PANEL = "key, target_utc, horizon_hours, cutoff_utc, available, demand, point, run_utc, forecast_value, forecast_k, source_available, any_missing"


@query("panel_forecast_join", f"SELECT {_PANEL} FROM panel")
def panel_forecast_join(spark, sf):
    return naive(base.panel(spark, sf).select(*_PANEL.split(", ")))


@query("nearest_point", f"""SELECT c_custkey, b.name AS point, round(b.km, 6) AS distance_km FROM (SELECT c_custkey, {oracle.NEAREST('lat', 'lon')} AS b FROM
  (SELECT c_custkey, CAST(c_custkey % 179 - 89 AS DOUBLE) AS lat, CAST((c_custkey * 7) % 360 - 180 AS DOUBLE) AS lon FROM customer))""", plain=True)
def nearest_point(spark, sf):
    places = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 179 - 89).cast("double").alias("lat"), ((F.col("c_custkey") * 7) % 360 - 180).cast("double").alias("lon"))
    return rounded(geo.nearest_point(places, base.POINTS).select("c_custkey", "point", "distance_km"))


@query("spatial_spread", """SELECT count(*) AS n_hours, round(avg(r), 6) AS mean_range, round(quantile_disc(r, 0.95), 6) AS p95_range, round(max(r), 6) AS max_range,
  count(*) FILTER (r >= 50) AS n_over, count(*) FILTER (s AND NOT a) AS n_disagree FROM (SELECT target_utc, max(v) - min(v) AS r, bool_or(v > 0) AS s, bool_and(v > 0) AS a
  FROM (SELECT target_utc, forecast_value - 50 AS v FROM hourly) GROUP BY 1)""")
def spatial_spread(spark, sf):
    values = base.hourly_values(spark, sf).select("target_utc", (F.col("forecast_value") - 50).alias("value"))
    return rounded(forecasts.spatial_spread(values, 50.0))


@query("forecast_profile", """SELECT point, count(*) AS n_hours, min(target_utc) AS first_utc, max(target_utc) AS last_utc, count(*) FILTER (forecast_value IS NULL OR forecast_value = -999) AS forecast_value_nulls,
  count(*) FILTER (forecast_k IS NULL OR forecast_k = -999) AS forecast_k_nulls FROM parsed GROUP BY point""")
def forecast_profile(spark, sf):
    return naive(forecasts.forecast_profile(base.runs(spark, sf)))


# Features

_HISTORY = "key, cutoff_utc, demand_at_cutoff, demand_1h_before, demand_2h_before"
_ROLLING = "round(mean_3h, 6) AS mean_3h, round(mean_6h, 6) AS mean_6h, round(mean_24h, 6) AS mean_24h, round(std_24h, 6) AS std_24h"
_AUDIT = "demand_at_cutoff_source, demand_1h_source, demand_2h_source, mean_3h_start, mean_6h_start, mean_24h_start, mean_24h_end"


@query("history_lags", f"SELECT {_HISTORY} FROM history")
def history_lags(spark, sf):
    return naive(features.history_at_cutoff(base.demand(spark, sf)).select(*_HISTORY.split(", ")))


@query("history_rolling", f"SELECT key, cutoff_utc, {_ROLLING} FROM history")
def history_rolling(spark, sf):
    return rounded(features.history_at_cutoff(base.demand(spark, sf)).select("key", "cutoff_utc", "mean_3h", "mean_6h", "mean_24h", "std_24h"))


@query("history_audit", f"SELECT key, cutoff_utc, {_AUDIT} FROM history")
def history_audit(spark, sf):
    return naive(features.history_at_cutoff(base.demand(spark, sf)).select("key", "cutoff_utc", *_AUDIT.split(", ")))


@query("local_hour", "SELECT key, local_hour_time, n_instants, n_available, demand, source_utc FROM local_hours")
def local_hour(spark, sf):
    return naive(features.local_hours(base.demand(spark, sf), TZ))


@query("seasonal_lags", f"""SELECT g.key, g.target_utc, d.demand AS demand_day_before, d.source_utc AS demand_day_source, w.demand AS demand_week_before, w.source_utc AS demand_week_source
  FROM (SELECT *, {oracle.BACK('target_utc')} AS l FROM grid) g LEFT JOIN local_hours d ON d.key = g.key AND d.local_hour_time = g.l - INTERVAL 1 DAY
  LEFT JOIN local_hours w ON w.key = g.key AND w.local_hour_time = g.l - INTERVAL 7 DAY""")
def seasonal_lags(spark, sf):
    rows = base.demand(spark, sf)
    return naive(features.with_seasonal_lags(rows.select("key", "target_utc"), rows, TZ))


_FEATURES = ["key", "target_utc", "horizon_hours", "cutoff_utc", "demand", *HISTORY_COLUMNS, *CALENDAR_COLUMNS, "forecast_value", "forecast_k", "demand_day_source", "demand_week_source", "split", "history_complete", "forecast_complete", "paired"]
_FEATURES_SQL = ", ".join(f"round({c}, 6) AS {c}" if c in ("mean_3h", "mean_6h", "mean_24h", "std_24h") else c for c in _FEATURES)


@query("features", f"SELECT {_FEATURES_SQL} FROM features")
def features_(spark, sf):
    return rounded(base.feature_rows(spark, sf).select(*_FEATURES))


@query("eligibility_accounting", "SELECT horizon_hours, count(*) AS n_rows, count(*) FILTER (available) AS n_eligible, count(*) FILTER (NOT available) AS n_unavailable FROM panel GROUP BY 1")
def eligibility_accounting(spark, sf):
    return quality.eligibility_accounting(base.panel(spark, sf))


@query("feature_nulls", "SELECT c.name AS \"column\", c.n AS n_null FROM (SELECT unnest([" + ", ".join(f"{{'name': '{c}', 'n': count(*) FILTER ({c} IS NULL)}}" for c in (*HISTORY_COLUMNS, *CALENDAR_COLUMNS, "forecast_value", "forecast_k")) + "]) AS c FROM features)")
def feature_nulls(spark, sf):
    return quality.null_counts(base.feature_rows(spark, sf), [*HISTORY_COLUMNS, *CALENDAR_COLUMNS, "forecast_value", "forecast_k"])


@query("keyed_counts", "SELECT horizon_hours, local_month, key, count(*) AS n, CAST(grouping(horizon_hours, local_month, key) AS BIGINT) AS grouping FROM features GROUP BY GROUPING SETS ((horizon_hours), (local_month), (key), (horizon_hours, local_month))")
def keyed_counts(spark, sf):
    return quality.keyed_counts(base.feature_rows(spark, sf))


@query("leakage_audit", "SELECT c.name AS source, c.n AS n_late FROM (SELECT unnest([" + ", ".join(f"{{'name': '{c}', 'n': count(*) FILTER ({c} > cutoff_utc)}}" for c in ("demand_at_cutoff_source", "demand_1h_source", "demand_2h_source", "demand_day_source", "demand_week_source")) + ", {'name': 'mean_24h_end', 'n': count(*) FILTER (mean_24h_end <> cutoff_utc)}]) AS c FROM features)")
def leakage_audit(spark, sf):
    return quality.leakage_audit(base.feature_rows(spark, sf))


# Splits


@query("split_assign", f"SELECT key, target_utc, n, {oracle.SPLIT.format(l=oracle.BACK('target_utc'))} AS split FROM counts")
def split_assign(spark, sf):
    return naive(splits.assign_split(base.counts(spark, sf), SPEC))


@query("paired_population", "SELECT key, target_utc, horizon_hours, demand, split FROM features WHERE paired")
def paired_population(spark, sf):
    return naive(splits.paired_population(base.feature_rows(spark, sf)).select("key", "target_utc", "horizon_hours", "demand", "split"))


@query("paired_definition", "SELECT horizon_hours, count(*) AS n_rows, count(*) FILTER (paired <> (history_complete AND NOT coalesce(any_missing, TRUE))) AS n_mismatch FROM features GROUP BY 1")
def paired_definition(spark, sf):
    return splits.definition_mismatches(base.feature_rows(spark, sf))


@query("split_guard", f"""SELECT split, count(*) AS n_rows, count(*) FILTER (split = 'train' AND l >= TIMESTAMP '2024-03-20') AS n_late_train,
  count(*) FILTER (split = 'test' AND l < TIMESTAMP '2024-03-25') AS n_early_test FROM (SELECT split, {oracle.BACK('target_utc')} AS l FROM features) GROUP BY 1""")
def split_guard(spark, sf):
    return splits.forbidden_periods(base.feature_rows(spark, sf), SPEC)


@query("split_overlap", """WITH s AS (SELECT DISTINCT split, target_utc FROM features WHERE split IS NOT NULL), p AS (SELECT a.split AS a, b.split AS b FROM (SELECT DISTINCT split FROM s) a, (SELECT DISTINCT split FROM s) b WHERE a.split < b.split)
  SELECT p.a, p.b, (SELECT count(*) FROM s x JOIN s y ON x.target_utc = y.target_utc WHERE x.split = p.a AND y.split = p.b) AS n_shared FROM p""".replace("WITH s AS", "SELECT * FROM (WITH s AS", 1) + ")")
def split_overlap(spark, sf):
    return splits.split_overlap(base.feature_rows(spark, sf))


@query("split_ranges", "SELECT split, first_utc, last_utc, n_rows, coalesce(last_utc < lead(first_utc) OVER (ORDER BY first_utc), TRUE) AS in_order FROM (SELECT split, min(target_utc) AS first_utc, max(target_utc) AS last_utc, count(*) AS n_rows FROM features WHERE split IS NOT NULL GROUP BY 1)")
def split_ranges(spark, sf):
    return naive(splits.split_ranges(base.feature_rows(spark, sf)))


@query("exclusions", """SELECT split, horizon_hours, count(*) AS n_rows, count(*) FILTER (paired) AS n_paired, count(*) FILTER (NOT history_complete) AS n_history, count(*) FILTER (NOT forecast_complete) AS n_forecast,
  count(*) FILTER (NOT history_complete AND forecast_complete) AS n_only_history, count(*) FILTER (history_complete AND NOT forecast_complete) AS n_only_forecast,
  count(*) FILTER (NOT history_complete AND NOT forecast_complete) AS n_both FROM features GROUP BY 1, 2""")
def exclusions(spark, sf):
    return splits.exclusions(base.feature_rows(spark, sf))


# Baselines and metrics


def _long(spark, sf) -> DataFrame:
    return metrics.baselines_long(splits.paired_population(base.feature_rows(spark, sf)))


@query("baseline_long", "SELECT key, target_utc, horizon_hours, cutoff_utc, split, actual, baseline, prediction, source_utc FROM long")
def baseline_long(spark, sf):
    return naive(_long(spark, sf))


@query("baseline_metrics", "SELECT split, baseline, horizon_hours, n_rows, round(mae, 6) AS mae, round(rmse, 6) AS rmse FROM baseline_scores")
def baseline_metrics(spark, sf):
    return rounded(metrics.baseline_metrics(_long(spark, sf)).select("split", "baseline", "horizon_hours", "n_rows", "mae", "rmse"))


@query("baseline_audit", "SELECT baseline, count(*) AS n_rows, count(*) FILTER (prediction IS NULL) AS n_null, count(*) FILTER (source_utc > cutoff_utc) AS n_late FROM long GROUP BY 1")
def baseline_audit(spark, sf):
    return metrics.baseline_audit(_long(spark, sf))


@query("zone_mae_summary", """SELECT split, baseline, count(*) AS n_keys, round(avg(mae), 6) AS mean, round(min(mae), 6) AS least, round(quantile_disc(mae, 0.25), 6) AS p25, round(quantile_disc(mae, 0.5), 6) AS median,
  round(quantile_disc(mae, 0.75), 6) AS p75, round(max(mae), 6) AS most FROM (SELECT split, baseline, key, avg(abs(actual - prediction)) AS mae FROM long GROUP BY ALL) GROUP BY 1, 2""")
def zone_mae_summary(spark, sf):
    return rounded(metrics.key_mae_summary(_long(spark, sf)))


_VALIDATION = "split = 'validation' AND horizon_hours IS NOT NULL"


def _scores(spark, sf) -> DataFrame:
    return metrics.baseline_metrics(_long(spark, sf)).filter(_VALIDATION)


@query("select_best", f"SELECT horizon_hours, baseline, n_rows, round(mae, 6) AS mae, round(rmse, 6) AS rmse FROM baseline_scores WHERE {_VALIDATION} QUALIFY row_number() OVER (PARTITION BY horizon_hours ORDER BY mae, rmse, baseline) = 1")
def select_best(spark, sf):
    return rounded(metrics.select_best(_scores(spark, sf), ["horizon_hours"], ["mae", "rmse", "baseline"]).select("horizon_hours", "baseline", "n_rows", "mae", "rmse"))


@query("ab_delta", f"""SELECT *, round(mae_b - mae_a, 6) AS mae_delta, round(rmse_b - rmse_a, 6) AS rmse_delta FROM (SELECT horizon_hours, round(max(mae) FILTER (baseline = 'day_before'), 6) AS mae_a, round(max(rmse) FILTER (baseline = 'day_before'), 6) AS rmse_a,
  round(max(mae) FILTER (baseline = 'week_before'), 6) AS mae_b, round(max(rmse) FILTER (baseline = 'week_before'), 6) AS rmse_b FROM baseline_scores WHERE {_VALIDATION} GROUP BY 1)""")
def ab_delta(spark, sf):
    sets = F.when(F.col("baseline") == "day_before", "A").when(F.col("baseline") == "week_before", "B")
    scores = rounded(_scores(spark, sf).withColumn("feature_set", sets))
    return rounded(metrics.ab_deltas(scores, ["horizon_hours"]))


@query("baseline_improvement", f"""WITH s AS (SELECT horizon_hours, baseline, n_rows, round(mae, 6) AS mae, round(rmse, 6) AS rmse FROM baseline_scores WHERE {_VALIDATION})
  SELECT a.horizon_hours, a.baseline, a.n_rows, a.mae, a.rmse, b.mae AS baseline_mae, round(b.mae - a.mae, 6) AS improvement, round((b.mae - a.mae) * 100 / b.mae, 6) AS improvement_percent
  FROM s a JOIN s b ON a.horizon_hours = b.horizon_hours AND b.baseline = 'persistence' WHERE a.baseline <> 'persistence'""".replace("WITH s AS", "SELECT * FROM (WITH s AS", 1) + ")")
def baseline_improvement(spark, sf):
    scores = rounded(_scores(spark, sf)).select("horizon_hours", "baseline", "n_rows", "mae", "rmse")
    return rounded(metrics.baseline_improvement(scores.filter("baseline <> 'persistence'"), scores.filter("baseline = 'persistence'"), ["horizon_hours"]))


@query("clip_metrics", """SELECT horizon_hours, count(*) FILTER (r < 0) AS n_negative, count(*) FILTER (r IS NULL OR isnan(r)) AS n_invalid, count(*) AS n_rows,
  round(avg(abs(actual - p)), 6) AS mae, round(sqrt(avg((actual - p) * (actual - p))), 6) AS rmse FROM (SELECT *, CASE WHEN r IS NOT NULL THEN greatest(r, 0.0) END AS p
  FROM (SELECT horizon_hours, CAST(demand AS DOUBLE) AS actual, CAST(demand_at_cutoff AS DOUBLE) - 2 AS r FROM features)) GROUP BY 1""")
def clip_metrics(spark, sf):
    rows = base.feature_rows(spark, sf).select("horizon_hours", F.col("demand").cast("double").alias("actual"), (F.col("demand_at_cutoff").cast("double") - 2).alias("raw_prediction"))
    return rounded(metrics.prediction_metrics(rows, ["horizon_hours"]))


def _gold(spark, sf, name: str, value: str) -> DataFrame:
    rows = splits.paired_population(base.feature_rows(spark, sf)).filter("split = 'test'")
    return rows.select("key", "target_utc", "horizon_hours", F.col("demand").cast("double").alias("actual"), F.col(value).cast("double").alias("prediction"), F.lit(name).alias("feature_set"))


@query("gold_union", "SELECT key, target_utc, horizon_hours, CAST(demand AS DOUBLE) AS actual, CAST(s.v AS DOUBLE) AS prediction, s.f AS feature_set FROM (SELECT *, unnest([{'f': 'A', 'v': demand_day_before}, {'f': 'B', 'v': demand_week_before}]) AS s FROM features WHERE paired AND split = 'test')")
def gold_union(spark, sf):
    return naive(_gold(spark, sf, "A", "demand_day_before").unionByName(_gold(spark, sf, "B", "demand_week_before")))


@query("key_symdiff", """SELECT *, 'left' AS side FROM (SELECT key, target_utc FROM counts EXCEPT ALL SELECT key, target_utc FROM grid WHERE demand > 0 AND key % 3 <> 0) UNION ALL
  SELECT *, 'right' FROM (SELECT key, target_utc FROM grid WHERE demand > 0 AND key % 3 <> 0 EXCEPT ALL SELECT key, target_utc FROM counts)""")
def key_symdiff(spark, sf):
    left = base.counts(spark, sf).select("key", "target_utc")
    right = base.demand(spark, sf).filter("demand > 0 AND key % 3 <> 0").select("key", "target_utc")
    return naive(quality.symmetric_difference(left, right))


@query("duplicate_keys", "SELECT key, hour_utc, count(*) AS n FROM classified WHERE status = 'accepted' GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return naive(quality.duplicate_keys(base.accepted(spark, sf), ["key", "hour_utc"]))


@query("gates", """SELECT 'duplicate_grid_keys' AS gate, count(*) AS n_violations FROM (SELECT key, target_utc FROM grid GROUP BY ALL HAVING count(*) > 1)
  UNION ALL SELECT 'forecast_leaks', count(*) FROM completed WHERE run_utc + INTERVAL 6 HOUR > cutoff_utc
  UNION ALL SELECT 'outside_splits', count(*) FROM features WHERE split IS NULL
  UNION ALL SELECT 'missing_slots', count(*) FROM slots UNION ALL SELECT 'duplicate_feature_keys', count(*) FROM (SELECT key, target_utc, horizon_hours FROM features GROUP BY ALL HAVING count(*) > 1)""")
def gates(spark, sf):
    rows, done = base.feature_rows(spark, sf), base.completed(spark, sf)
    return quality.gates({
        "duplicate_grid_keys": quality.duplicate_keys(base.demand(spark, sf), ["key", "target_utc"]), "forecast_leaks": done.filter(forecasts.leaks(SPEC)),
        "outside_splits": rows.filter(F.col("split").isNull()), "missing_slots": forecasts.missing_slots(done), "duplicate_feature_keys": quality.duplicate_keys(rows, ["key", "target_utc", "horizon_hours"]),
    })


# Profiles


@query("profile_nulls", "SELECT c.name AS \"column\", c.n AS n_null FROM (SELECT unnest([" + ", ".join(f"{{'name': '{c}', 'n': count(*) FILTER ({c} IS NULL)}}" for c in ("event_id", "local_time", "key", "point", "value", "k")) + "]) AS c FROM records)")
def profile_nulls(spark, sf):
    return profiling.profile_nulls(base.records(spark, sf))


@query("profile_time", """SELECT c.name AS "column", c.a AS first, c.b AS last, c.n AS n_outside FROM (SELECT unnest([{'name': 'l_shipdate', 'a': min(l_shipdate), 'b': max(l_shipdate),
  'n': count(*) FILTER (l_shipdate < TIMESTAMP '1996-01-01' OR l_shipdate >= TIMESTAMP '1998-01-01')}]) AS c FROM lineitem)""", plain=True)
def profile_time(spark, sf):
    return profiling.profile_time(table(spark, sf, "lineitem"), ["l_shipdate"], F.expr("TIMESTAMP_NTZ '1996-01-01'"), F.expr("TIMESTAMP_NTZ '1998-01-01'"))


@query("profile_keys", """SELECT r.key, r.n, r.percent, r.rank, l.key IS NOT NULL AS known FROM (SELECT key, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent,
  row_number() OVER (ORDER BY count(*) DESC, key NULLS FIRST) AS rank FROM records GROUP BY key) r LEFT JOIN lookup l ON l.key = r.key""")
def profile_keys(spark, sf):
    return rounded(profiling.profile_keys(base.records(spark, sf), "key", base.lookup(spark, sf))).withColumn("rank", F.col("rank").cast("long"))


_SCREENS = {"quantity": ("l_quantity - 10", 35.0), "price": ("l_extendedprice", 50000.0), "discount": ("l_discount", 0.05), "days": ("datediff(l_shipdate, o_orderdate)", 60.0)}


@query("profile_quality", "SELECT m.* FROM (SELECT unnest([" + ", ".join(f"{{'measure': '{n}', 'n_zero': count(*) FILTER ({e} = 0), 'n_negative': count(*) FILTER ({e} < 0), 'n_over': count(*) FILTER ({e} > {x}), 'least': CAST(min({e}) AS DOUBLE), 'most': CAST(max({e}) AS DOUBLE)}}" for n, (e, x) in (_SCREENS | {"days": ("date_diff('day', o_orderdate, l_shipdate)", 60.0)}).items()) + "]) AS m FROM lineitem JOIN orders ON l_orderkey = o_orderkey)", plain=True)
def profile_quality(spark, sf):
    items, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return profiling.screen(items.join(orders, items["l_orderkey"] == orders["o_orderkey"]), _SCREENS)


@query("profile_sparsity", """WITH h AS (SELECT key, date_trunc('hour', local_time) AS hour FROM records WHERE key IS NOT NULL AND local_time IS NOT NULL), c AS (SELECT key, count(*) AS n, count(DISTINCT hour) AS n_hours FROM h GROUP BY key)
  SELECT l.key, l.zone, l.area, coalesce(c.n, 0) AS n, coalesce(c.n_hours, 0) AS n_hours, round(coalesce(c.n_hours, 0) / (SELECT count(DISTINCT hour) FROM h), 6) AS active_rate FROM lookup l LEFT JOIN c ON c.key = l.key""".replace("WITH h AS", "SELECT * FROM (WITH h AS", 1) + ")")
def profile_sparsity(spark, sf):
    rows = base.records(spark, sf).withColumn("local_time", wall_clock(F.col("local_time")))
    return rounded(profiling.sparsity(rows, "key", "local_time", base.lookup(spark, sf)))


@query("profile_lookup", "SELECT area, count(*) AS n_keys FROM lookup GROUP BY area")
def profile_lookup(spark, sf):
    return profiling.lookup_profile(base.lookup(spark, sf))


# Models


def _train(spark, sf) -> DataFrame:
    return splits.paired_population(base.feature_rows(spark, sf)).filter("split = 'train'")


_MODEL_SQL = ", ".join(["key", "target_utc", "horizon_hours", "split", "CAST(demand AS DOUBLE) AS label", *[f"CAST({c} AS VARCHAR) AS c_{c}" for c in CONTRACT_B.categorical], *[f"round(CAST({c} AS DOUBLE), 6) AS n_{c}" for c in CONTRACT_B.numeric]])


@query("model_columns", f"SELECT {_MODEL_SQL} FROM features WHERE paired AND split = 'train'")
def model_columns(spark, sf):
    return rounded(ml.model_columns(_train(spark, sf), CONTRACT_B))


@query("ml_vocab", "SELECT c.name AS \"column\", c.value, count(*) AS n, row_number() OVER (PARTITION BY c.name ORDER BY count(*) DESC, c.value) - 1 AS position FROM (SELECT unnest([" + ", ".join(f"{{'name': '{c}', 'value': CAST({c} AS VARCHAR)}}" for c in CONTRACT_A.categorical) + "]) AS c FROM features WHERE paired AND split = 'train') GROUP BY 1, 2")
def ml_vocab(spark, sf):
    return ml.vocabulary_table(_train(spark, sf), CONTRACT_A).withColumn("position", F.col("position").cast("long"))


def _each_horizon(spark, sf, made) -> DataFrame:
    """The union of made(train, validation, contract) over all horizons and both feature sets."""
    rows = io.write_and_read(splits.paired_population(base.feature_rows(spark, sf)).filter("split <> 'test'"), io.shared_path(spark, "paired"))
    done = None
    for hours in SPEC.horizons:
        train, validation = (rows.filter((F.col("split") == s) & (F.col("horizon_hours") == hours)) for s in ("train", "validation"))
        for contract in (CONTRACT_A, CONTRACT_B):
            one = made(train, validation, contract)
            done = one if done is None else done.unionByName(one)
    return done


@query("ml_matrix")
def ml_matrix(spark, sf):
    from pyspark.ml.functions import vector_to_array

    def made(train, validation, contract):
        rows = ml.matrix(ml.fit_preprocessing(train, contract), validation, contract)
        return rows.withColumns({"features": vector_to_array("features"), "feature_set": F.lit(contract.name)})

    return naive(_each_horizon(spark, sf, made))


def _predicted(spark, sf, *configs: ml.Config) -> DataFrame:
    def made(train, validation, contract):
        done = None
        for config in configs:
            one = ml.evaluate_frozen(train, validation, contract, config).withColumn("config", F.lit(config.name))
            done = one if done is None else done.unionByName(one)
        return done

    return rounded(_each_horizon(spark, sf, made))


_LINEAR = tuple(c for c in ml.GRID if c.family == "linear")
_TRAIN, _VALIDATE = "split = 'train'", "split = 'validation'"


def _with_models(body: str, *ctes: str) -> str:
    return oracle.with_models(list(ctes), body)


def _ridge(rows: DataFrame, fit_on: str, score_on: str, configs: tuple[ml.Config, ...]) -> DataFrame:
    """Rows of score_on under each config, horizon and feature set, fitted on rows of fit_on in one pass."""
    return ridge.predict(ridge.fit(rows.filter(fit_on), (CONTRACT_A, CONTRACT_B), configs), rows.filter(score_on), CONTRACT_B)


def _five(df: DataFrame) -> DataFrame:
    """Predictions to five places: what two solvers of the same equations agree on."""
    return naive(df.withColumns({c: F.round(c, 5) for c in ("raw_prediction", "prediction")}))


_FIVE = "round(raw_prediction, 5) AS raw_prediction, round(prediction, 5) AS prediction"


@query("ml_linear", _with_models(f"SELECT key, target_utc, horizon_hours, actual, {_FIVE}, feature_set FROM predicted", oracle.ridge("predicted", _TRAIN, _VALIDATE, ("linear_0.1",))), plain=True)
def ml_linear(spark, sf):
    return _five(_ridge(_paired(spark, sf), _TRAIN, _VALIDATE, (ml.Config("linear_0.1", "linear", 0.1),)).drop("config"))


def _ridge_scores(predicted: DataFrame) -> DataFrame:
    return ml.scores(predicted.withColumn("family", F.lit("linear")))


_SCORES = (oracle.ridge("predicted", _TRAIN, _VALIDATE, tuple(c.name for c in _LINEAR)), oracle.ridge_scores("scores", "predicted"))


@query("ml_ridge_grid", _with_models("SELECT family, config, feature_set, horizon_hours, n_negative, n_invalid, n_rows, round(mae, 6) AS mae, round(rmse, 6) AS rmse FROM scores", *_SCORES), plain=True)
def ml_ridge_grid(spark, sf):
    """Validation scores of the linear grid: every penalty, horizon and feature set from one aggregate of the training rows."""
    return rounded(_ridge_scores(_ridge(_paired(spark, sf), _TRAIN, _VALIDATE, _LINEAR)))


def _tree_fits(rows: DataFrame) -> list[ml.Fit]:
    return ml.fit_each(rows.filter(_TRAIN), SPEC.horizons, (CONTRACT_A, CONTRACT_B), [c for c in ml.GRID if c.family == "trees"])


@query("ml_gbt")
def ml_gbt(spark, sf):
    rows = _paired(spark, sf)
    return rounded(ml.predict_each(_tree_fits(rows), rows.filter(_VALIDATE)).drop("family"))


def _paired(spark, sf) -> DataFrame:
    """Paired rows as a stage's stored output, so that every fit reads them instead of building them."""
    return io.write_and_read(splits.paired_population(base.feature_rows(spark, sf)), io.shared_path(spark, "paired"))


@query("ml_grid")
def ml_grid(spark, sf):
    """Validation scores of the whole grid: ridges from one aggregate, trees fitted side by side."""
    rows = _paired(spark, sf)
    linear = _ridge_scores(_ridge(rows, _TRAIN, _VALIDATE, _LINEAR))
    return rounded(linear.unionByName(ml.scores(ml.predict_each(_tree_fits(rows), rows.filter(_VALIDATE)))))


_BEST = "best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY horizon_hours, feature_set ORDER BY mae, rmse, config) = 1)"


@query("model_ab_delta", _with_models("""SELECT horizon_hours, mae_a, rmse_a, mae_b, rmse_b, round(mae_b - mae_a, 6) AS mae_delta, round(rmse_b - rmse_a, 6) AS rmse_delta FROM (SELECT horizon_hours, round(max(mae) FILTER (feature_set = 'A'), 6) AS mae_a, round(max(rmse) FILTER (feature_set = 'A'), 6) AS rmse_a,
  round(max(mae) FILTER (feature_set = 'B'), 6) AS mae_b, round(max(rmse) FILTER (feature_set = 'B'), 6) AS rmse_b FROM best GROUP BY 1)""", *_SCORES, _BEST), plain=True)
def model_ab_delta(spark, sf):
    """What the forecasts add: the best ridge with them less the best without, on validation rows of each horizon."""
    best = ml.select_configs(_ridge_scores(_ridge(_paired(spark, sf), _TRAIN, _VALIDATE, _LINEAR)))
    return rounded(metrics.ab_deltas(rounded(best), ["horizon_hours"]))


@query("model_improvement", _with_models(f"""SELECT b.horizon_hours, b.feature_set, b.n_rows, round(b.mae, 6) AS mae, round(l.mae, 6) AS baseline_mae, round(round(l.mae, 6) - round(b.mae, 6), 6) AS improvement,
  round((round(l.mae, 6) - round(b.mae, 6)) * 100 / round(l.mae, 6), 6) AS improvement_percent FROM best b JOIN baseline_scores l ON l.horizon_hours = b.horizon_hours AND l.baseline = 'week_before' AND l.{_VALIDATION.replace(' AND ', ' AND l.')}""", *_SCORES, _BEST), plain=True)
def model_improvement(spark, sf):
    """How far the best ridge of each horizon and feature set is below the week before, on the same validation rows."""
    rows = _paired(spark, sf)
    best = rounded(ml.select_configs(_ridge_scores(_ridge(rows, _TRAIN, _VALIDATE, _LINEAR)))).select("horizon_hours", "feature_set", "n_rows", "mae")
    week = metrics.baseline_metrics(metrics.baselines_long(rows)).filter(_VALIDATION).filter("baseline = 'week_before'")
    return rounded(metrics.baseline_improvement(best, rounded(week), ["horizon_hours"]))


@query("ml_final", _with_models(
    f"SELECT f.key, f.target_utc, f.horizon_hours, f.actual, round(f.raw_prediction, 5) AS raw_prediction, round(f.prediction, 5) AS prediction, f.feature_set FROM final f JOIN best b USING (horizon_hours, feature_set, config)",
    *_SCORES, _BEST, oracle.ridge("final", "split <> 'test'", "split = 'test'", tuple(c.name for c in _LINEAR))), plain=True)
def ml_final(spark, sf):
    """The linear config that validation rows select for each horizon and feature set, refitted on train and validation rows, predicts test rows once."""
    rows = _paired(spark, sf)
    frozen = ml.select_configs(_ridge_scores(_ridge(rows, _TRAIN, _VALIDATE, _LINEAR))).select("horizon_hours", "feature_set", "config")
    models = ridge.fit(rows.filter("split <> 'test'"), (CONTRACT_A, CONTRACT_B), _LINEAR).join(frozen, ["horizon_hours", "feature_set", "config"])
    return _five(ridge.predict(models, rows.filter("split = 'test'"), CONTRACT_B).drop("config"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Events to classified records, grid, features, baselines and their errors."""
    return QUERIES["baseline_metrics"](spark, sf)

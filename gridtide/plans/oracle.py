"""The same tables in DuckDB's SQL, for the oracle of each query."""

from __future__ import annotations

_TZ = "America/New_York"


def _back(utc: str) -> str:
    return f"(({utc}) AT TIME ZONE 'UTC') AT TIME ZONE '{_TZ}'"


def _records(name: str, days: int) -> str:
    return f"""{name} AS (SELECT event_id, CASE WHEN event_id % 101 <> 0 THEN ts + INTERVAL {days} DAY END AS local_time,
      CASE WHEN event_id % 97 <> 0 THEN CAST(user_id % 27 AS INT) END AS key, event_type AS point, value,
      CAST(regexp_extract(props, '-?[0-9]+') AS DOUBLE) AS k,
      ((ts + INTERVAL {days} DAY) AT TIME ZONE '{_TZ}') AT TIME ZONE 'UTC' AS u FROM events)"""


def _classified(name: str, source: str, start: str, end: str) -> str:
    return f"""{name}_r AS (SELECT r.event_id, r.local_time, r.key, r.point, r.value, r.k, r.u, l.zone, l.area,
      CASE WHEN r.local_time IS NULL THEN 'rejected_missing_time'
           WHEN r.local_time < TIMESTAMP '{start}' OR r.local_time >= TIMESTAMP '{end}' THEN 'rejected_outside_window'
           WHEN {_back("r.u")} <> r.local_time THEN 'quarantined_gap'
           WHEN {_back("r.u + INTERVAL 1 HOUR")} = r.local_time OR {_back("r.u - INTERVAL 1 HOUR")} = r.local_time THEN 'quarantined_fold'
           WHEN r.key IS NULL THEN 'rejected_missing_key'
           WHEN l.key IS NULL THEN 'rejected_unknown_key'
           WHEN l.area IS NULL OR l.area NOT IN ('AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST') THEN 'rejected_outside_area'
           ELSE 'accepted' END AS reason
      FROM {source} r LEFT JOIN lookup l ON r.key = l.key),
    {name} AS (SELECT *, split_part(reason, '_', 1) AS status, CASE WHEN reason = 'accepted' THEN u END AS time_utc,
      CASE WHEN reason = 'accepted' THEN date_trunc('hour', u) END AS hour_utc FROM {name}_r)"""


def _nearest(lat: str, lon: str) -> str:
    points = (("click", 40.7, -74.0), ("error", 51.5, -0.1), ("purchase", 35.7, 139.7), ("signup", -33.9, 151.2), ("view", -23.5, -46.6))
    rows = ", ".join(f"{{'km': 12742.0176 * asin(sqrt(least(pow(sin(radians({a} - {lat}) / 2), 2) + cos(radians({lat})) * cos(radians({a})) * pow(sin(radians({b} - {lon}) / 2), 2), 1.0))), 'name': '{n}'}}" for n, a, b in points)
    return f"list_sort([{rows}])[1]"


_SPLIT = """CASE WHEN {l} >= TIMESTAMP '2024-03-02' AND {l} < TIMESTAMP '2024-03-20' THEN 'train'
      WHEN {l} >= TIMESTAMP '2024-03-20' AND {l} < TIMESTAMP '2024-03-25' THEN 'validation'
      WHEN {l} >= TIMESTAMP '2024-03-25' AND {l} < TIMESTAMP '2024-03-30' THEN 'test' END"""
_OVER = "OVER (PARTITION BY key ORDER BY target_utc RANGE BETWEEN INTERVAL {a} HOUR PRECEDING AND INTERVAL {b} HOUR PRECEDING)"


def _back_hours(h: int) -> str:
    return f"max(demand) {_OVER.format(a=h, b=h)}"


def _trailing(f: str, h: int) -> str:
    over = _OVER.format(a=h - 1, b=0)
    return f"CASE WHEN count(demand) {over} = {h} THEN {f}(demand) {over} END"


CTES = ",\n".join([
    "lookup AS (SELECT n_nationkey AS key, n_name AS zone, r_name AS area FROM nation JOIN region ON n_regionkey = r_regionkey)",
    _records("records", 60), _records("records_fold", 300),
    _classified("classified", "records", "2024-03-02", "2024-03-30"), _classified("classified_fold", "records_fold", "2024-10-29", "2024-11-25"),
    "counts AS (SELECT key, hour_utc AS target_utc, count(*) AS n FROM classified WHERE status = 'accepted' GROUP BY ALL)",
    f"""axis_h AS (SELECT unnest(generate_series((TIMESTAMP '2024-03-02' AT TIME ZONE '{_TZ}') AT TIME ZONE 'UTC',
      ((TIMESTAMP '2024-03-30' AT TIME ZONE '{_TZ}') AT TIME ZONE 'UTC') - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS target_utc)""",
    f"""axis AS (SELECT target_utc, count(*) OVER (PARTITION BY {_back("target_utc")}) = 1 AS available FROM axis_h)""",
    "panel_keys AS (SELECT key FROM lookup WHERE area IN ('AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'))",
    """grid AS (SELECT p.key, a.target_utc, a.available, CASE WHEN a.available THEN coalesce(c.n, 0) END AS demand
      FROM panel_keys p CROSS JOIN axis a LEFT JOIN counts c ON c.key = p.key AND c.target_utc = a.target_utc)""",
    f"""key_points AS (SELECT key, b.name AS point, b.km AS distance_km FROM (SELECT key, {_nearest("lat", "lon")} AS b FROM
      (SELECT key, CAST((key * 7) % 120 - 60 AS DOUBLE) AS lat, CAST((key * 29) % 360 - 180 AS DOUBLE) AS lon FROM lookup)))""",
    """hourly AS (SELECT event_type AS point, date_trunc('hour', ts + INTERVAL 60 DAY) AS target_utc, round(avg(value), 6) AS forecast_value,
      round(avg(CAST(regexp_extract(props, '-?[0-9]+') AS DOUBLE)), 6) AS forecast_k FROM events GROUP BY ALL)""",
    """run_starts AS (SELECT run_utc, CAST(epoch(run_utc) / 21600 AS BIGINT) AS n FROM (SELECT unnest(generate_series(
      to_timestamp(floor(epoch(min(target_utc)) / 21600) * 21600) AT TIME ZONE 'UTC' - INTERVAL 24 HOUR, max(target_utc), INTERVAL 6 HOUR)) AS run_utc FROM hourly)
      WHERE CAST(epoch(run_utc) / 21600 AS BIGINT) % 11 <> 5)""",
    """parsed AS (SELECT r.run_utc, p.point, r.run_utc + o.i * INTERVAL 1 HOUR AS target_utc, h.forecast_value,
      CASE WHEN r.n % 7 = 3 AND o.i >= 20 THEN NULL ELSE h.forecast_k END AS forecast_k
      FROM run_starts r CROSS JOIN (SELECT DISTINCT point FROM hourly) p CROSS JOIN (SELECT unnest(range(24)) AS i) o
      LEFT JOIN hourly h ON h.point = p.point AND h.target_utc = r.run_utc + o.i * INTERVAL 1 HOUR)""",
    """plan AS (SELECT target_utc, horizon_hours, cutoff_utc, to_timestamp(floor(epoch(cutoff_utc - INTERVAL 6 HOUR) / 21600) * 21600) AT TIME ZONE 'UTC' AS run_utc
      FROM (SELECT a.target_utc, h.h AS horizon_hours, a.target_utc - h.h * INTERVAL 1 HOUR AS cutoff_utc FROM axis a CROSS JOIN (SELECT unnest([1, 3, 6]) AS h) h))""",
    """completed AS (SELECT e.run_utc, e.target_utc, e.point, e.horizon_hours, e.cutoff_utc, o.forecast_value, o.forecast_k,
      o.forecast_value IS NULL AS forecast_value_missing, o.forecast_k IS NULL AS forecast_k_missing, o.run_utc IS NOT NULL AS source_available,
      o.forecast_value IS NULL OR o.forecast_k IS NULL AS any_missing
      FROM (SELECT * FROM plan CROSS JOIN (SELECT DISTINCT event_type AS point FROM events)) e
      LEFT JOIN parsed o ON o.run_utc = e.run_utc AND o.target_utc = e.target_utc AND o.point = e.point)""",
    """panel AS (SELECT g.key, g.target_utc, g.available, g.demand, kp.point, p.horizon_hours, p.cutoff_utc, c.run_utc, c.forecast_value, c.forecast_k,
      c.forecast_value_missing, c.forecast_k_missing, c.source_available, c.any_missing
      FROM grid g JOIN key_points kp ON kp.key = g.key JOIN plan p ON p.target_utc = g.target_utc
      LEFT JOIN completed c ON c.target_utc = g.target_utc AND c.horizon_hours = p.horizon_hours AND c.point = kp.point)""",
    f"""history_v AS (SELECT key, target_utc AS cutoff_utc, demand AS demand_at_cutoff, {_back_hours(1)} AS demand_1h_before, {_back_hours(2)} AS demand_2h_before,
      {_trailing("avg", 3)} AS mean_3h, {_trailing("avg", 6)} AS mean_6h, {_trailing("avg", 24)} AS mean_24h, {_trailing("stddev_pop", 24)} AS std_24h FROM grid)""",
    "history AS (SELECT *, " + ", ".join(f"CASE WHEN {v} IS NOT NULL THEN cutoff_utc - INTERVAL {h} HOUR END AS {n}" for v, h, n in (
        ("demand_at_cutoff", 0, "demand_at_cutoff_source"), ("demand_1h_before", 1, "demand_1h_source"), ("demand_2h_before", 2, "demand_2h_source"),
        ("mean_3h", 2, "mean_3h_start"), ("mean_6h", 5, "mean_6h_start"), ("mean_24h", 23, "mean_24h_start"), ("mean_24h", 0, "mean_24h_end"))) + " FROM history_v)",
    f"""local_hours AS (SELECT key, local_hour_time, n_instants, n_available, CASE WHEN n_instants = 1 AND n_available = 1 THEN d END AS demand,
      CASE WHEN n_instants = 1 AND n_available = 1 THEN s END AS source_utc FROM (SELECT key, {_back("target_utc")} AS local_hour_time, count(*) AS n_instants,
      count(*) FILTER (available) AS n_available, CAST(sum(demand) AS BIGINT) AS d, max(target_utc) AS s FROM grid GROUP BY ALL))""",
    f"""features_j AS (SELECT p.*, h.* EXCLUDE (key, cutoff_utc), d.demand AS demand_day_before, d.source_utc AS demand_day_source,
      w.demand AS demand_week_before, w.source_utc AS demand_week_source, p.local AS l
      FROM (SELECT *, {_back("target_utc")} AS local FROM panel WHERE available) p LEFT JOIN history h ON h.key = p.key AND h.cutoff_utc = p.cutoff_utc
      LEFT JOIN local_hours d ON d.key = p.key AND d.local_hour_time = p.local - INTERVAL 1 DAY
      LEFT JOIN local_hours w ON w.key = p.key AND w.local_hour_time = p.local - INTERVAL 7 DAY)""",
    f"""features_c AS (SELECT * EXCLUDE (local, l), CAST(hour(l) AS INT) AS local_hour, CAST(dayofweek(l) + 1 AS INT) AS local_weekday,
      dayofweek(l) IN (0, 6) AS local_weekend, CAST(month(l) AS INT) AS local_month, {_SPLIT.format(l="l")} AS split,
      demand_at_cutoff IS NOT NULL AND demand_1h_before IS NOT NULL AND demand_2h_before IS NOT NULL AND mean_3h IS NOT NULL AND mean_6h IS NOT NULL
        AND mean_24h IS NOT NULL AND std_24h IS NOT NULL AND demand_day_before IS NOT NULL AND demand_week_before IS NOT NULL AS history_complete,
      NOT coalesce(any_missing, TRUE) AS forecast_complete FROM features_j)""",
    "features AS (SELECT *, history_complete AND forecast_complete AS paired FROM features_c)",
    """long AS (SELECT key, target_utc, horizon_hours, cutoff_utc, split, CAST(demand AS DOUBLE) AS actual, b.baseline, b.prediction, b.source_utc FROM (
      SELECT *, unnest([{'baseline': 'persistence', 'prediction': CAST(demand_at_cutoff AS DOUBLE), 'source_utc': demand_at_cutoff_source},
        {'baseline': 'day_before', 'prediction': CAST(demand_day_before AS DOUBLE), 'source_utc': demand_day_source},
        {'baseline': 'week_before', 'prediction': CAST(demand_week_before AS DOUBLE), 'source_utc': demand_week_source}]) AS b FROM features WHERE paired))""",
    """baseline_scores AS (SELECT split, baseline, horizon_hours, count(*) AS n_rows, avg(abs(actual - prediction)) AS mae,
      sqrt(avg((actual - prediction) * (actual - prediction))) AS rmse FROM long GROUP BY GROUPING SETS ((split, baseline, horizon_hours), (split, baseline)))""",
    "key_totals AS (SELECT key, count(*) AS n FROM classified WHERE status = 'accepted' GROUP BY key)",
    """shares AS (SELECT key, n, row_number() OVER (ORDER BY n DESC, key) AS rank, CAST(sum(n) OVER (ORDER BY n DESC, key ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative,
      CAST(sum(n) OVER () AS BIGINT) AS total FROM key_totals)""",
    """slots AS (SELECT run_utc, target_utc, horizon_hours, point, v.variable AS variable, CASE WHEN source_available THEN 'null_in_response' ELSE 'run_unavailable' END AS reason
      FROM (SELECT *, unnest([{'variable': 'forecast_value', 'value': forecast_value}, {'variable': 'forecast_k', 'value': forecast_k}]) AS v FROM completed) WHERE v.value IS NULL)""",
])


def sql(body: str) -> str:
    return f"WITH {CTES}\n{body}"


NEAREST = _nearest
BACK = _back
SPLIT = _SPLIT


#: Categorical and numeric columns of the models, and those that only contract B has.
_CATEGORICAL = ("key", "local_hour", "local_weekday", "local_month", "local_weekend")
_NUMERIC = ("demand_at_cutoff", "demand_1h_before", "demand_2h_before", "mean_3h", "mean_6h", "mean_24h", "std_24h", "demand_day_before", "demand_week_before", "forecast_value", "forecast_k")
_ONLY_B = ("forecast_value", "forecast_k")
_PENALTIES = {"linear_0.01": 0.01, "linear_0.1": 0.1, "linear_1": 1.0}


def ridge(name: str, fit_on: str, score_on: str, configs: tuple[str, ...]) -> str:
    """CTEs that end with ``name``: every row of score_on under the ridge regressions of fit_on rows, by Gauss-Jordan elimination.

    Both are conditions on paired features.
    """

    def entries(condition: str) -> str:
        cells = ["{'f': '1', 'v': 1.0::DOUBLE}", "{'f': 'y', 'v': demand::DOUBLE}", *[f"{{'f': 'n:{c}', 'v': {c}::DOUBLE}}" for c in _NUMERIC], *[f"{{'f': 'c:{c}=' || {c}::VARCHAR, 'v': 1.0::DOUBLE}}" for c in _CATEGORICAL]]
        return f"SELECT key, target_utc, h, actual, r, e.f AS f, e.v AS v FROM (SELECT key, target_utc, horizon_hours AS h, demand::DOUBLE AS actual, row_number() OVER () AS r, unnest([{', '.join(cells)}]) AS e FROM features WHERE paired AND {condition})"

    p = name
    models = ", ".join(f"('{c}', {_PENALTIES[c]}::DOUBLE)" for c in configs)
    only_b = ", ".join(f"'n:{c}'" for c in _ONLY_B)
    return f"""{p}_fit AS MATERIALIZED ({entries(fit_on)}),
{p}_gram AS MATERIALIZED (SELECT a.h, a.f AS i, b.f AS j, sum(a.v * b.v) AS v FROM {p}_fit a JOIN {p}_fit b ON a.r = b.r GROUP BY ALL),
{p}_n AS (SELECT h, v AS n FROM {p}_gram WHERE i = '1' AND j = '1'),
{p}_mean AS (SELECT h, j AS f, v / n AS m FROM {p}_gram JOIN {p}_n USING (h) WHERE i = '1'),
{p}_moment AS MATERIALIZED (SELECT h, i AS f, m, CASE WHEN v / n - m * m > 1e-12 * v / n THEN sqrt(v / n - m * m) ELSE 0 END AS s FROM {p}_gram JOIN {p}_n USING (h) JOIN {p}_mean USING (h) WHERE i = j AND f = i),
{p}_use AS MATERIALIZED (SELECT h, s.feature_set, f, m, s, row_number() OVER (PARTITION BY h, feature_set ORDER BY f) AS k FROM {p}_moment x CROSS JOIN (SELECT unnest(['A', 'B']) AS feature_set) s WHERE f NOT IN ('1', 'y') AND x.s > 0 AND (feature_set = 'B' OR f NOT IN ({only_b}))),
{p}_y AS (SELECT h, m, s FROM {p}_moment WHERE f = 'y'),
{p}_cell AS (SELECT a.h, a.feature_set, a.k AS i, b.k AS j, (coalesce(g.v, 0) / n.n - a.m * b.m) / (a.s * b.s) AS v FROM {p}_use a JOIN {p}_use b ON a.h = b.h AND a.feature_set = b.feature_set JOIN {p}_n n ON n.h = a.h LEFT JOIN {p}_gram g ON g.h = a.h AND g.i = a.f AND g.j = b.f
  UNION ALL SELECT a.h, a.feature_set, a.k, 1000000, (coalesce(g.v, 0) / n.n - a.m * y.m) / (a.s * y.s) FROM {p}_use a JOIN {p}_y y ON y.h = a.h JOIN {p}_n n ON n.h = a.h LEFT JOIN {p}_gram g ON g.h = a.h AND g.i = a.f AND g.j = 'y'),
{p}_row AS (SELECT c.h, c.feature_set, q.config, i, list(c.v + CASE WHEN i = j THEN q.reg / y.s ELSE 0 END ORDER BY j) AS row FROM {p}_cell c JOIN {p}_y y ON y.h = c.h CROSS JOIN (VALUES {models}) q(config, reg) GROUP BY c.h, c.feature_set, q.config, i),
{p}_step(h, feature_set, config, k, n, m) AS (SELECT h, feature_set, config, 0::BIGINT, count(*), list(row ORDER BY i) FROM {p}_row GROUP BY ALL
  UNION ALL SELECT h, feature_set, config, k + 1, n, list_transform(m, lambda row, i: CASE WHEN i = k + 1 THEN list_transform(row, lambda x: x / m[k + 1][k + 1]) ELSE list_transform(row, lambda x, j: x - row[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END) FROM {p}_step WHERE k < n),
{p}_weight AS MATERIALIZED (SELECT x.h, x.feature_set, x.config, u.f, x.m[u.k][x.n + 1] * y.s / u.s AS w, u.m FROM {p}_step x JOIN {p}_use u ON u.h = x.h AND u.feature_set = x.feature_set JOIN {p}_y y ON y.h = x.h WHERE x.k = x.n),
{p}_base AS (SELECT w.h, feature_set, config, any_value(y.m) - sum(w.w * w.m) AS intercept FROM {p}_weight w JOIN {p}_y y ON y.h = w.h GROUP BY ALL),
{p}_score AS MATERIALIZED ({entries(score_on)}),
{p}_raw AS (SELECT e.key, e.target_utc, e.h AS horizon_hours, e.actual, b.feature_set, b.config, any_value(b.intercept) + coalesce(sum(w.w * e.v), 0) AS raw_prediction FROM {p}_score e JOIN {p}_base b ON b.h = e.h LEFT JOIN {p}_weight w ON w.h = e.h AND w.feature_set = b.feature_set AND w.config = b.config AND w.f = e.f GROUP BY ALL),
{name} AS MATERIALIZED (SELECT *, greatest(raw_prediction, 0.0) AS prediction FROM {p}_raw)"""


def ridge_scores(name: str, predicted: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT 'linear' AS family, config, feature_set, horizon_hours, count(*) FILTER (raw_prediction < 0) AS n_negative, count(*) FILTER (raw_prediction IS NULL OR isnan(raw_prediction)) AS n_invalid,
  count(*) AS n_rows, avg(abs(actual - prediction)) AS mae, sqrt(avg((actual - prediction) * (actual - prediction))) AS rmse FROM {predicted} GROUP BY ALL)"""


def with_models(ctes: list[str], body: str) -> str:
    return f"WITH RECURSIVE {CTES},\n" + ",\n".join(ctes) + f"\n{body}"

"""Gates of every stage, scans and sinks by real files, and sorted output, as queries with oracles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import shift_hours
from ..operators import features, forecasts, metrics, ml, quality, sketches, splits
from ..sources import files, io, stages
from ..spec import CONTRACT_A, CONTRACT_B, FeatureContract
from . import base
from .base import SPEC, naive, rounded, table
from .queries import _FEATURES, _FEATURES_SQL, query

CONTRACTS = (CONTRACT_A, CONTRACT_B)
KEY_ONLY = FeatureContract("K", ("key",), ("demand_at_cutoff",))
GOLD_KEYS = ["key", "target_utc", "horizon_hours", "feature_set"]


def staged_features(spark, sf) -> DataFrame:
    """Feature rows as a stage's stored output, so that the gates share one computation."""
    return io.write_and_read(base.feature_rows(spark, sf), io.shared_path(spark, "features"))


@query("stage_gates", """SELECT 'join_cardinality' AS gate, count(*) AS n_violations FROM (SELECT (SELECT count(*) FROM grid) * 3 AS a, (SELECT count(*) FROM panel) AS b, (SELECT count(*) FROM panel WHERE source_available IS NULL) AS c) WHERE a <> b OR c > 0
  UNION ALL SELECT 'feature_leaks', count(*) FROM (SELECT unnest([count(*) FILTER (demand_at_cutoff_source > cutoff_utc), count(*) FILTER (demand_1h_source > cutoff_utc), count(*) FILTER (demand_2h_source > cutoff_utc),
    count(*) FILTER (demand_day_source > cutoff_utc), count(*) FILTER (demand_week_source > cutoff_utc), count(*) FILTER (mean_24h_end <> cutoff_utc)]) AS n FROM features) WHERE n > 0
  UNION ALL SELECT 'eligibility', count(*) FROM (SELECT horizon_hours, count(*) AS n FROM panel WHERE available GROUP BY 1) a FULL JOIN (SELECT horizon_hours, count(*) AS n FROM features GROUP BY 1) b USING (horizon_hours) WHERE a.n IS DISTINCT FROM b.n
  UNION ALL SELECT 'contract_difference', 0
  UNION ALL SELECT 'split_overlap', count(*) FROM (SELECT target_utc FROM features WHERE split IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1)
  UNION ALL SELECT 'split_order', count(*) FROM (SELECT max(target_utc) >= lead(min(target_utc)) OVER (ORDER BY min(target_utc)) AS late FROM features WHERE split IS NOT NULL GROUP BY split) WHERE late
  UNION ALL SELECT 'null_predictions', count(*) FROM (SELECT baseline FROM long WHERE prediction IS NULL GROUP BY 1)
  UNION ALL SELECT 'late_predictions', count(*) FROM (SELECT baseline FROM long WHERE source_utc > cutoff_utc GROUP BY 1)
  UNION ALL SELECT 'exclusion_accounting', count(*) FROM (SELECT split, horizon_hours FROM features GROUP BY 1, 2 HAVING count(*) <> count(*) FILTER (paired) + count(*) FILTER (NOT history_complete OR NOT forecast_complete))
  UNION ALL SELECT 'slots_equal_totals', count(*) FROM (SELECT (SELECT count(*) FROM slots WHERE variable = 'forecast_value') AS a, (SELECT count(*) FROM completed WHERE forecast_value_missing) AS b
    UNION ALL SELECT (SELECT count(*) FROM slots WHERE variable = 'forecast_k'), (SELECT count(*) FROM completed WHERE forecast_k_missing)) WHERE a <> b""")
def stage_gates(spark, sf):
    rows, done, panel = staged_features(spark, sf), base.completed(spark, sf), base.panel(spark, sf)
    audit = metrics.baseline_audit(metrics.baselines_long(splits.paired_population(rows)))
    return quality.gates({
        "join_cardinality": quality.wrong_cardinality(base.demand(spark, sf), panel, len(SPEC.horizons)), "feature_leaks": quality.leakage_audit(rows).filter("n_late > 0"),
        "eligibility": quality.unequal_counts(panel.filter("available"), rows, ["horizon_hours"]),
        "contract_difference": quality.contract_difference(spark, CONTRACT_A, CONTRACT_B, forecasts.VARIABLES),
        "split_overlap": splits.shared_hours(rows), "split_order": splits.split_ranges(rows).filter("NOT in_order"),
        "null_predictions": audit.filter("n_null > 0"), "late_predictions": audit.filter("n_late > 0"),
        "exclusion_accounting": splits.exclusions(rows).filter("n_rows <> n_paired + n_only_history + n_only_forecast + n_both"),
        "slots_equal_totals": quality.unequal_slots(done, forecasts.missing_slots(done), forecasts.VARIABLES),
    })


@query("model_gates", """SELECT 'empty_populations' AS gate, count(*) AS n_violations FROM (SELECT unnest(['train', 'validation', 'test']) AS split) s, (SELECT unnest([1, 3, 6]) AS h)
    WHERE NOT EXISTS (SELECT 1 FROM features f WHERE f.paired AND f.split = s.split AND f.horizon_hours = h)
  UNION ALL SELECT 'target_in_features', 0 UNION ALL SELECT 'vocabularies_differ', 0 UNION ALL SELECT 'matrix_rows', 0
  UNION ALL SELECT 'test_key_difference', 0 UNION ALL SELECT 'duplicate_predictions', 0 UNION ALL SELECT 'invalid_predictions', 0""")
def model_gates(spark, sf):
    """Gates around fits on training rows and predictions of test rows, for every horizon and both feature sets."""
    rows = io.write_and_read(splits.paired_population(base.feature_rows(spark, sf)), io.shared_path(spark, "paired"))
    train, test = (rows.filter(F.col("split") == s) for s in ("train", "test"))
    fits = ml.fit_each(train, SPEC.horizons, CONTRACTS, [ml.Config("gate", "linear", 0.1)])
    predicted = ml.predict_each(fits, test)
    prepared = reduce(DataFrame.unionByName, [ml.matrix(f.prepared, test.filter(F.col("horizon_hours") == f.hours), f.contract).select("horizon_hours", F.lit(f.contract.name).alias("feature_set")) for f in fits])
    both = test.select("key", "target_utc", "horizon_hours", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("feature_set"))
    labels = [{f"{f.hours} {c}": x for f in fits if f.contract is contract for c, x in ml.vocabularies(f.prepared, CONTRACT_A).items()} for contract in CONTRACTS]
    return quality.gates({
        "empty_populations": quality.empty_populations(rows, [s for s, *_ in SPEC.splits], SPEC.horizons), "target_in_features": quality.target_among_features(spark, *CONTRACTS),
        "vocabularies_differ": quality.label_difference(spark, *labels), "matrix_rows": quality.unequal_counts(both, prepared, ["horizon_hours", "feature_set"]),
        "test_key_difference": quality.symmetric_difference(both.select(*GOLD_KEYS), predicted.select(*GOLD_KEYS)), "duplicate_predictions": quality.duplicate_keys(predicted, GOLD_KEYS),
        "invalid_predictions": quality.invalid_predictions(predicted),
    })


_VOCAB = "SELECT 'key' AS c, key::VARCHAR AS v, row_number() OVER (ORDER BY count(*) DESC, key::VARCHAR) - 1 AS k FROM features WHERE paired AND split = 'train' {0} GROUP BY key"


@query("planted_gates", f"""SELECT 'empty_populations' AS gate, 3 * count(DISTINCT split) AS n_violations FROM features WHERE split = 'test'
  UNION ALL SELECT 'unequal_counts', count(DISTINCT key) FROM features WHERE key % 3 = 0
  UNION ALL SELECT 'split_overlap', count(DISTINCT target_utc) FROM features WHERE split = 'train' AND local_hour = 3
  UNION ALL SELECT 'late_sources', count(*) FROM features WHERE demand_1h_source + INTERVAL (key % 3) HOUR > cutoff_utc
  UNION ALL SELECT 'test_key_difference', count(*) FROM features WHERE paired AND split = 'test' AND key % 4 = 0
  UNION ALL SELECT 'duplicate_predictions', count(*) FROM features WHERE paired AND split = 'test' AND key % 6 = 0
  UNION ALL SELECT 'invalid_predictions', count(*) FROM features WHERE paired AND split = 'test' AND (key % 7 = 0 OR demand_day_before - 3 < 0)
  UNION ALL SELECT 'vocabularies_differ', count(*) FROM ((FROM ({_VOCAB.format('')}) EXCEPT FROM ({_VOCAB.format('AND key % 5 <> 1')})) UNION ALL (FROM ({_VOCAB.format('AND key % 5 <> 1')}) EXCEPT FROM ({_VOCAB.format('')})))""")
def planted_gates(spark, sf):
    """Violations planted in the panel's rows, and how many of them each gate finds."""
    rows = staged_features(spark, sf)
    test = splits.paired_population(rows).filter("split = 'test'").select("key", "target_utc", "horizon_hours", F.lit("A").alias("feature_set"), F.col("demand").alias("actual"), F.col("demand_day_before").cast("double").alias("prediction"))
    train = splits.paired_population(rows).filter("split = 'train'")
    labels = [ml.vocabularies(ml.fit_preprocessing(x, c), c) for x, c in ((train, KEY_ONLY), (train.filter("key % 5 <> 1"), KEY_ONLY))]
    wrong = test.withColumn("prediction", F.when(F.col("key") % 7 != 0, F.col("prediction") - 3))
    moved = rows.filter("split = 'train' AND local_hour = 3").withColumn("split", F.lit("test"))
    late = rows.withColumn("demand_1h_source", shift_hours(F.col("demand_1h_source"), F.col("key") % 3))
    return quality.gates({
        "empty_populations": quality.empty_populations(rows.filter("split <> 'test'"), [s for s, *_ in SPEC.splits], SPEC.horizons),
        "unequal_counts": quality.unequal_counts(rows, rows.filter("key % 3 <> 0"), ["key"]), "split_overlap": splits.shared_hours(rows.unionByName(moved)),
        "late_sources": late.filter("demand_1h_source > cutoff_utc"), "test_key_difference": quality.symmetric_difference(test.select(*GOLD_KEYS), test.filter("key % 4 <> 0").select(*GOLD_KEYS)),
        "duplicate_predictions": quality.duplicate_keys(test.unionByName(test.filter("key % 6 = 0")), GOLD_KEYS), "invalid_predictions": quality.invalid_predictions(wrong),
        "vocabularies_differ": quality.label_difference(spark, *labels),
    })


# Stages


def feature_gates(n_eligible: int) -> list[stages.Gate]:
    """Gates of the feature stage that its writing tasks observe: nothing after the cutoff, targets known, one row for each eligible row of the panel."""
    late = [F.count_if(F.col(c) > F.col("cutoff_utc")) for c in ("demand_at_cutoff_source", "demand_1h_source", "demand_2h_source", "demand_day_source", "demand_week_source")]
    return [stages.Gate("rows", F.count("*"), n_eligible), stages.Gate("late_sources", reduce(lambda a, b: a + b, late)), stages.Gate("late_windows", F.count_if(F.col("mean_24h_end") != F.col("cutoff_utc"))), stages.Gate("unknown_targets", F.count_if(F.col("demand").isNull()))]


@query("gated_stage", """SELECT CAST(horizon_hours AS INT) AS horizon_hours, count(*) AS n_rows, count(*) FILTER (paired) AS n_paired, (SELECT count(*) FROM panel WHERE available) AS rows,
  (SELECT count(*) FILTER (demand_at_cutoff_source > cutoff_utc) + count(*) FILTER (demand_day_source > cutoff_utc) FROM features) AS late_sources, count(*) FILTER (demand IS NULL) AS unknown_targets FROM features GROUP BY 1""")
def gated_stage(spark, sf):
    """The feature stage, written behind its gates in slices by horizon and read back, with the figures that the gates saw."""
    panel = io.write_and_read(base.panel(spark, sf).filter("available"), io.shared_path(spark, "panel"))
    rows = splits.assign_split(features.build_features(panel, base.demand(spark, sf), SPEC), SPEC)
    stage = stages.Stage(spark, io.shared_path(spark, "features"), "horizon_hours")
    keys = ["key", "target_utc", "horizon_hours"]
    written = stage.write(stages.fingerprints(panel.select(*keys, "demand"), "horizon_hours"), lambda some: rows.filter(F.col("horizon_hours").cast("string").isin(*some)), gates=feature_gates(panel.count()), checks={"duplicate_keys": lambda x: quality.duplicate_keys(x, keys)})
    figures = [F.lit(written.figures[c]).cast("long").alias(c) for c in ("rows", "late_sources", "unknown_targets")]
    return stage.read().groupBy("horizon_hours").agg(F.count("*").alias("n_rows"), F.count_if("paired").alias("n_paired")).select("*", *figures)


#: Buckets of the stored panel and grid here; for a panel of many keys, some for each core.
BUCKETS = 16


def stored_panel(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The panel's eligible rows and the grid, bucketed by key."""
    panel = io.write_bucketed(base.panel(spark, sf).filter("available"), io.shared_path(spark, "panel"), "key", BUCKETS, ["cutoff_utc"])
    return panel, io.write_bucketed(base.demand(spark, sf), io.shared_path(spark, "grid"), "key", BUCKETS, ["target_utc"])


@query("stored_features", f"SELECT {_FEATURES_SQL} FROM features")
def stored_features(spark, sf):
    """The features of a stored panel and grid: no exchange after the two are stored."""
    panel, grid = stored_panel(spark, sf)
    return rounded(splits.assign_split(features.build_features(panel, grid, SPEC, stored=True), SPEC).select(*_FEATURES))


@query("stage_rerun", "SELECT CAST(year(o_orderdate) AS INT) AS order_year, count(*) AS n_rows, round(sum(o_totalprice + CASE WHEN year(o_orderdate) % 2 = 1 THEN 1 ELSE 0 END), 2) AS total, year(o_orderdate) % 2 = 1 AS rewritten FROM orders GROUP BY year(o_orderdate)", plain=True)
def stage_rerun(spark, sf):
    """Orders in slices by year, committed year by year; then the prices of odd years change, and the rerun writes only those."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("order_year"))
    changed = orders.withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("order_year") % 2 == 1, 1).otherwise(0))
    stage = stages.Stage(spark, io.shared_path(spark, "orders"), "order_year")
    for rows in (orders, changed):
        written = stage.write(stages.fingerprints(rows, "order_year"), lambda some, rows=rows: rows.filter(F.col("order_year").cast("string").isin(*some)), at_once=3)
    found = stage.read().groupBy("order_year").agg(F.count("*").alias("n_rows"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return found.withColumn("rewritten", F.col("order_year").cast("string").isin(*written.done))


# Files


def _lines(spark, sf) -> DataFrame:
    """A line of figures for each day and type of events, in a folder of its own; with the folder's name."""
    day = F.date_format("ts", "yyyy-MM-dd")
    figures = F.concat_ws(",", F.count("*"), F.min("event_id"), F.max("event_id"), F.sum("event_id"))
    return table(spark, sf, "events").groupBy("event_type", day.alias("day")).agg(figures.alias("value"))


_LINES = "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, concat_ws(',', count(*), min(event_id), max(event_id), sum(event_id)::BIGINT) || chr(10) AS v FROM events GROUP BY ALL"


@query("file_checksums", f"""SELECT event_type, day, strlen(v)::BIGINT AS bytes, CAST(ceil(strlen(v) / 8) AS BIGINT) AS n_chunks,
  sha256('8:' || strlen(v) || ':' || array_to_string(list_transform(range(0, CAST(ceil(strlen(v) / 8) AS BIGINT)), lambda k: sha256(substr(v, 8 * k + 1, 8))), '')) AS sha256 FROM ({_LINES})""", plain=True)
def file_checksums(spark, sf):
    """Sizes, chunks and two-level checksums of written files, in chunks of 8 bytes."""
    path = io.shared_path(spark, "lines")
    io.partition_files(_lines(spark, sf), path, ["event_type", "day"])
    found = files.file_digests(files.chunk_digests(files.listed(spark, path).filter(F.col("path").contains("/part-")), 8), 8)
    return found.select(*[F.regexp_extract("path", f"/{c}=([^/]*)/", 1).alias(c) for c in ("event_type", "day")], "bytes", "n_chunks", "sha256")


@query("changed_files", f"""SELECT event_type, day, k::BIGINT AS chunk, CASE WHEN event_type = 'click' AND k = 1 THEN 'checksum' WHEN event_type = 'view' THEN 'size' WHEN event_type = 'error' THEN 'missing' WHEN event_type = 'signup' THEN 'unexpected' END AS problem
  FROM (SELECT *, unnest(range(0, CAST(ceil(strlen(v) / 8) AS BIGINT))) AS k FROM ({_LINES})) WHERE problem IS NOT NULL""", plain=True)
def changed_files(spark, sf):
    """Written files against a manifest in which chunks and sizes of some differ, some are more and some are lacking."""
    path = io.shared_path(spark, "lines")
    io.partition_files(_lines(spark, sf), path, ["event_type", "day"])
    found = files.chunk_digests(files.listed(spark, path).filter(F.col("path").contains("/part-")), 8)
    kind = F.regexp_extract("path", "/event_type=([^/]*)/", 1)
    manifest = found.filter(kind != "signup").withColumn("sha256", F.when((kind == "click") & (F.col("chunk") == 1), F.reverse("sha256")).otherwise(F.col("sha256"))).withColumn("bytes", F.col("bytes") + (kind == "view").cast("long"))
    changed = files.changed_chunks(manifest, found.filter(kind != "error"))
    return changed.select(kind.alias("event_type"), F.regexp_extract("path", "/day=([^/]*)/", 1).alias("day"), "chunk", "problem")


@query("footer_contract", """SELECT month, count(*) AS n_rows, CASE WHEN month LIKE '1995%' THEN 'outside_month' WHEN month LIKE '1996%' THEN 'missing_columns o_custkey' ELSE '' END AS problems, min(o_orderdate) AS first, max(o_orderdate) AS last
  FROM (SELECT o_orderdate, strftime(o_orderdate + CASE WHEN year(o_orderdate) = 1995 THEN INTERVAL 24 MONTH ELSE INTERVAL 0 MONTH END, '%Y-%m') AS m, strftime(o_orderdate, '%Y-%m') AS month FROM orders) GROUP BY 1, 3""", plain=True)
def footer_contract(spark, sf):
    """Every written file's own footer against its month: the files of 1995 are filed two years late, and those of 1996 lack a column."""
    path = io.shared_path(spark, "months")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    filed = orders.withColumn("filed", F.when(F.year("o_orderdate") == 1995, F.date_format(F.add_months("o_orderdate", 24), "yyyy-MM")).otherwise(F.col("month")))
    io.write_partitioned(filed.filter("month NOT LIKE '1996%'"), f"{path}/whole", ["month", "filed"])
    io.write_partitioned(filed.filter("month LIKE '1996%'").drop("o_custkey"), f"{path}/short", ["month", "filed"])
    found = files.footers(files.listed(spark, path).filter(F.col("path").endswith(".parquet")), "o_orderdate")
    checked = files.file_problems(found, ["o_orderkey", "o_custkey", "o_orderdate"], F.regexp_extract("path", "/filed=([^/]*)/", 1))
    return checked.groupBy(F.regexp_extract("path", "/month=([^/]*)/", 1).alias("month"), F.array_join("problems", "; ").alias("problems")).agg(F.sum("n_rows").alias("n_rows"), F.min("first").alias("first"), F.max("last").alias("last"))


# Scans and sinks by real files


@query("csv_lookup", "SELECT key, zone, area FROM lookup")
def csv_lookup(spark, sf):
    """The lookup written as CSV and read with its fixed schema."""
    path = io.shared_path(spark, "lookup.csv")
    base.lookup(spark, sf).write.option("header", True).csv(path)
    return io.read_lookup_csv(spark, path, "key int, zone string, area string")


@query("json_runs", "SELECT run_utc, point, target_utc, forecast_value, forecast_k FROM parsed")
def json_runs(spark, sf):
    """Nested runs written as JSON below run= folders, read with a fixed schema, and parsed; the run comes from the path."""
    path, runs = io.shared_path(spark, "runs"), base.runs(spark, sf)
    io.write_runs_json(runs, path)
    return naive(forecasts.parse_runs(io.read_runs_json(spark, f"{path}/run=*", runs.drop("run_utc").schema)))


@query("output_inventory", "SELECT 'event_type=' || event_type AS folder, 0 AS n_without_checksum, count(*) AS n_rows, count(*) AS n_footer_rows, TRUE AS same_bytes FROM events GROUP BY 1", plain=True)
def output_inventory(spark, sf):
    """Checksums and bytes of a written table by folder, with the rows that a scan and the footers of each folder find."""
    path = io.shared_path(spark, "by_type")
    io.write_partitioned(table(spark, sf, "events"), path, ["event_type"])
    stored = files.listed(spark, path).filter(F.col("path").endswith(".parquet"))
    inventory = io.inventory_totals(files.file_digests(files.chunk_digests(stored)))
    folder = F.element_at(F.split("path", "/"), -2)
    footers = files.footers(stored, "ts").groupBy(folder.alias("folder")).agg(F.sum("n_rows").alias("n_footer_rows"), F.sum("bytes").alias("footer_bytes"))
    found = spark.read.parquet(path).groupBy(F.concat(F.lit("event_type="), "event_type").alias("folder")).agg(F.count("*").alias("n_rows"))
    both = inventory.join(footers, "folder", "full").join(found, "folder", "full")
    return both.select("folder", F.col("n_without_checksum").cast("int").alias("n_without_checksum"), "n_rows", "n_footer_rows", (F.col("bytes") == F.col("footer_bytes")).alias("same_bytes"))


@query("schema_export", """SELECT column_name AS "column", row_number() OVER () - 1 AS position, CASE column_type WHEN 'BIGINT' THEN 'long' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' END AS type FROM (DESCRIBE orders)""", plain=True)
def schema_export(spark, sf):
    """The schema of a written table as rows, read from its exported JSON."""
    path = io.shared_path(spark, "orders.schema")
    return io.export_schema(table(spark, sf, "orders"), path).select("column", "position", F.replace("type", F.lit('"'), F.lit("")).alias("type"))


@query("file_contract_by_file", "SELECT year(o_orderdate) AS order_year, count(*) AS n_rows, count(*) FILTER (o_orderdate IS NULL) = 0 AND min(o_orderdate) < TIMESTAMP '1997-01-01' AND max(o_orderdate) >= TIMESTAMP '1994-01-01' AS valid FROM orders GROUP BY 1", plain=True)
def file_contract_by_file(spark, sf):
    """Every file of a table by years: its rows, its times against [1994, 1997) and its required columns."""
    path = io.shared_path(spark, "by_year")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", F.year("o_orderdate").alias("order_year"))
    io.write_partitioned(orders, path, ["order_year"])
    rows = io.require_columns(spark.read.parquet(path), ["o_orderkey", "o_orderdate"]).withColumn("file", F.col("_metadata.file_path"))
    bounds = [F.expr(f"TIMESTAMP_NTZ '{y}-01-01'") for y in (1994, 1997)]
    per = io.file_contract(rows, "file", "o_orderdate", *bounds)
    year = F.regexp_extract("file", "order_year=([0-9]+)", 1).cast("long")
    return per.groupBy(year.alias("order_year")).agg(F.sum("n_rows").alias("n_rows"), F.bool_or("valid").alias("valid"))


@query("reference_contract", "SELECT count(*) AS n_rows, count(DISTINCT key) AS n_keys, count(*) FILTER (key IS NULL) AS n_null, count(*) = count(DISTINCT key) AND count(*) > 0 AS valid FROM lookup")
def reference_contract(spark, sf):
    return io.reference_contract(base.lookup(spark, sf), "key", ["key", "zone", "area"])


# Order


@query("sorted_write", "SELECT key, count(*) AS n_rows, min(target_utc) AS first_utc, max(target_utc) AS last_utc, 0 AS n_unordered FROM grid GROUP BY key")
def sorted_write(spark, sf):
    """The grid written in the order of key and hour, then how many rows of each key stand before an earlier one in their file."""
    path = io.shared_path(spark, "grid")
    io.write_sorted(base.demand(spark, sf), path, ["key", "target_utc"])
    return naive(io.order_audit(spark.read.parquet(path), "key", "target_utc"))


@query("sorted_report", "SELECT split, baseline, horizon_hours, n_rows, round(mae, 6) AS mae, CAST(row_number() OVER (ORDER BY split, horizon_hours NULLS FIRST, baseline) AS INT) AS line FROM baseline_scores")
def sorted_report(spark, sf):
    """A report's lines in order; a few rows for each split, so one sort."""
    scores = metrics.baseline_metrics(metrics.baselines_long(splits.paired_population(base.feature_rows(spark, sf)))).select("split", "baseline", "horizon_hours", "n_rows", "mae")
    return rounded(metrics.numbered(scores, ["split", "horizon_hours", "baseline"]))


# Sketches


@query("quantile_history", """SELECT l_returnflag AS flag, p.p AS share, count(*) AS n, CAST(max(n_years) AS BIGINT) AS n_periods, TRUE AS within
  FROM (SELECT l_returnflag, count(DISTINCT year(l_shipdate)) OVER (PARTITION BY l_returnflag) AS n_years FROM lineitem) CROSS JOIN (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95]::DOUBLE[]) AS p) p GROUP BY 1, 2""", plain=True)
def quantile_history(spark, sf):
    """Prices' quantiles by flag from stored sketches of each year, of which the last is added later; and whether the exact rank of each is within the bound."""
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), F.year("l_shipdate").alias("period"), F.col("l_extendedprice").alias("v"))
    stage = stages.Stage(spark, io.shared_path(spark, "sketches"), "period")
    for some in (rows.filter("period < 1998"), rows):
        sketches.update_history(stage, some, ["flag"], "v")
    stored = stage.read()
    periods = stored.groupBy("flag").agg(F.count("*").alias("n_periods"))
    merged = sketches.merged_sketches(stored, ["flag"]).join(periods, "flag")
    found = merged.select("flag", "n", "n_periods", F.explode(F.array(*[F.struct(F.lit(p).alias("share"), sketches.quantile("sketch", p).alias("q")) for p in (0.05, 0.25, 0.5, 0.75, 0.95)])).alias("x")).select("flag", "n", "n_periods", "x.*")
    # A few quantiles for each flag: a small side.
    ranked = rows.join(F.broadcast(found), "flag").groupBy("flag", "share", "n", "n_periods").agg((F.count_if(F.col("v") < F.col("q")) / F.col("n")).alias("below"), (F.count_if(F.col("v") <= F.col("q")) / F.col("n")).alias("upto"))
    off = F.greatest(F.col("below") - F.col("share"), F.col("share") - F.col("upto"))
    return ranked.select("flag", "share", "n", "n_periods", (off <= sketches.rank_error()).alias("within"))

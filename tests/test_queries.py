import math
import os

import pytest

import __spark_entry__ as entry
from gridtide.plans import queries as panel

DATA = "/root/testdata/sf0.001"
SOME = ["forecast_parse", "pruned_scan", "inventory_check", "classify", "dst_gap", "dst_fold", "hour_axis", "demand_grid", "coverage_sets", "missing_by_dim", "nearest_point", "features", "baseline_metrics", "split_overlap", "profile_quality", "gates", "stage_gates", "csv_lookup", "json_runs", "output_inventory", "schema_export", "file_contract_by_file", "reference_contract", "sorted_write", "coverage_select", "profile_keys", "ml_linear", "ml_ridge_grid", "ml_final", "stage_rerun", "gated_stage", "planted_gates", "file_checksums", "changed_files", "footer_contract", "quantile_history", "stored_features", "src_months", "model_ab_delta", "model_improvement"]


def test_every_query_but_models_has_an_oracle():
    assert {k for k in panel.QUERIES if k not in panel.ORACLES} == {"ml_matrix", "ml_gbt", "ml_grid"}
    assert len(panel.QUERIES) == 94 and set(panel.QUERIES) <= set(entry.queries())


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", SOME)
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    got = panel.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = con.execute(panel.ORACLES[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == columns
    ours = sorted([tuple(map(plain, (row[c] for c in columns))) for row in got.collect()], key=str)
    theirs = sorted([tuple(plain(row[names.index(c)]) for c in columns) for row in want.fetchall()], key=str)
    assert ours == theirs


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_scans_are_pruned_and_hold_no_python(spark):
    plan = panel.QUERIES["features"](spark, DATA)._jdf.queryExecution().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan and "CartesianProduct" not in plan
    items = panel.QUERIES["profile_quality"](spark, DATA)._jdf.queryExecution().toString()
    assert "l_returnflag" not in items.split("== Physical Plan ==")[1]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_stored_features_exchange_nothing(spark):
    from gridtide.operators import features
    from gridtide.plans import audits

    rows = features.build_features(*audits.stored_panel(spark, DATA), panel.SPEC, stored=True)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2 and plan.count("Window [") >= 2


def test_flagship(spark):
    if os.path.isdir(DATA):
        assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", ["ml_matrix", "ml_linear"])
def test_models_see_all_horizons_and_feature_sets(spark, name):
    got = panel.QUERIES[name](spark, DATA).groupBy("horizon_hours", "feature_set").count().collect()
    assert {(x.horizon_hours, x.feature_set) for x in got} == {(h, s) for h in panel.SPEC.horizons for s in "AB"}

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridtide.operators import ml
from gridtide.sources import io
from gridtide.spec import FeatureContract

SMALL = FeatureContract("S", ("zone",), ("x",), target="demand")


def test_provenance_and_csv(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "in"))
    part = next((tmp_path / "in").glob("part-*.parquet"))
    part.rename(tmp_path / "in" / "trips_2025-03.parquet")
    row = io.read_with_provenance(spark, str(tmp_path / "in")).groupBy("source_file", "source_month").count().first()
    assert tuple(row) == ("trips_2025-03.parquet", "2025-03", 3)
    (tmp_path / "z.csv").write_text("key,zone\n1,a\n2,\n")
    assert [tuple(x) for x in io.read_lookup_csv(spark, str(tmp_path / "z.csv"), "key int, zone string").collect()] == [(1, "a"), (2, None)]


def test_runs_json(spark, tmp_path):
    folder = tmp_path / "run=2025-01-01T06-00"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps([{"point": "p", "hourly": {"time": ["x"], "weather_code": [3]}}], indent=1))
    row = io.read_runs_json(spark, str(tmp_path / "run=*"), "point string, hourly struct<time:array<string>,weather_code:array<double>>").first()
    assert str(row.run_utc) == "2025-01-01 06:00:00" and row.hourly.weather_code == [3.0]


def test_partition_filters_prune(spark, tmp_path):
    path = str(tmp_path / "t")
    io.write_partitioned(spark.range(100).withColumn("m", F.col("id") % 4), path, ["m"])
    df = io.read_partitions(spark, path, F.col("m") == 2)
    assert df.count() == 25
    assert "PartitionFilters: [isnotnull(m" in df._jdf.queryExecution().toString()
    assert io.file_inventory(spark, path).filter("path like '%.parquet'").count() >= 4


def test_stage_boundary_report_and_contracts(spark, tmp_path):
    df = io.write_and_read(spark.range(5).withColumn("g", F.lit("a")), str(tmp_path / "s"))
    assert df.count() == 5 and io.missing_columns(df, ["id", "nope"]) == ["nope"]
    rows = io.report("s", df.groupBy("g").agg(F.count("*").alias("n")), ["g"])
    io.write_report(rows, str(tmp_path / "r"))
    assert tuple(spark.read.json(str(tmp_path / "r")).select("stage", "metric", "dims", "value").first()) == ("s", "n", "g=a", 5.0)
    assert io.schema_json(df)["fields"][0]["name"] == "id"
    sums = io.file_inventory(spark, str(tmp_path / "s"), checksum=True).collect()
    assert all(len(x.sha256) == 64 for x in sums)


def test_inventory(spark):
    want = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("c", 1, "x"), ("d", 1, "x")], "name string, bytes long, sha256 string")
    have = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x"), ("c", 1, "y")], "name string, bytes long, sha256 string")
    assert {x["name"]: x.problem for x in io.check_inventory(want, have).collect()} == {"a": None, "b": "size", "c": "checksum", "d": "missing"}
    assert [x["name"] for x in io.still_missing(want, have, ["name"]).collect()] == ["d"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "zone int, x double, demand long")


def test_preprocessing_fits_on_training_rows_only(spark):
    train, validation = frame(spark, [(1, 1.0, 1), (1, 2.0, 2), (2, 3.0, 3)]), frame(spark, [(3, 4.0, 4)])
    prepared = ml.fit_preprocessing(train, SMALL)
    assert ml.vocabularies(prepared, SMALL) == {"zone": ["1", "2"]}
    assert ml.matrix(prepared, validation, SMALL).first().features.toArray().tolist() == [0.0, 0.0, 1.0, 0.0, 4.0]
    table = sorted((x.value, x.position) for x in ml.vocabulary_table(train, SMALL).collect())
    assert table == [("1", 0), ("2", 1)]


def test_ridge_matches_its_closed_form(spark):
    r = np.random.default_rng(3)
    x, noise = r.normal(size=200), r.normal(size=200)
    rows = [(1, float(a), int(round(50 + 10 * a + b))) for a, b in zip(x, noise, strict=True)]
    train = frame(spark, rows)
    got = np.array([v.raw_prediction for v in ml.evaluate_frozen(train, train, SMALL, ml.Config("l", "linear", 0.1)).collect()])
    y = np.array([v[2] for v in rows], float)
    sx, sy = x.std(ddof=1), y.std(ddof=1)
    z, n = (x - x.mean()) / sx, len(x)
    w = (z @ (y - y.mean()) / sy / n) / (z @ z / n + 0.1 / sy) * sy
    assert np.allclose(np.sort(got), np.sort(y.mean() + w * z), atol=0.05)


def test_trees_are_repeatable_and_grid_scores_validation(spark):
    rows = [(k % 3, float(k), k % 7) for k in range(120)]
    scores = ml.fit_and_score(frame(spark, rows), frame(spark, rows[:30]), SMALL, (ml.Config("l", "linear", 0.1), ml.Config("t", "trees", depth=2, rounds=2))).withColumn("horizon_hours", F.lit(1))
    assert sorted((x.config, x.n_rows) for x in scores.collect()) == [("l", 30), ("t", 30)]
    assert {x.config for x in ml.select_configs(scores).collect()} == {"l", "t"}
    a, b = (sorted(x.prediction for x in ml.evaluate_frozen(frame(spark, rows), frame(spark, rows), SMALL, ml.Config("t", "trees", depth=2, rounds=2)).collect()) for _ in range(2))
    assert a == pytest.approx(b) and min(a) >= 0


def test_grid_holds_the_whole_tree_grid():
    trees = [(c.depth, c.rounds, c.step) for c in ml.GRID if c.family == "trees"]
    assert trees == [(4, 15, 0.1), (5, 25, 0.05)]
    made = [c.estimator() for c in ml.GRID if c.family == "trees"]
    assert [(x.getMaxDepth(), x.getMaxIter(), x.getStepSize()) for x in made] == trees

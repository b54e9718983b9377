import pytest
from pyspark.sql import functions as F

from gridtide.operators import metrics, quality, splits
from gridtide.sources import io
from gridtide.spec import CONTRACT_A, CONTRACT_B, FeatureContract


def found(df):
    return quality.gates({"g": df}).first().n_violations


def test_cardinality_gate(spark):
    grid = spark.range(4).withColumn("target_utc", F.col("id"))
    whole = grid.select(F.explode(F.array(*map(F.lit, (1, 3)))).alias("horizon_hours"), F.lit(True).alias("source_available"))
    assert found(quality.wrong_cardinality(grid, whole, 2)) == 0
    assert found(quality.wrong_cardinality(grid, whole.limit(7), 2)) == 1
    assert found(quality.wrong_cardinality(grid, whole.withColumn("source_available", F.lit(None).cast("boolean")), 2)) == 1
    assert found(quality.wrong_cardinality(grid.limit(0), whole.limit(0), 2)) == 0


def test_unequal_counts_and_slots(spark):
    a, b = spark.createDataFrame([("x",), ("x",), (None,)], "k string"), spark.createDataFrame([("x",), (None,), (None,)], "k string")
    assert found(quality.unequal_counts(a, a, ["k"])) == 0 and found(quality.unequal_counts(a, b, ["k"])) == 2
    done = spark.createDataFrame([(True, False), (True, True)], "u_missing boolean, v_missing boolean")
    slots = spark.createDataFrame([("u",), ("u",), ("v",)], "variable string")
    assert found(quality.unequal_slots(done, slots, ("u", "v"))) == 0
    assert [x.variable for x in quality.unequal_slots(done, slots.limit(2), ("u", "v")).collect()] == ["v"]


def test_contract_and_population_gates(spark):
    assert found(quality.contract_difference(spark, CONTRACT_A, CONTRACT_B, ("forecast_value", "forecast_k"))) == 0
    assert [x.column for x in quality.contract_difference(spark, CONTRACT_A, CONTRACT_B, ("forecast_value",)).collect()] == ["forecast_k"]
    assert found(quality.contract_difference(spark, CONTRACT_A, FeatureContract("C", ("key",), ("forecast_k",)), ("forecast_k",))) == len(CONTRACT_A.columns) - 1
    assert found(quality.target_among_features(spark, CONTRACT_A, CONTRACT_B)) == 0
    rows = spark.createDataFrame([("train", 1), ("test", 1)], "split string, horizon_hours int")
    assert sorted(map(tuple, quality.empty_populations(rows, ["train", "test"], (1, 3)).collect())) == [("test", 3), ("train", 3)]


def test_shared_hours(spark):
    rows = spark.createDataFrame([("train", 1), ("test", 1), ("test", 2), (None, 2)], "split string, target_utc int")
    assert [x.target_utc for x in splits.shared_hours(rows).collect()] == [1]


def test_sorted_files_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([(k % 3, 50 - k) for k in range(50)], "key int, t int")
    io.write_sorted(rows, str(tmp_path / "s"), ["key", "t"])
    assert {x.key: (x.n_rows, x.n_unordered) for x in io.order_audit(spark.read.parquet(str(tmp_path / "s")), "key", "t").collect()} == {0: (17, 0), 1: (17, 0), 2: (16, 0)}
    rows.coalesce(1).write.parquet(str(tmp_path / "u"))
    assert all(x.n_unordered == x.n_rows - 1 for x in io.order_audit(spark.read.parquet(str(tmp_path / "u")), "key", "t").collect())
    assert [tuple(x) for x in metrics.numbered(spark.createDataFrame([("b",), ("a",)], "n string"), ["n"]).collect()] == [("a", 1), ("b", 2)]


def test_contracts_of_references_and_files(spark, tmp_path):
    lookup = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "key int, zone string")
    assert tuple(io.reference_contract(lookup, "key", ["key", "zone"]).first()) == (3, 1, 1, False)
    assert not io.reference_contract(lookup.limit(0), "key", ["key"]).first().valid
    with pytest.raises(ValueError, match="area"):
        io.reference_contract(lookup, "key", ["area"])
    lookup.write.parquet(str(tmp_path / "t"))
    files = io.file_inventory(spark, str(tmp_path / "t"), checksum=True).filter("path like '%.parquet'")
    total = io.inventory_totals(files).first()
    assert total.folder == "t" and total.n_without_checksum == 0 and total.bytes > 0
    assert [x.column for x in io.export_schema(lookup, str(tmp_path / "j")).orderBy("position").collect()] == ["key", "zone"]

import pytest
from pyspark.sql import functions as F

from gridtide.operators import quality
from gridtide.operators.quality import GateError
from gridtide.sources import stages
from gridtide.sources.stages import Gate, Stage


def source(spark, extra=0, parts=("a", "b", "c", None)):
    rows = [(p, k, k * 1.5 + (extra if p == "b" else 0)) for p in parts for k in range(20)]
    return spark.createDataFrame(rows, "part string, k int, v double").repartition(3)


def build(df):
    return lambda slices: df.filter(F.coalesce("part", F.lit("__HIVE_DEFAULT_PARTITION__")).isin(*slices))


def total(stage):
    return {r["part"]: (r["n"], r["v"]) for r in stage.read().groupBy("part").agg(F.count("*").alias("n"), F.sum("v").alias("v")).collect()}


def test_a_rerun_does_what_is_left(spark, tmp_path):
    stage, df = Stage(spark, str(tmp_path / "s"), "part"), source(spark)
    with pytest.raises(FileNotFoundError):
        stage.read()
    first = stage.write(stages.fingerprints(df, "part"), build(df), gates=[Gate("rows", F.count("*"), 80), Gate("nulls", F.count_if(F.col("v").isNull()))])
    assert first.version == 1 and first.figures == {"rows": 80, "nulls": 0} and len(first.done) == 4 and not first.kept
    assert total(stage) == {p: (20, 285.0) for p in ("a", "b", "c", None)}
    again = stage.write(stages.fingerprints(df.repartition(7), "part"), lambda slices: pytest.fail("nothing is left"))
    assert again.version == 1 and not again.done and len(again.kept) == 4
    other = source(spark, extra=1, parts=("a", "b", "d"))
    asked = []
    then = stage.write(stages.fingerprints(other, "part"), lambda s: asked.append(s) or build(other)(s))
    assert asked == [["b", "d"]] and then.version == 2 and then.kept == ("a",)
    assert total(stage) == {"a": (20, 285.0), "b": (20, 305.0), "d": (20, 285.0)}
    assert {r["part"] for r in stage.read(1).collect()} == {"a", "b", "c", None}
    before, after = stage.manifest(1)["slices"], stage.manifest()["slices"]
    assert before["a"] == after["a"] and before["b"]["folder"] != after["b"]["folder"]
    assert len(stage.vacuum()) == 3 and total(stage)["b"] == (20, 305.0)


def test_a_run_that_dies_is_never_read_and_its_steps_stay(spark, tmp_path):
    stage, df = Stage(spark, str(tmp_path / "s"), "part"), source(spark)
    prints, seen = stages.fingerprints(df, "part"), []

    def dies(slices):
        seen.append(slices)
        if len(seen) == 3:
            return build(df)(slices).withColumn("v", F.raise_error(F.lit("lost")).cast("double"))
        return build(df)(slices)

    with pytest.raises(Exception, match="lost"):
        stage.write(prints, dies, at_once=1)
    assert stage.versions() == [1, 2] and len(total(stage)) == 2
    rest = stage.write(prints, build(df), at_once=1)
    assert len(rest.done) == 2 and len(rest.kept) == 2 and total(stage) == {p: (20, 285.0) for p in ("a", "b", "c", None)}
    assert not [x for x in stage.vacuum() if any(x == s["folder"] for s in stage.manifest()["slices"].values())]


@pytest.mark.parametrize(("gate", "found"), [(lambda: Gate("rows", F.count("*"), 79), "rows: 80, not 79"), (lambda: Gate("late", F.count_if(F.col("k") > 18)), "late: 4"), (lambda: Gate("most", F.max("k"), 18), "most: 19")])
def test_a_planted_violation_stops_the_commit(spark, tmp_path, gate, found):
    stage, df = Stage(spark, str(tmp_path / "s"), "part"), source(spark)
    stage.write({"a": "1"}, build(df))
    with pytest.raises(GateError, match=found):
        stage.write(stages.fingerprints(df, "part"), build(df), gates=[gate()])
    assert stage.versions() == [1] and set(total(stage)) == {"a"}


def test_checks_of_what_was_written_stop_the_commit(spark, tmp_path):
    stage, df = Stage(spark, str(tmp_path / "s"), "part"), source(spark)
    double = df.unionByName(df.filter("part = 'b' AND k = 3"))
    unique = {"duplicate_keys": lambda rows: quality.duplicate_keys(rows, ["part", "k"])}
    with pytest.raises(GateError, match="duplicate_keys: 1"):
        stage.write(stages.fingerprints(double, "part"), build(double), checks=unique)
    assert stage.versions() == []
    assert stage.write(stages.fingerprints(df, "part"), build(df), checks=unique).version == 1
    with pytest.raises(GateError, match="rows_of_other_slices: 60"):
        stage.write({"a": "x"}, lambda slices: df)


def test_gates_cost_no_second_scan(spark, tmp_path):
    """One job reads the input: the write itself."""
    df = source(spark)
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    passed = df.mapInArrow(counted, df.schema)
    figures = stages.observed_write(passed, lambda x: x.write.parquet(str(tmp_path / "o")), [Gate("rows", F.count("*")), Gate("sum", F.sum("k"))])
    assert figures == {"rows": 80, "sum": 760} and reads.value == 80


def test_two_runs_of_one_version_conflict(spark, tmp_path):
    stage, df = Stage(spark, str(tmp_path / "s"), "part"), source(spark)

    def raced(slices):
        Stage(spark, str(tmp_path / "s"), "part").write({"a": "1"}, build(df))
        return build(df)(slices)

    with pytest.raises(stages.StageConflict):
        stage.write({"a": "2", "b": "2"}, raced)
    assert set(total(stage)) == {"a"}


def test_slices_of_other_types_and_names_and_empty_ones(spark, tmp_path):
    rows = spark.createDataFrame([("x/y=1 %", 1), ("", 2)], "part string, __run int")
    stage = Stage(spark, str(tmp_path / "s"), "part")
    with pytest.raises(ValueError, match="__run"):
        stage.write({"x/y=1 %": "1", "": "1"}, lambda s: rows)
    stage = Stage(spark, str(tmp_path / "t"), "part")
    plain = rows.withColumnRenamed("__run", "n")
    stage.write({"x/y=1 %": "1", "": "1", "none": "1"}, lambda s: plain)
    assert sorted(map(tuple, stage.read().select("n", "part").collect())) == [(1, "x/y=1 %"), (2, None)]
    assert stage.manifest()["slices"]["none"] == {"folder": None, "rows": 0, "fingerprint": "1"}
    numbers = Stage(spark, str(tmp_path / "n"), "h")
    df = spark.createDataFrame([(1, 5.0), (3, 6.0)], "h int, v double")
    numbers.write(stages.fingerprints(df, "h"), lambda s: df.filter(F.col("h").cast("string").isin(*s)))
    assert sorted(map(tuple, numbers.read().select("h", "v").collect())) == [(1, 5.0), (3, 6.0)] and dict(numbers.read().dtypes)["h"] == "int"
    plan = numbers.read().filter("h = 3")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(h" in plan
    assert numbers.fingerprints().keys() == {"1", "3"}

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridtide.operators import grid, ml, prefix, profiling, ridge
from gridtide.plans import queries as panel
from gridtide.spec import FeatureContract

DATA = "/root/testdata/sf0.001"
SMALL = FeatureContract("S", ("zone",), ("x",), target="demand")
WIDE = SMALL.extended("W", ("day",), ("z",))


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plain_shares(rows):
    out, total, running = [], sum(n for _, n in rows), 0
    for k, (key, n) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])), 1):
        running += n
        out.append((key, n, k, running, total))
    return out


@pytest.mark.parametrize("kind", ["ties", "one huge key", "many", "one", "none"])
def test_running_totals_over_ranges(spark, many_ranges, kind):
    r = random.Random(3)
    rows = {"ties": [(k, 5) for k in range(300)], "one huge key": [(k, 10**15 if k == 77 else k % 4) for k in range(500)], "many": [(k, r.randrange(1000)) for k in range(2000)], "one": [(1, 4)], "none": []}[kind]
    got = grid.ranked_shares(spark.createDataFrame(rows, "key long, n long").repartition(7))
    assert sorted(map(tuple, got.collect()), key=lambda x: x[2]) == plain_shares(rows)
    if len(rows) > 100:
        assert got.select(F.col("rank")).distinct().count() == len(rows)


def test_running_totals_of_nulls_and_doubles(spark, many_ranges):
    rows = spark.createDataFrame([("a", 1.5, "x"), ("b", None, None), ("c", 2.0, "z")], "key string, v double, rest string")
    got = prefix.running_totals(rows, [F.asc("key")], "v").orderBy("key").collect()
    assert [(x.key, x.rest, x["rank"], x.cumulative, x.total) for x in got] == [("a", "x", 1, 1.5, 3.5), ("b", None, 2, 1.5, 3.5), ("c", "z", 3, 3.5, 3.5)]


def test_coverage_and_profiles_are_those_of_one_window(spark, many_ranges):
    rows = [(k, (k * 7919) % 97 + 1) for k in range(400)]
    shares, total = plain_shares(rows), sum(n for _, n in rows)
    totals = spark.createDataFrame(rows, "key long, n long")
    want = {x[0] for x in shares if (x[3] - x[1]) * 100 < total * 90}
    assert {x.key for x in grid.covering_keys(totals, 90).collect()} == want
    keys = [k for k, n in rows for _ in range(n % 9)] + [None] * 4
    got = profiling.profile_keys(spark.createDataFrame([(k,) for k in keys], "key long"), "key", spark.createDataFrame([(1,), (2,)], "key long")).collect()
    order = sorted({k: keys.count(k) for k in set(keys)}.items(), key=lambda x: (-x[1], x[0] is not None, x[0] or 0))
    assert [(x.key, x.n, x["rank"], x.known) for x in sorted(got, key=lambda x: x["rank"])] == [(k, n, i, k in (1, 2)) for i, (k, n) in enumerate(order, 1)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", ["coverage_select", "coverage_sets", "scope_filter", "profile_keys"])
def test_no_task_holds_a_whole_window(spark, name):
    plan = panel.QUERIES[name](spark, DATA)._jdf.queryExecution().toString()
    windows = [x.split(",")[0] for x in plan.split("windowspecdefinition(")[1:]]
    assert windows and all("__range" in x for x in windows)


# Ridge


def frame(spark, n, seed=1):
    r = np.random.default_rng(seed)
    rows = [(1 + k % 2 * 2, int(r.integers(0, 6)), f"d{r.integers(0, 3)}", float(r.normal()), float(r.normal() * 50), int(r.integers(0, 40))) for k in range(n)]
    return spark.createDataFrame(rows, "horizon_hours int, zone int, day string, x double, z double, demand long").withColumn("key", F.monotonically_increasing_id())


def test_ridge_is_what_the_library_fits(spark):
    train, score = frame(spark, 600).repartition(5), frame(spark, 60, 2)
    configs = [ml.Config(f"l{x}", "linear", x) for x in (0.01, 0.5)]
    got = {(x.key, x.feature_set, x.config): x.raw_prediction for x in ridge.predict(ridge.fit(train, (SMALL, WIDE), configs), score, WIDE).collect()}
    assert len(got) == 60 * 4
    for hours in (1, 3):
        for contract in (SMALL, WIDE):
            for config in configs:
                want = ml.evaluate_frozen(train.filter(F.col("horizon_hours") == hours), score.filter(F.col("horizon_hours") == hours), contract, config).collect()
                assert len(want) == 30
                assert all(abs(x.raw_prediction - got[x.key, contract.name, config.name]) < 1e-9 for x in want)


def test_ridge_with_constants_unseen_values_and_nulls(spark):
    train = spark.createDataFrame([(1, 1, 2.0, k) for k in range(5)], "horizon_hours int, zone int, x double, demand long")
    model = ridge.fit(train, (SMALL,), [ml.Config("l", "linear", 0.1)])
    assert tuple(model.select("intercept", F.size("weights"), "n_rows").first()) == (2.0, 0, 5)
    rows = spark.createDataFrame([(1, 9, 3.0, 1), (1, None, None, 1), (2, 1, 1.0, 1)], "horizon_hours int, zone int, x double, demand long")
    assert [x.raw_prediction for x in ridge.predict(model, rows, SMALL).collect()] == [2.0, 2.0]
    varied = spark.createDataFrame([(1, k % 2, float(k), k * k) for k in range(9)], train.schema)
    fitted = ridge.fit(varied, (SMALL,), [ml.Config("l", "linear", 0.1)])
    seen = {x.actual: x.raw_prediction for x in ridge.predict(fitted, spark.createDataFrame([(1, None, 1.0, 1), (1, 7, 1.0, 2), (1, 1, None, 3)], train.schema), SMALL).collect()}
    assert seen[1.0] == pytest.approx(seen[2.0]) and seen[3.0] is None
    with pytest.raises(Exception, match="null"):
        ridge.fit(rows, (SMALL,), [ml.Config("l", "linear", 0.1)]).collect()
    with pytest.raises(ValueError, match="lacks"):
        ridge.fit(train, (WIDE, SMALL), [])
    assert ridge.fit(train.limit(0), (SMALL,), [ml.Config("l", "linear", 0.1)]).count() == 0


def test_one_pass_serves_all_penalties(spark):
    plan = ridge.fit(frame(spark, 50), (SMALL, WIDE), [ml.Config(f"l{k}", "linear", k / 10) for k in range(1, 8)])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


# Fits side by side


def test_fits_side_by_side_score_alike_and_release(spark, monkeypatch):
    train, score = frame(spark, 200).repartition(3).cache(), frame(spark, 40, 2).cache()
    train.count(), score.count()
    configs = [ml.Config("t2", "trees", depth=2, rounds=2), ml.Config("t3", "trees", depth=3, rounds=2, step=0.05)]
    held = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    found = []
    for width in (4, 1):
        monkeypatch.setattr(ml.side_by_side, "__defaults__", (width,))
        fits = ml.fit_each(train, (1, 3), (SMALL, WIDE), configs)
        assert [(f.hours, f.contract.name, f.config.name) for f in fits] == [(h, c, x) for h in (1, 3) for c in "SW" for x in ("t2", "t3")]
        assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == held
        found.append({(x.horizon_hours, x.feature_set, x.config): (x.n_rows, x.mae) for x in ml.scores(ml.predict_each(fits, score)).collect()})
    assert found[0] == found[1] and len(found[0]) == 8
    train.unpersist(), score.unpersist()


def test_a_failed_fit_raises_and_releases(spark):
    rows = frame(spark, 20)
    held = spark.sparkContext._jsc.sc().getPersistentRDDs().size()

    class Broken(ml.Config):
        def estimator(self):
            raise RuntimeError("broken config")

    with pytest.raises(RuntimeError, match="broken config"):
        ml.fit_each(rows, (1,), (SMALL,), [ml.Config("t", "trees", depth=1, rounds=1), Broken("b", "trees")])
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == held

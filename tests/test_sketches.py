import bisect

import pytest
from pyspark.sql import functions as F

from gridtide.operators import sketches
from gridtide.sources.stages import Stage

SHARES = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p999": 0.999}


def off(values, q, p):
    """By how much of the rows the rank of q misses p."""
    below, upto = bisect.bisect_left(values, q) / len(values), bisect.bisect_right(values, q) / len(values)
    return max(0.0, below - p, p - upto)


def test_a_million_values_are_within_the_bound_whole_or_merged(spark):
    n = 1_200_000
    rows = spark.range(n).select((F.col("id") % 12).alias("month"), (F.xxhash64("id") % 100_000 + F.when(F.col("id") % 5 == 0, 10.0**7).otherwise(0.0)).alias("v"))
    values = sorted(r.v for r in rows.select("v").toLocalIterator())
    whole = sketches.with_quantiles(sketches.quantile_sketches(rows, [], "v"), SHARES | {"p0": 0.0, "p1": 1.0}).first()
    months = sketches.quantile_sketches(rows, ["month"], "v")
    merged = sketches.with_quantiles(sketches.merged_sketches(months, []), SHARES | {"p0": 0.0, "p1": 1.0}).first()
    bound = sketches.rank_error()
    assert 0.006 < bound < 0.008
    for found in (whole, merged):
        assert (found.n, found.p0, found.p1) == (n, values[0], values[-1])
        assert all(off(values, found[c], p) <= bound for c, p in SHARES.items())
        assert len(found.sketch) < 20_000
    assert months.count() == 12


def test_groups_of_nulls_ties_and_little(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", None), ("a", float("nan")), ("b", None), ("c", 5.0), ("c", 5.0), ("c", 7.0)], "g string, v double")
    made = sketches.quantile_sketches(rows, ["g"], "v")
    got = {x.g: (x.n, x.least, x.p50, x.most) for x in sketches.with_quantiles(made, {"p50": 0.5}).collect()}
    assert got == {"a": (1, 1.0, 1.0, 1.0), "b": (0, None, None, None), "c": (3, 5.0, 5.0, 7.0)}
    both = sketches.with_quantiles(sketches.merged_sketches(made, []), {"p50": 0.5}).first()
    assert (both.n, both.least, both.p50, both.most) == (4, 1.0, 5.0, 7.0)
    assert sketches.quantile_sketches(rows.limit(0), ["g"], "v").count() == 0
    only = sketches.with_quantiles(sketches.merged_sketches(made.filter("g = 'b'"), ["g"]), {"p50": 0.5}).first()
    assert (only.n, only.p50) == (0, None)


def test_a_history_only_sketches_new_months(spark, tmp_path):
    rows = spark.range(3000).select((F.col("id") % 3).alias("key"), F.concat(F.lit("2025-0"), (F.col("id") % 4 + 1).cast("string")).alias("month"), F.col("id").cast("double").alias("v"))
    stage = Stage(spark, str(tmp_path / "h"), "month")
    first = sketches.update_history(stage, rows.filter("month < '2025-04'"), ["key"], "v")
    assert first.done == ("2025-01", "2025-02", "2025-03")
    second = sketches.update_history(stage, rows, ["key"], "v")
    assert second.done == ("2025-04",) and len(second.kept) == 3
    late = rows.withColumn("v", F.when(F.col("month") == "2025-02", F.col("v") + 10_000).otherwise(F.col("v")))
    assert sketches.update_history(stage, late, ["key"], "v").done == ("2025-02",)
    values = {k: sorted(r.v for r in late.filter(F.col("key") == k).collect()) for k in range(3)}
    got = sketches.with_quantiles(sketches.merged_sketches(stage.read(), ["key"]), SHARES).collect()
    assert {x.key for x in got} == {0, 1, 2}
    for x in got:
        assert x.n == 1000 and all(off(values[x.key], x[c], p) <= sketches.rank_error() for c, p in SHARES.items())


@pytest.mark.parametrize("k", [50, 400])
def test_more_values_kept_is_less_error(k):
    assert sketches.rank_error(2 * k) < sketches.rank_error(k)

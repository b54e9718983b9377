"""Quantiles from stored sketches that later data merge into.

A KLL sketch of a group holds about SKETCH_K values whatever the group's size. Its quantiles' ranks are off by at most :func:`rank_error` of the group's rows with a probability of 99 %, and
so are those of any merge of sketches. So a month's sketches are made once, and a period's quantiles read no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stages import Stage, Written, fingerprints

SKETCH_K = 400


def rank_error(k: int = SKETCH_K) -> float:
    """Bound of a quantile's error in rank, as a share of the rows, with a probability of 99 %: a fixed formula of the sketch's library."""
    return 2.296 / k**0.9723


def quantile_sketches(rows: DataFrame, by: Sequence[str], value: str, k: int = SKETCH_K) -> DataFrame:
    """by, n, least, most and sketch of each group's values. Nulls and NaN don't count; a group of nothing else has n = 0 and null bounds."""
    known = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    sketch = F.kll_sketch_agg_double(known, F.lit(k))
    return rows.groupBy(*by).agg(F.count(known).alias("n"), F.min(known).alias("least"), F.max(known).alias("most"), sketch.alias("sketch"))


def merged_sketches(sketches: DataFrame, by: Sequence[str], k: int = SKETCH_K) -> DataFrame:
    """The sketches of coarser groups, from those of finer ones."""
    held = F.when(F.col("n") > 0, F.col("sketch"))
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.kll_merge_agg_double(held, F.lit(k)).alias("sketch"))


def quantile(sketch: Column | str, p: float) -> Column:
    """The value at the share p (0 to 1) of a sketch; null where the sketch has no values (n = 0)."""
    return F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(p)))


def with_quantiles(sketches: DataFrame, probabilities: dict[str, float]) -> DataFrame:
    """sketches with a column for each named share; 0 and 1 are the exact least and most."""
    exact = {0.0: F.col("least"), 1.0: F.col("most")}
    return sketches.withColumns({name: exact.get(float(p), quantile("sketch", p)) for name, p in probabilities.items()})


def update_history(stage: Stage, rows: DataFrame, by: Sequence[str], value: str, k: int = SKETCH_K) -> Written:
    """Bring a stored history of sketches, in slices by the stage's column (a month, say), up to date: only slices with other rows than before are sketched."""
    period = stage.by
    kept = rows.select(*by, period, value)

    def build(slices: list[str]) -> DataFrame:
        return quantile_sketches(kept.filter(F.col(period).cast("string").isin(*slices)), [*by, period], value, k)

    return stage.write(fingerprints(kept, period), build)

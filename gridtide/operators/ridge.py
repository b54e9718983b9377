"""Ridge regressions from sufficient statistics: one aggregate of the rows serves every penalty and every contract whose columns it holds.

The statistics of a horizon are the sums of products of every two columns: a constant, the label, each numeric, and an indicator of each category value.
Tasks add them up by matrix products, one matrix for each horizon; Spark sums the tasks' entries. They are as many as
columns squared, whatever the number of rows. Models are the solutions of the normal equations on standardised columns (population deviations;
the penalty is divided by the label's deviation, the intercept has none): what Spark's LinearRegression gives with solver "normal", standardization and elasticNetParam 0.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import FeatureContract
from .ml import Config, model_columns

ONE, LABEL = "1", "y"
#: Part of a column's mean square under which its variance counts as none.
FLAT = 1e-12


def _column(name: str, value: str | None = None) -> str:
    return f"n:{name}" if value is None else f"c:{name}={value}"


def gram(rows: DataFrame, contract: FeatureContract) -> DataFrame:
    """horizon_hours, i, j, v: sums of products of columns i <= j, where they aren't 0. A null numeric or label raises; a null category has no indicator."""
    typed = model_columns(rows, contract).select("horizon_hours", "label", *[f"n_{c}" for c in contract.numeric], *[f"c_{c}" for c in contract.categorical])
    n_numbers = 1 + len(contract.numeric)

    def add(total: dict[int, tuple[list[str], np.ndarray]], hours: int, names: list[str], products: np.ndarray) -> None:
        known, sums = total.get(hours, ([], np.zeros((0, 0))))
        place = {c: k for k, c in enumerate(known)}
        merged = known + [c for c in names if c not in place]
        if len(merged) > len(known):
            sums = np.pad(sums, (0, len(merged) - len(known)))
            place = {c: k for k, c in enumerate(merged)}
        at = [place[c] for c in names]
        sums[np.ix_(at, at)] += products
        total[hours] = (merged, sums)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[list[str], np.ndarray]] = {}
        for batch in batches:
            if any(batch.column(k).null_count for k in range(1, 1 + n_numbers)):
                raise ValueError("a label or numeric is null")
            horizons = batch.column(0).to_numpy(zero_copy_only=False)
            for hours in np.unique(horizons).tolist():
                part = batch.filter(pa.array(horizons == hours))
                columns, names = [np.ones(part.num_rows)], [ONE]
                for k in range(n_numbers):
                    columns.append(part.column(1 + k).to_numpy(zero_copy_only=False))
                    names.append(LABEL if k == 0 else _column(contract.numeric[k - 1]))
                for k, c in enumerate(contract.categorical):
                    coded = part.column(1 + n_numbers + k).dictionary_encode()
                    codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                    for code, value in enumerate(coded.dictionary.to_pylist()):
                        columns.append((codes == code).astype(float))
                        names.append(_column(c, value))
                x = np.column_stack(columns)
                add(total, int(hours), names, x.T @ x)
        for hours, (names, sums) in total.items():
            order = sorted(range(len(names)), key=names.__getitem__)
            upper = [(a, b) for p, a in enumerate(order) for b in order[p:] if sums[a, b]]
            yield pa.RecordBatch.from_arrays([pa.array([hours] * len(upper), pa.int32()), pa.array([names[a] for a, _ in upper], pa.string()), pa.array([names[b] for _, b in upper], pa.string()), pa.array([sums[a, b] for a, b in upper], pa.float64())], names=["horizon_hours", "i", "j", "v"])

    return typed.mapInArrow(products, "horizon_hours int, i string, j string, v double").groupBy("horizon_hours", "i", "j").agg(F.sum("v").alias("v"))


def solve(names: list[str], sums: np.ndarray, use: Sequence[str], reg: float) -> tuple[float, dict[str, float]]:
    """Intercept and weights of the columns in use, from the sums of products of all columns. Columns without variance have no weight."""
    place = {c: k for k, c in enumerate(names)}
    mean = sums[place[ONE]] / sums[place[ONE], place[ONE]]
    square = sums / sums[place[ONE], place[ONE]]
    variance = np.diag(square) - mean**2
    deviation = np.sqrt(np.where(variance > FLAT * np.diag(square), variance, 0.0))
    y = place[LABEL]
    live = [place[c] for c in use if deviation[place[c]] > 0]
    if not live or deviation[y] == 0:
        return float(mean[y]), {}
    scale = deviation[live]
    covariance = square[np.ix_(live, [*live, y])] - np.outer(mean[live], mean[[*live, y]])
    left = covariance[:, :-1] / np.outer(scale, scale) + reg / deviation[y] * np.eye(len(live))
    weights = np.linalg.solve(left, covariance[:, -1] / scale / deviation[y]) * deviation[y] / scale
    return float(mean[y] - weights @ mean[live]), {names[k]: float(w) for k, w in zip(live, weights, strict=True)}


def fit(rows: DataFrame, contracts: Sequence[FeatureContract], configs: Sequence[Config]) -> DataFrame:
    """horizon_hours, feature_set, config, n_rows, intercept and weights (by column) of each linear config and contract, from one pass over rows.

    The last contract has to hold the columns of all others.
    """
    widest = contracts[-1]
    if any(set(c.columns) - set(widest.columns) for c in contracts):
        raise ValueError("the last contract lacks columns of another")

    def solved(table: pa.Table) -> pa.Table:
        i, j, v = (table[c].to_pylist() for c in ("i", "j", "v"))
        names = sorted({*i, *j})
        place = {c: k for k, c in enumerate(names)}
        sums = np.zeros((len(names), len(names)))
        for a, b, x in zip(i, j, v, strict=True):
            sums[place[a], place[b]] = sums[place[b], place[a]] = x
        out = []
        for contract in contracts:
            heads = {_column(c) for c in contract.numeric} | {_column(c, "") for c in contract.categorical}
            use = [c for c in names if c in heads or c.partition("=")[0] + "=" in heads]
            out += [(table["horizon_hours"][0].as_py(), contract.name, config.name, int(sums[place[ONE], place[ONE]]), *solve(names, sums, use, config.reg)) for config in configs]
        kinds = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.map_(pa.string(), pa.float64()))
        columns = [pa.array([list(x[k].items()) if k == 5 else x[k] for x in out], kind) for k, kind in enumerate(kinds)]
        return pa.Table.from_arrays(columns, names=["horizon_hours", "feature_set", "config", "n_rows", "intercept", "weights"])

    models = gram(rows, widest).groupBy("horizon_hours").applyInArrow(solved, "horizon_hours int, feature_set string, config string, n_rows long, intercept double, weights map<string, double>")
    return models


def predict(models: DataFrame, rows: DataFrame, widest: FeatureContract) -> DataFrame:
    """Keys, actual, raw_prediction, prediction (0 at least), feature_set and config: every row under every model of its horizon.

    A category value that the fit has not seen adds nothing. A null numeric that a model uses gives a null prediction.
    """

    def term(name: Column, value: Column) -> Column:
        weight = F.try_element_at("weights", name)
        return F.when(weight.isNull(), F.lit(0.0)).otherwise(weight * value)

    typed = model_columns(rows, widest).withColumn("horizon_hours", F.col("horizon_hours").cast("int"))
    # A model for each horizon, contract and config: a few rows at every size.
    joined = typed.join(F.broadcast(models), "horizon_hours")
    raw = F.col("intercept")
    for c in widest.numeric:
        raw = raw + term(F.lit(_column(c)), F.col(f"n_{c}"))
    for c in widest.categorical:
        raw = raw + F.coalesce(term(F.concat(F.lit(_column(c, "")), F.col(f"c_{c}")), F.lit(1.0)), F.lit(0.0))
    found = joined.withColumn("raw_prediction", raw)
    keys = [c for c in ("key", "target_utc", "horizon_hours") if c in found.columns]
    clipped = F.when(F.col("raw_prediction").isNotNull(), F.greatest("raw_prediction", F.lit(0.0)))
    return found.select(*keys, F.col("label").alias("actual"), "raw_prediction", clipped.alias("prediction"), "feature_set", "config")

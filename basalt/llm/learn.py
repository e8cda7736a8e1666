"""Fitting from partition sums: ridge by normal equations, and isotonic calibration from a histogram."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partial sums that one task adds up.
_FAN = 256


def add_up(parts: DataFrame) -> np.ndarray:
    """Sum of the matrices whose rows parts holds as (pid int, i int, row binary of doubles): each task adds at
    most a _FAN-th of the partitions' rows i, then one adds those."""

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(r) for r in pdf["row"]], axis=0)
        return pd.DataFrame({"pid": [int(pdf["pid"].iloc[0]) % _FAN], "i": [int(pdf["i"].iloc[0])], "row": [total.tobytes()]})

    schema = "pid int, i int, row binary"
    some = parts.groupBy("i", (F.col("pid") % _FAN).alias("g")).applyInPandas(add, schema)
    rows = some.groupBy("i").applyInPandas(add, schema).collect()
    return np.array([np.frombuffer(r.row) for r in sorted(rows, key=lambda r: r.i)])


def partial_rows(pid: int, m: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([pid] * len(m), pa.int32()), pa.array(range(len(m)), pa.int32()), pa.array([r.tobytes() for r in np.ascontiguousarray(m, float)], pa.binary())], ["pid", "i", "row"])


@dataclass(frozen=True)
class FourierRidge:
    """Ridge regression on random Fourier features of a Gaussian kernel over standardised inputs."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray  # inputs x features
    b: np.ndarray
    coef: np.ndarray  # last: intercept

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.coef


def fit_ridge(rows: DataFrame, n_in: int, n_features: int = 256, gamma: float | None = None, ridge: float = 1e-3, seed: int = 7) -> FourierRidge | None:
    """Fits rows(x array<double> of n_in, y int). Each partition sums its own normal equations; only sums travel.

    gamma: of exp(-gamma |a - b|^2), by default half of one over n_in. None without rows.
    """
    stat = rows.agg(F.count(F.lit(1)), *(f(F.get("x", F.lit(i))) for i in range(n_in) for f in (F.avg, F.stddev_pop))).head()
    if not stat[0]:
        return None
    mean, scale = np.array(stat[1::2], float), np.array(stat[2::2], float)
    scale[~(scale > 1e-9)] = 1.0
    rng = np.random.default_rng(seed)
    gamma = gamma or 0.5 / n_in
    model = FourierRidge(mean, scale, rng.normal(0, np.sqrt(2 * gamma), (n_in, n_features)), rng.uniform(0, 2 * np.pi, n_features), np.zeros(n_features + 1))

    def sums(batches):
        from pyspark import TaskContext

        total = np.zeros((n_features + 1, n_features + 2))
        for b in batches:
            x = b.column("x").flatten().to_numpy().reshape(-1, n_in)
            phi, y = model.features(x), b.column("y").to_numpy().astype(float)
            total += phi.T @ np.column_stack([phi, y])
        yield partial_rows(TaskContext.get().partitionId(), total)

    total = add_up(rows.select("x", "y").mapInArrow(sums, "pid int, i int, row binary"))
    gram, target = total[:, :-1], total[:, -1]
    penalty = np.eye(len(gram)) * ridge * stat[0] / len(gram)  # grows with the rows, and is shared by the features
    penalty[-1, -1] = 0  # the intercept is free
    coef = np.linalg.solve(gram + penalty, target)
    return FourierRidge(model.mean, model.scale, model.w, model.b, coef)


@dataclass(frozen=True)
class Isotonic:
    """A non-decreasing map from raw scores to probabilities, straight between its knots."""

    x: np.ndarray
    y: np.ndarray

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(raw, self.x, self.y), 0.0, 1.0)


def pool_adjacent(x, n, pos) -> Isotonic:
    """Pool adjacent violators over bins (x: mean score, n: rows, pos: rows of label 1), with half a row of
    each label added to a pool so that no score is certain. Without rows: 0.5 everywhere."""
    pools: list[list[float]] = []  # sum of x * n, n, pos, first x, last x
    for a, c, p in sorted(zip(x, n, pos, strict=True)):
        pools.append([a * c, c, p, a, a])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2] + last[2], pools[-1][3], last[4]]
    if not pools:
        return Isotonic(np.array([0.0]), np.array([0.5]))
    xs, ys = [], []
    for _, c, p, lo, hi in pools:
        for at in dict.fromkeys((lo, hi)):
            xs.append(at)
            ys.append((p + 0.5) / (c + 1))
    return Isotonic(np.array(xs), np.maximum.accumulate(ys))


def calibrate(scored: DataFrame, bins: int = 2000, lo: float = -0.5, hi: float = 1.5) -> Isotonic:
    """Isotonic calibration of scored(raw, y). Only a histogram of `bins` bins comes to the driver."""
    k = F.least(F.greatest(F.floor((F.col("raw") - lo) * (bins / (hi - lo))), F.lit(0)), F.lit(bins - 1))
    rows = scored.groupBy(k.alias("k")).agg(F.avg("raw").alias("x"), F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")).collect()
    return pool_adjacent([r.x for r in rows], [r.n for r in rows], [r.pos for r in rows])


def labelled(rows: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """rows(doc_id, ...) with y, the label of each labelled row; labels that are null or neither 0 nor 1 are left out."""
    ys = labels.where(F.col(label).isin(0, 1)).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("y"))
    return rows.join(ys, "doc_id")

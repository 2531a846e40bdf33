"""A kernel machine for large tables: random Fourier features, a linear machine, Platt scaling.

The cosine features approximate the Gaussian kernel, so that a linear machine
over them separates what a kernel machine would; it is fitted by Spark. A logistic
curve over its decision values, fitted on rows that the machine has not seen,
gives probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialise

#: Random features.
DIM = 256


@dataclass
class Kernel:
    """Means and spreads of the inputs, random frequencies and phases, and what was fitted on them."""

    inputs: list[str]
    mean: np.ndarray
    spread: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray | None = None
    intercept: float = 0.0
    slope: float = 1.0
    offset: float = 0.0

    def map(self, x: np.ndarray) -> np.ndarray:
        """Features of rows of inputs; nulls count as the mean."""
        scaled = np.nan_to_num((x - self.mean) / self.spread)
        return np.sqrt(2 / len(self.phases)) * np.cos(scaled @ self.frequencies + self.phases)

    def decide(self, x: np.ndarray) -> np.ndarray:
        return self.map(x) @ self.weights + self.intercept

    def _inputs(self) -> Column:
        return F.struct(*[F.col(c).cast("double").alias(c) for c in self.inputs])

    def features(self) -> Column:
        own = self

        @F.pandas_udf("array<double>")
        def run(rows: pd.DataFrame) -> pd.Series:
            return pd.Series(list(own.map(rows.to_numpy(float))))

        return array_to_vector(run(self._inputs()))

    def decision(self) -> Column:
        """The side of the machine that a row is on, and how far."""
        own = self

        @F.pandas_udf("double")
        def run(rows: pd.DataFrame) -> pd.Series:
            return pd.Series(own.decide(rows.to_numpy(float)))

        return run(self._inputs())

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-(self.slope * self.decision() + self.offset)))


def balanced(df: DataFrame, label: str) -> DataFrame:
    """``df`` with a weight that makes both labels count alike."""
    n = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    total = sum(n.values())
    return df.withColumn("_weight", F.when(F.col(label) == 1, total / (2 * n.get(1, 1))).otherwise(total / (2 * n.get(0, 1))))


def kernel_of(df: DataFrame, inputs: list[str], dim: int = DIM, gamma: float | None = None, seed: int = 42) -> Kernel:
    """Random features of a Gaussian kernel over inputs scaled to unit variance; ``gamma`` is one over their number where None."""
    s = df.select(*[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in inputs for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    of = lambda n: np.array([s[f"{n}_{c}"] or 0.0 for c in inputs])
    r = np.random.default_rng(seed)
    gamma = gamma or 1 / len(inputs)
    return Kernel(inputs, of("m"), np.where(of("s") > 0, of("s"), 1.0), r.standard_normal((len(inputs), dim)) * np.sqrt(2 * gamma), r.uniform(0, 2 * np.pi, dim))


def fit(df: DataFrame, inputs: list[str], label: str, id_col: str, dim: int = DIM, gamma: float | None = None, regularisation: float = 1e-3, seed: int = 42) -> Kernel | None:
    """A calibrated machine of rows with a 0/1 label; None unless both parts hold both labels.

    Two thirds of the rows, by a hash of ``id_col``, fit the machine and the
    rest its probabilities. Rows without label are left out; null inputs count
    as the mean.
    """
    d = df.filter(F.col(label).isNotNull()).withColumn("_fits", F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(3)) > 0)
    parts = {(r["_fits"], r[label]) for r in d.select("_fits", label).distinct().collect()}
    if len(parts) < 4:
        return None
    k = kernel_of(d.filter("_fits"), inputs, dim, gamma, seed)
    mapped = materialise(balanced(d.filter("_fits"), label).select(k.features().alias("features"), F.col(label).cast("double").alias("label"), "_weight"), "kernel")
    machine = LinearSVC(maxIter=60, regParam=regularisation, weightCol="_weight", standardization=False).fit(mapped)
    k.weights, k.intercept = machine.coefficients.toArray(), float(machine.intercept)
    side = balanced(d.filter("not _fits"), label).select(array_to_vector(F.array(k.decision())).alias("features"), F.col(label).cast("double").alias("label"), "_weight")
    curve = LogisticRegression(maxIter=50, weightCol="_weight").fit(side)
    k.slope, k.offset = float(curve.coefficients[0]), float(curve.intercept)
    discard(mapped)
    return k

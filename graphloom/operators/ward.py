"""Ward clustering of a bounded sample, and every row to the nearest centre.

Agglomerative clustering looks at all pairs, so it runs on a sample whose size
is a parameter: nearest-neighbour chains with the Lance-Williams update, which
need one distance matrix and give the merges of the plain algorithm. The
centres of the clusters that remain then take in all rows, in Spark.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that are clustered at most; their distances take 8 bytes a pair on the driver.
SAMPLE = 2000


def merges(points: np.ndarray) -> list[tuple[int, int, float]]:
    """(a, b, height) of all merges in ascending order of height; clusters are named by their least point.

    The height is the Ward distance, sqrt(2 n m / (n + m)) times that of the
    centres. A chain of nearest neighbours grows until two are each other's
    nearest; those are merged. Ties go to the lower name.
    """
    n = len(points)
    square = (points * points).sum(1)
    d = np.maximum(0.0, square[:, None] + square[None] - 2 * points @ points.T)
    np.fill_diagonal(d, np.inf)
    size, live, out = np.ones(n), np.ones(n, bool), []
    chain: list[int] = []
    while len(out) < n - 1:
        if not chain:
            chain.append(int(np.argmax(live)))
        while True:
            a = chain[-1]
            b = int(np.argmin(d[a]))
            if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
                b = chain[-2]  # a tie must not lead on for ever
            if len(chain) > 1 and b == chain[-2]:
                break
            chain.append(b)
        chain = chain[:-2]
        a, b = min(a, b), max(a, b)
        height = d[a, b]
        out.append((a, b, float(np.sqrt(height))))
        rest = live.copy()
        rest[[a, b]] = False
        na, nb, nc = size[a], size[b], size[rest]
        new = ((na + nc) * d[a, rest] + (nb + nc) * d[b, rest] - nc * height) / (na + nb + nc)
        d[a, rest] = d[rest, a] = new
        d[b], d[:, b] = np.inf, np.inf
        size[a], live[b] = na + nb, False
    # clusters are named by their least point, whatever the order of the chains
    return sorted(out, key=lambda m: (m[2], m[0], m[1]))


def labels(points: np.ndarray, k: int) -> np.ndarray:
    """The cluster 0, 1... of each point after all but k - 1 merges, in the order of first points."""
    n = len(points)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b, _ in merges(points)[: max(0, n - k)]:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return np.unique([find(i) for i in range(n)], return_inverse=True)[1]


def centres(features: DataFrame, id_col: str, k: int = 8, sample: int = SAMPLE, seed: int = 42, column: str = "features") -> np.ndarray:
    """Means of the k Ward clusters of at most ``sample`` rows, those of the least hash of ``id_col``; fewer rows than k give as many centres."""
    n = features.filter(F.col(column).isNotNull()).count()
    h = F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(1 << 40))
    share = min(1.0, (sample + 6 * sample**0.5 + 10) / max(1, n))  # only about the sample is ordered
    few = features.filter(F.col(column).isNotNull() & (h < int(share * (1 << 40)))).orderBy(h, id_col).limit(sample)
    rows = few.select(id_col, vector_to_array(column).alias("v")).collect()
    if not rows:
        return np.empty((0, 0))
    points = np.array([r.v for r in sorted(rows, key=lambda r: str(r[0]))], float)
    own = labels(points, k)
    return np.stack([points[own == c].mean(0) for c in range(own.max() + 1)])


def assigned(features: DataFrame, means: np.ndarray, column: str = "features") -> DataFrame:
    """``features`` with cluster, the nearest of the means, the first of equals; null where there are none or the row has no features."""
    if not len(means):
        return features.withColumn("cluster", F.lit(None).cast("int"))
    half = (means * means).sum(1) / 2

    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        have = v.notna().to_numpy()
        out = np.full(len(v), -1)
        if have.any():
            out[have] = (half - np.stack(v[have].to_list()) @ means.T).argmin(1)
        return pd.Series(out, dtype="int32")

    c = nearest(F.when(F.col(column).isNotNull(), vector_to_array(column)))
    return features.withColumn("cluster", c).withColumn("cluster", F.when(F.col("cluster") >= 0, F.col("cluster")))


def ward(features: DataFrame, id_col: str, k: int = 8, sample: int = SAMPLE, seed: int = 42) -> DataFrame:
    """``features`` with cluster: Ward clusters of a sample, and all rows to the nearest centre.

    Rows without features have no cluster; repeated rows fall into one; an empty table stays empty.
    """
    return assigned(features, centres(features, id_col, k, sample, seed))

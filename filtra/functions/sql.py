"""Names for SQL: table functions over clouds and scalar functions on diagrams."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filtra.functions import assign
from filtra.functions import reduce as R


class VrPersistence:
    """TABLE(cloud) PARTITION BY cloud_id, columns cloud_id, point_id, coords: its Vietoris-Rips pairs to dimension 1."""

    def __init__(self):
        self.rows: list = []

    def eval(self, row):
        self.rows.append((row["point_id"], row["coords"], row["cloud_id"]))

    def terminate(self):
        if self.rows:
            self.rows.sort(key=lambda r: r[0])
            for dim, birth, death in R.vr_pairs(R.distances(np.array([r[1] for r in self.rows], float)), 1):
                yield str(self.rows[0][2]), dim, birth, death


def register(spark: SparkSession) -> None:
    """vr_persistence (table), diagram_wasserstein and diagram_bottleneck (arrays of birth and death)."""
    spark.udtf.register("vr_persistence", F.udtf(VrPersistence, returnType="diagram_id string, dim int, birth double, death double"))

    def pairs(x) -> np.ndarray:
        return np.array([(p["birth"], p["death"]) for p in x], float).reshape(-1, 2) if x is not None and len(x) else np.zeros((0, 2))

    @F.pandas_udf(T.DoubleType())
    def wasserstein(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([assign.wasserstein(pairs(x), pairs(y)) for x, y in zip(a, b)])

    @F.pandas_udf(T.DoubleType())
    def bottleneck(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([assign.bottleneck(pairs(x), pairs(y)) for x, y in zip(a, b)])

    spark.udf.register("diagram_wasserstein", wasserstein)
    spark.udf.register("diagram_bottleneck", bottleneck)


def entropy_of(values: list[float]) -> float:
    """-sum p ln p of the shares of the positive finite values."""
    v = [x for x in values if math.isfinite(x) and x > 0]
    total = sum(v)
    return -sum(x / total * math.log(x / total) for x in v) if total > 0 else 0.0

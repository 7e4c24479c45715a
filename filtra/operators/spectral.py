"""Spectra of Laplacians given as sparse entries, sheaf Laplacians, embeddings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filtra.schema import EPS


def _dense(pdf: pd.DataFrame) -> tuple[np.ndarray, list]:
    names = sorted({*map(_key, pdf["row"]), *map(_key, pdf["col"])})
    at = {n: i for i, n in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for r, c, v in zip(pdf["row"], pdf["col"], pdf["value"]):
        m[at[_key(r)], at[_key(c)]] += v
    return m, names


def _key(x: object) -> object:
    return tuple(int(i) for i in x) if isinstance(x, (list, tuple, np.ndarray)) else x


def spectrum(entries: DataFrame, key: str = "cloud_id", smallest: int | None = None) -> DataFrame:
    """(key, i, eigenvalue) of each group's symmetric matrix (row, col, value), rising."""

    def one(k, pdf: pd.DataFrame) -> pd.DataFrame:
        values = np.linalg.eigvalsh(_dense(pdf)[0])[:smallest]
        return pd.DataFrame({key: str(k[0]), "i": range(len(values)), "eigenvalue": np.where(np.abs(values) < 1e-9, 0.0, values)})

    return entries.select(key, "row", "col", "value").groupBy(key).applyInPandas(one, f"{key} string, i int, eigenvalue double")


def spectral_features(values: DataFrame, key: str = "cloud_id", time: float = 1.0) -> DataFrame:
    """Kernel dimension, spectral gap, Cheeger bounds gap/2 and sqrt(2 gap), heat trace, entropy, of eigenvalues."""
    x = F.col("eigenvalue")
    gap = F.coalesce(F.min(F.when(x > 1e-9, x)), F.lit(0.0))
    total, weighted = F.sum(F.when(x > EPS, x)), F.sum(F.when(x > EPS, x * F.log(x)))
    return values.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.abs(x) <= 1e-9).alias("nullity"),
        gap.alias("gap"),
        (gap / 2).alias("cheeger_low"),
        F.sqrt(2 * gap).alias("cheeger_high"),
        F.sum(F.exp(-x * time)).alias("heat_trace"),
        F.coalesce(F.log(total) - weighted / total, F.lit(0.0)).alias("entropy"),
        F.max(x).alias("radius"),
    )


def embedding(entries: DataFrame, dims: int, key: str = "cloud_id", time: float | None = None) -> DataFrame:
    """(key, vertex, coords): eigenvectors after the kernel's first, scaled by exp(-time eigenvalue) if time is given.

    A vector's largest entry is made positive, so that reruns agree.
    """

    def one(k, pdf: pd.DataFrame) -> pd.DataFrame:
        m, names = _dense(pdf)
        values, vectors = np.linalg.eigh(m)
        v = vectors[:, 1 : dims + 1]
        v = v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])
        if time is not None:
            v = v * np.exp(-time * values[1 : dims + 1])
        return pd.DataFrame({key: str(k[0]), "vertex": [str(n) for n in names], "coords": v.tolist()})

    return entries.select(key, "row", "col", "value").groupBy(key).applyInPandas(one, f"{key} string, vertex string, coords array<double>")


def spectral_clusters(entries: DataFrame, k: int, key: str = "cloud_id") -> DataFrame:
    """(key, vertex, cluster): k-means on the first k eigenvectors."""
    from filtra.operators.mapper import kmeans

    def one(kk, pdf: pd.DataFrame) -> pd.DataFrame:
        m, names = _dense(pdf)
        label = kmeans(np.linalg.eigh(m)[1][:, :k], k)
        return pd.DataFrame({key: str(kk[0]), "vertex": [str(n) for n in names], "cluster": label})

    return entries.select(key, "row", "col", "value").groupBy(key).applyInPandas(one, f"{key} string, vertex string, cluster int")


def dirac(boundary: DataFrame, key: str = "cloud_id") -> DataFrame:
    """Entries of the Dirac operator: every boundary and its transpose, rows and columns being simplices."""
    b = boundary.select(key, "row", "col", F.col("sign").alias("value"))
    return b.unionByName(b.select(key, F.col("col").alias("row"), F.col("row").alias("col"), "value"))


def sheaf_laplacian(edges: DataFrame, maps: DataFrame) -> DataFrame:
    """(row, i, col, j, value): the Laplacian of a cellular sheaf on a graph (src, dst).

    maps: restriction entries (vertex, edge_src, edge_dst, i, stalk row a, value) as
    (vertex, src, dst, a, i, value). The coboundary of an edge is its dst map less its
    src map; the Laplacian is its transpose times itself, a join on (edge, a).
    """
    sign = F.when(F.col("vertex") == F.col("dst"), F.lit(1.0)).otherwise(F.lit(-1.0))
    m = maps.join(edges.select("src", "dst"), ["src", "dst"], "left_semi").withColumn("s", sign * F.col("value"))
    x = m.select("src", "dst", "a", F.col("vertex").alias("row"), "i", F.col("s").alias("x"))
    y = m.select("src", "dst", "a", F.col("vertex").alias("col"), F.col("i").alias("j"), F.col("s").alias("y"))
    return x.join(y, ["src", "dst", "a"]).groupBy("row", "i", "col", "j").agg(F.sum(F.col("x") * F.col("y")).alias("value")).where("value <> 0")


def spectral_anomalies(values: DataFrame, key: str = "cloud_id", limit: float = 3.0) -> DataFrame:
    """Groups whose spectral gap lies over `limit` deviations from the mean of all."""
    f = spectral_features(values, key)
    s = f.agg(F.avg("gap").alias("m"), F.stddev_pop("gap").alias("s"))
    z = F.abs(F.col("gap") - F.col("m")) / F.greatest("s", F.lit(EPS))
    return f.crossJoin(F.broadcast(s)).select(key, "gap", z.alias("z"), (z > limit).alias("anomaly"))

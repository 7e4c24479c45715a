"""Mapper graphs: filter, cover, clusters in each cover set, and the overlaps of these."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filtra.functions.reduce import distances, find
from filtra.operators.graph import components, point_forest
from filtra.plans.tables import cut
from filtra.schema import choice

_NODES = "cover_index long, cluster int, point_id long"


def coordinate_filter(points: DataFrame, axis: int = 0) -> DataFrame:
    return points.withColumn("lens", F.get("coords", F.lit(axis)))


def eccentricity_filter(points: DataFrame) -> DataFrame:
    """Distance to the mean of all points."""
    one = points.select(F.posexplode("coords").alias("axis", "x")).groupBy("axis").agg(F.avg("x").alias("m"))
    mean = one.agg(F.transform(F.array_sort(F.collect_list(F.struct("axis", "m"))), lambda s: s["m"]).alias("mean"))
    gap = F.zip_with("coords", "mean", lambda x, m: (x - m) * (x - m))
    return points.crossJoin(F.broadcast(mean)).withColumn("lens", F.sqrt(F.aggregate(gap, F.lit(0.0), lambda t, x: t + x))).drop("mean")


def pca_filter(points: DataFrame) -> DataFrame:
    """Projection on the first principal axis, its sign so that the largest entry is positive."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = points.withColumn("_v", array_to_vector("coords"))
    model = PCA(k=1, inputCol="_v", outputCol="_p").fit(data)
    axis = np.asarray(model.pc.toArray()).ravel()
    sign = 1.0 if axis[np.argmax(np.abs(axis))] >= 0 else -1.0
    return model.transform(data).withColumn("lens", vector_to_array("_p")[0] * sign).drop("_v", "_p")


def interval_cover(points: DataFrame, resolution: int = 10, overlap: float = 0.25, wide: bool = False) -> DataFrame:
    """points with cover_index: closed intervals of equal width over the padded range of the lens.

    The range is padded by one hundredth on both sides, and each interval reaches half
    the overlap (wide: the whole, without padding) into its neighbours. A point goes
    to every interval that holds it; empty intervals get no index.
    """
    span = points.agg(F.min("lens").alias("a"), F.max("lens").alias("b"))
    pad = F.lit(0.0 if wide else 0.01) * (F.col("b") - F.col("a"))
    span = span.select((F.col("a") - pad).alias("lo"), (F.col("b") + pad).alias("hi"))
    step = (F.col("hi") - F.col("lo")) / float(resolution)
    reach = step * overlap * (1.0 if wide else 0.5)
    held: Column = F.filter(
        F.sequence(F.lit(0), F.lit(resolution - 1)),
        lambda i: (F.col("lens") >= F.col("lo") + i * step - reach) & (F.col("lens") <= F.col("lo") + (i + 1) * step + reach),
    )
    held = F.when(F.col("hi") > F.col("lo"), held).otherwise(F.array(F.lit(0)))
    p = points.crossJoin(F.broadcast(span)).withColumn("raw", F.explode(held)).drop("lo", "hi")
    index = p.select("raw").distinct().withColumn("cover_index", F.dense_rank().over(Window.orderBy("raw")).cast("long") - 1)
    return p.join(F.broadcast(index), "raw").drop("raw")  # at most `resolution` rows


def density_filter(points: DataFrame, radius: float) -> DataFrame:
    """The number of other points within radius."""
    from filtra.operators.distance import radius_count

    return points.join(radius_count(points, radius), ["cloud_id", "point_id"]).withColumn("lens", F.col("degree").cast("double")).drop("degree")


def grid_cover(points: DataFrame, lenses: list[Column], resolution: int = 10, overlap: float = 0.25) -> DataFrame:
    """points with cover_index: boxes that are products of one interval cover for each lens.

    A box that holds no point gets no index; boxes are numbered in the order of their intervals.
    """
    p, names = points, []
    for i, lens in enumerate(lenses):
        p = interval_cover(p.withColumn("lens", lens), resolution, overlap).drop("lens").withColumnRenamed("cover_index", f"_box{i}")
        names.append(f"_box{i}")
    index = p.select(*names).distinct().withColumn("cover_index", F.dense_rank().over(Window.orderBy(*names)).cast("long") - 1)
    return p.join(F.broadcast(index), names).drop(*names)  # at most resolution ^ lenses rows


def unit_cover(points: DataFrame, resolution: int = 10, overlap: float = 0.5) -> DataFrame:
    """points with cover_index: lenses in [0, 1] under intervals of width 1 / (resolution - (resolution - 1) overlap)."""
    width = 1.0 / (resolution - (resolution - 1) * overlap)
    start = lambda i: i * F.lit(width * (1 - overlap))
    held = F.filter(F.sequence(F.lit(0), F.lit(resolution - 1)), lambda i: (F.col("lens") >= start(i)) & (F.col("lens") <= start(i) + width))
    return points.withColumn("cover_index", F.explode(held)).withColumn("cover_index", F.col("cover_index").cast("long"))


def dbscan(x: np.ndarray, eps: float, least: int) -> np.ndarray:
    """Labels from 0, -1 for noise; eps is closed, a point counts itself, a border point joins its first cluster."""
    near = distances(x) <= eps
    core = near.sum(1) >= least
    label = np.full(len(x), -1)
    k = 0
    for i in range(len(x)):
        if not core[i] or label[i] >= 0:
            continue
        edge = [i]
        label[i] = k
        while edge:
            j = edge.pop()
            for n in np.flatnonzero(near[j] & (label < 0)):
                label[n] = k
                if core[n]:
                    edge.append(int(n))
        k += 1
    return label


def single_linkage(x: np.ndarray, eps: float) -> np.ndarray:
    """Labels of the components of distances of at most eps, numbered by first point."""
    parent = list(range(len(x)))
    for u, v in zip(*np.nonzero(np.triu(distances(x) <= eps, 1))):
        a, b = find(parent, int(u)), find(parent, int(v))
        parent[max(a, b)] = min(a, b)
    roots = [find(parent, i) for i in range(len(x))]
    number = {r: k for k, r in enumerate(dict.fromkeys(roots))}
    return np.array([number[r] for r in roots])


def kmeans(x: np.ndarray, k: int, rounds: int = 20, seed: int = 7) -> np.ndarray:
    """Labels by Lloyd's rounds from centres drawn with probability by the squared distance to those before."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(x)))]
    gap = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k and gap.max(initial=0.0) > 0:
        chosen.append(int(rng.choice(len(x), p=gap / gap.sum())))
        gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(1))
    centre = x[chosen]
    label = np.zeros(len(x), int)
    for _ in range(rounds):
        label = np.linalg.norm(x[:, None] - centre[None], axis=2).argmin(1)
        centre = np.array([x[label == j].mean(0) if (label == j).any() else centre[j] for j in range(len(centre))])
    return label


def cluster_cover(covered: DataFrame, how: str = "connected", eps: float = 0.5, least: int = 3, k: int = 2) -> DataFrame:
    """(cover_index, cluster, point_id): connected (one cluster), single_linkage, dbscan or kmeans in each set."""
    choice(how, "how", ("connected", "single_linkage", "dbscan", "kmeans"))
    if how == "connected":
        return covered.select("cover_index", F.lit(0).alias("cluster"), "point_id")
    if how == "single_linkage":
        return _linked_cover(covered, eps)

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id")
        x = np.array(pdf["coords"].tolist(), dtype=float)
        label = dbscan(x, eps, least) if how == "dbscan" else single_linkage(x, eps) if how == "single_linkage" else kmeans(x, k)
        out = pd.DataFrame({"cover_index": key[0], "cluster": label, "point_id": pdf["point_id"].to_numpy()})
        return out[out["cluster"] >= 0]

    return covered.select("cover_index", "point_id", "coords").groupBy("cover_index").applyInPandas(one, _NODES)


def _linked_cover(covered: DataFrame, eps: float) -> DataFrame:
    """single_linkage in each set: the components of its point forest's edges of at most eps, so that no task holds a set's pairs."""
    p = cut(covered.select(F.col("cover_index").alias("cloud_id"), "point_id", "coords"))
    name = lambda c: F.struct(F.col("cloud_id").alias("c"), F.col(c).alias("p"))
    e = point_forest(p).where(F.col("dist") <= eps).select(name("src").alias("src"), name("dst").alias("dst"))
    of = cut(components(p.select(name("point_id").alias("v")), e))
    number = F.dense_rank().over(Window.partitionBy("component.c").orderBy("component.p")) - 1
    number = of.select("component").distinct().select("component", number.alias("cluster"))
    return of.join(number, "component").select(F.col("v.c").alias("cover_index"), F.col("cluster").cast("int").alias("cluster"), F.col("v.p").alias("point_id"))


def nodes(membership: DataFrame) -> DataFrame:
    """(node, cover_index, cluster, size): a row a cluster, numbered by cover index and cluster."""
    n = membership.groupBy("cover_index", "cluster").agg(F.count(F.lit(1)).alias("size"))
    return n.withColumn("node", F.row_number().over(Window.orderBy("cover_index", "cluster")).cast("long") - 1)


def overlap_edges(membership: DataFrame, named: DataFrame) -> DataFrame:
    """(source, target, shared, weight): clusters that share points, by the Jaccard index."""
    m = membership.join(named, ["cover_index", "cluster"]).select("node", "point_id", "size")
    a = m.select("point_id", F.col("node").alias("source"), F.col("size").alias("sa"))
    b = m.select("point_id", F.col("node").alias("target"), F.col("size").alias("sb"))
    e = a.join(b, "point_id").where("source < target").groupBy("source", "target").agg(F.count(F.lit(1)).alias("shared"), F.first("sa").alias("sa"), F.first("sb").alias("sb"))
    return e.select("source", "target", "shared", (F.col("shared") / (F.col("sa") + F.col("sb") - F.col("shared"))).alias("weight"))


def mapper(points: DataFrame, lens: str = "coordinate", resolution: int = 10, overlap: float = 0.25, how: str = "connected", **options: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(membership, nodes, edges) of the Mapper graph of one cloud."""
    filters = {"coordinate": coordinate_filter, "eccentricity": eccentricity_filter, "pca": pca_filter, "given": lambda p: p}
    covered = interval_cover(filters[choice(lens, "lens", tuple(filters))](points), resolution, overlap)
    member = cluster_cover(covered, how, **options)
    named = nodes(member)
    return member, named, overlap_edges(member, named)

"""Distances, range joins and nearest neighbours within clouds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filtra.functions.metrics import between
from filtra.functions.metrics import metric as metric_of
from filtra.operators import blocks
from filtra.schema import EPS, INF


def _sides(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    a = points.select("cloud_id", F.col("point_id").alias("src"), F.col("coords").alias("a"))
    b = points.select("cloud_id", F.col("point_id").alias("dst"), F.col("coords").alias("b"))
    return a, b


def pairwise(points: DataFrame, metric="euclidean") -> DataFrame:
    """(cloud_id, src, dst, dist) of all pairs src < dst of each cloud.

    An equi-join on the cloud: quadratic in a cloud, so for clouds of more than
    some ten thousand points take range_edges or nearest instead.
    """
    a, b = _sides(points)
    d = metric_of(metric)
    return a.join(b, "cloud_id").where("src < dst").select("cloud_id", "src", "dst", d(F.col("a"), F.col("b")).alias("dist"))


def cross_distances(left: DataFrame, right: DataFrame, metric="euclidean") -> DataFrame:
    """Distances from every point of left to every point of right of the same cloud."""
    a, b = _sides(left)[0], _sides(right)[1]
    return a.join(b, "cloud_id").select("cloud_id", "src", "dst", metric_of(metric)(F.col("a"), F.col("b")).alias("dist"))


def pair_statistics(points: DataFrame, metric: str = "euclidean", others: DataFrame | None = None) -> DataFrame:
    """(cloud_id, n, total, low, high): number, sum, least and largest of the distances of all pairs of each cloud.

    With others: of every point to every one of the cloud's others. Equal points count
    once, with a weight; two blocks meet in a task and only four numbers leave it.
    """

    def solve(left, right, same):
        x, y = blocks.matrix_of(left["coords"]), blocks.matrix_of(right["coords"])
        wx, wy = np.asarray(left["w"]), np.asarray(right["w"])
        n, total, low, high = 0, 0.0, np.inf, -np.inf
        for rows, d in between(x, y, metric):
            w = wx[rows, None] * wy[None, :]
            if same:  # each pair of different points once, and the pairs of equal ones
                at = np.arange(rows.start, rows.stop)
                w[np.arange(len(x))[None, :] < at[:, None]] = 0
                w[np.arange(len(at)), at] = wx[rows] * (wx[rows] - 1) // 2
                d = np.where(w > 0, d, 0.0)
                there = w > 0
                if not there.any():
                    continue
                low, high = min(low, np.min(d, where=there, initial=np.inf)), max(high, np.max(d, where=there, initial=-np.inf))
            else:
                low, high = min(low, d.min()), max(high, d.max())
            n += int(w.sum())
            total += float((d * w).sum())
        if n:
            yield {"n": np.array([n]), "total": np.array([total]), "low": np.array([low]), "high": np.array([high])}

    once = lambda p: p.groupBy("cloud_id", "coords").agg(F.count(F.lit(1)).alias("w"))
    schema = f"cloud_id {dict(points.dtypes)['cloud_id']}, n long, total double, low double, high double"
    parts = blocks.block_pairs(once(points), solve, schema) if others is None else blocks.block_crossings(once(points), once(others), solve, schema)
    return parts.groupBy("cloud_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))


def range_edges(points: DataFrame, radius: float, metric="euclidean", grid_dims: int = 3) -> DataFrame:
    """Pairs src < dst at most radius apart.

    Points are dealt into cells of side radius over the first grid_dims coordinates;
    each cell meets its neighbours in a group, which gives its points' edges in
    batches, so that only points are shuffled. Euclidean, Manhattan and Chebyshev
    distances, which are at least every coordinate's difference, find all their
    pairs so; others compare all pairs of a cloud.
    """
    if metric not in _BLOCKWISE or not 0 < radius < INF:
        return pairwise(points, metric).where(F.col("dist") <= radius)
    return _cell_edges(points, radius, metric, grid_dims)


def _cell_edges(points: DataFrame, radius: float, metric: str, grid_dims: int, carry: str | None = None) -> DataFrame:
    def fold(cell):
        for u, v, d in cell.edges():
            mean = {"mean": (cell.extra[carry][u] + cell.extra[carry][v]) / 2} if carry else {}
            yield {"src": cell.ids[u], "dst": cell.ids[v], "dist": d} | mean

    kind = dict(points.dtypes)
    p = points.select("cloud_id", "point_id", "coords", *([carry] if carry else []))
    schema = f"cloud_id {kind['cloud_id']}, src {kind['point_id']}, dst {kind['point_id']}, dist double" + (", mean double" if carry else "")
    return blocks.cells(p, radius, fold, schema, _BLOCKWISE[metric], grid_dims)


def range_edges_between(points: DataFrame, radius: float, carry: str, metric="euclidean", grid_dims: int = 3) -> DataFrame:
    """range_edges with `mean`, of the column `carry` of their two points, which travels with the points."""
    return _cell_edges(points, radius, metric, grid_dims, carry)


#: Points of a block of `nearest`: a task holds two blocks, and one block's distances to the other.
NEAREST_BLOCK = 2048
_BLOCKWISE = {"euclidean": "l2", "l2": "l2", "manhattan": "l1", "cityblock": "l1", "l1": "l1", "chebyshev": "linf", "linf": "linf"}


def nearest(points: DataFrame, k: int = 5, metric="euclidean", queries: DataFrame | None = None, itself: bool = False) -> DataFrame:
    """(cloud_id, src, dst, dist, rank): the k nearest points, ties by dst; `itself`: a point counts as its own neighbour.

    Euclidean, Manhattan and Chebyshev distances are found block by block: a cloud's
    points are dealt into blocks, every query block meets every block in a group of
    its own, and only the k nearest of each leave it. So no task holds a cloud, and
    the final ranking sees k rows a point and block. Other metrics join all pairs.
    """
    if isinstance(metric, str) and metric in _BLOCKWISE:
        rows = _nearest_in_blocks(points, k, _BLOCKWISE[metric], queries, itself)
    else:
        a, b = _sides(points if queries is None else queries)[0], _sides(points)[1]
        rows = a.join(b, "cloud_id")
        if queries is None and not itself:
            rows = rows.where("src <> dst")
        rows = rows.select("cloud_id", "src", "dst", metric_of(metric)(F.col("a"), F.col("b")).alias("dist"))
    order = Window.partitionBy("cloud_id", "src").orderBy("dist", "dst")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _nearest_in_blocks(points: DataFrame, k: int, norm: str, queries: DataFrame | None, itself: bool) -> DataFrame:
    import numpy as np
    import pandas as pd

    size = points.groupBy("cloud_id").agg(F.ceil(F.count(F.lit(1)) / NEAREST_BLOCK).cast("int").alias("n"))
    asked = (points if queries is None else queries).select("cloud_id", "point_id", "coords")
    others_only = queries is None and not itself
    own = F.pmod(F.xxhash64("point_id"), F.col("n")).cast("int")
    all_ = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    a = asked.join(size, "cloud_id").select("cloud_id", "point_id", "coords", own.alias("i"), all_.alias("j"), F.lit(True).alias("asks"))
    b = points.join(size, "cloud_id").select("cloud_id", "point_id", "coords", all_.alias("i"), own.alias("j"), F.lit(False).alias("asks"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["asks"].to_numpy()
        x, y = (np.array(pdf["coords"][m].tolist(), float) for m in (asks, ~asks))
        src, dst = pdf["point_id"][asks].to_numpy(), pdf["point_id"][~asks].to_numpy()
        out = []
        order = np.argsort(dst, kind="stable")
        y, dst = y[order], dst[order]
        step = max(1, (1 << 22) // max(1, y.size))
        for at in range(0, len(x), step):
            gap = np.abs(x[at : at + step, None, :] - y[None, :, :])
            d = np.sqrt((gap * gap).sum(-1)) if norm == "l2" else gap.sum(-1) if norm == "l1" else gap.max(-1)
            if others_only:
                d[src[at : at + step, None] == dst[None, :]] = np.inf
            best = np.argsort(d, axis=1, kind="stable")[:, :k]
            rows = np.repeat(np.arange(len(d)), best.shape[1])
            out.append((src[at + rows], dst[best.ravel()], d[rows, best.ravel()]))
        s, t, d = (np.concatenate(c) for c in zip(*out)) if out else ([], [], [])
        found = pd.DataFrame({"cloud_id": pdf["cloud_id"].iloc[0], "src": s, "dst": t, "dist": d})
        return found[found["src"] != found["dst"]] if others_only else found

    kind = dict(points.dtypes)
    schema = f"cloud_id {kind['cloud_id']}, src {dict(asked.dtypes)['point_id']}, dst {kind['point_id']}, dist double"
    return a.unionByName(b).groupBy("cloud_id", "i", "j").applyInPandas(solve, schema)


def radius_count(points: DataFrame, radius: float, metric="euclidean") -> DataFrame:
    """Number of other points within radius of each point."""
    e = range_edges(points, radius, metric)
    ends = e.select("cloud_id", F.col("src").alias("point_id")).unionAll(e.select("cloud_id", F.col("dst").alias("point_id")))
    count = ends.groupBy("cloud_id", "point_id").agg(F.count(F.lit(1)).alias("degree"))
    return points.select("cloud_id", "point_id").join(count, ["cloud_id", "point_id"], "left").fillna(0, ["degree"])


def matrix_to_edges(matrix: DataFrame) -> DataFrame:
    """(cloud_id, row, values array) to edges; the diagonal and the lower half are dropped."""
    e = matrix.select("cloud_id", F.col("row").alias("src"), F.posexplode("values").alias("dst", "dist"))
    return e.where("src < dst").select("cloud_id", "src", F.col("dst").cast("long").alias("dst"), "dist")


def sparsify(edges: DataFrame, most: float) -> DataFrame:
    """Finite edges of at most this length."""
    return edges.where((F.col("dist") <= most) & ~F.isnan("dist") & (F.col("dist") < INF))


def normalise_coords(points: DataFrame, how: str = "minmax") -> DataFrame:
    """Each coordinate of a cloud to [0, 1], or to mean 0 and population deviation 1."""
    one = points.select("cloud_id", "point_id", F.posexplode("coords").alias("axis", "x"))
    w = Window.partitionBy("cloud_id", "axis")
    if how == "minmax":
        low, high = F.min("x").over(w), F.max("x").over(w)
        y = (F.col("x") - low) / F.greatest(high - low, F.lit(EPS))
    else:
        y = (F.col("x") - F.avg("x").over(w)) / F.greatest(F.stddev_pop("x").over(w), F.lit(EPS))
    one = one.withColumn("y", y)
    back = F.transform(F.array_sort(F.collect_list(F.struct("axis", "y"))), lambda s: s["y"])
    return one.groupBy("cloud_id", "point_id").agg(back.alias("coords"))


def random_projection(points: DataFrame, target: int, dim: int, seed: int = 42) -> DataFrame:
    """Johnson-Lindenstrauss projection by a fixed Gaussian matrix of target x dim entries."""
    import numpy as np

    rows = np.random.default_rng(seed).normal(0, 1 / target**0.5, (target, dim))
    coords: list[Column] = []
    for row in rows:
        w = F.array(*[F.lit(float(x)) for x in row])
        coords.append(F.aggregate(F.zip_with("coords", w, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + F.coalesce(x, F.lit(0.0))))
    return points.withColumn("coords", F.array(*coords))


def data_quality(points: DataFrame) -> DataFrame:
    """A row a cloud: points, distinct positions, NaN and infinite coordinates, range."""
    bad = F.aggregate("coords", F.lit(0), lambda t, x: t + F.when(F.isnan(x), 1).otherwise(0))
    far = F.aggregate("coords", F.lit(0), lambda t, x: t + F.when(F.abs(x) == INF, 1).otherwise(0))
    return points.groupBy("cloud_id").agg(
        F.count(F.lit(1)).alias("n_points"),
        F.countDistinct("coords").alias("n_distinct"),
        F.sum(bad).alias("n_nan"),
        F.sum(far).alias("n_infinite"),
        F.min(F.array_min("coords")).alias("lowest"),
        F.max(F.array_max("coords")).alias("highest"),
    )

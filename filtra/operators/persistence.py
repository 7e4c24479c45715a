"""Persistence diagrams of clouds, edges, complexes, events and grids.

A cloud is one group: clouds are reduced in parallel, each by the in-memory reducer,
within a simplex budget. A cloud too large for that gets its components from the
distributed spanning forest, or its higher classes from landmarks.
"""

from __future__ import annotations

import math
from functools import reduce as fold

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filtra.functions import assign
from filtra.functions import reduce as R
from filtra.functions import rips
from filtra.operators import complexes
from filtra.operators.graph import point_forest, spanning_forest
from filtra.plans.tables import cut
from filtra.schema import DIAGRAM, EPS, choice

_COLUMNS = ["diagram_id", "dim", "birth", "death"]
ENGINES = {"auto": 6, "ph0": 0, "ph1": 1, "ph2": 2, "ph3": 3, "ph4": 4, "ph5": 5, "ph6": 6}


def _frame(key: object, pairs: list) -> pd.DataFrame:
    out = pd.DataFrame(pairs, columns=_COLUMNS[1:]) if pairs else pd.DataFrame(columns=_COLUMNS[1:])
    out.insert(0, "diagram_id", str(key))
    return out.astype({"dim": "int32", "birth": "float64", "death": "float64"})


def persistence(
    points: DataFrame, max_dim: int = 1, radius: float | None = None, metric: str = "euclidean",
    engine: str = "auto", modulus: int = 2, budget: int = 5_000_000, landmarks: int | None = None, tolerance: float = 0.0,
) -> DataFrame:
    """Vietoris-Rips diagrams of clouds; radius None: each cloud's largest distance.

    The engine caps the dimension. landmarks: the complex of so many farthest points.
    Pairs within the tolerance are dropped. Empty clouds give no rows; a bad point is
    an error.
    """
    top = min(max_dim, ENGINES[choice(engine, "engine", tuple(ENGINES))])

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id")
        x = np.array(pdf["coords"].tolist(), dtype=float).reshape(len(pdf), -1)
        if not np.isfinite(x).all():
            raise ValueError(f"cloud {key[0]} has a coordinate that is not finite")
        if landmarks:
            x = x[R.farthest_points(x, landmarks)]
        elif top == 0:  # row by row, without the matrix
            lengths, roots = rips.point_lengths(x, metric, radius)
            pairs = [(0, 0.0, w) for w in lengths if w > EPS] + [(0, 0.0, math.inf)] * roots
            return _frame(key[0], [p for p in pairs if p[2] - p[1] >= tolerance])
        pairs = R.vr_pairs(R.distances(x, metric), top, radius, modulus, budget=budget)
        return _frame(key[0], [p for p in pairs if p[2] - p[1] >= tolerance])

    return points.select("cloud_id", "point_id", "coords").groupBy("cloud_id").applyInPandas(one, DIAGRAM)


def persistence_of_edges(edges: DataFrame, max_dim: int = 1, vertices: DataFrame | None = None, modulus: int = 2) -> DataFrame:
    """Diagrams of weighted edges; vertices (cloud_id, point_id) adds those without edges."""
    rows = edges.select("cloud_id", "src", "dst", "dist")
    if vertices is not None:
        rows = rows.unionByName(vertices.select("cloud_id", F.col("point_id").alias("src"), F.col("point_id").alias("dst"), F.lit(0.0).alias("dist")))

    def by_matrix(key, pdf: pd.DataFrame) -> pd.DataFrame:
        """Dimensions 0 and 1 mod 2 from the matrix of lengths: no triangle is listed."""
        src, dst, dist = (pdf[c].to_numpy() for c in ("src", "dst", "dist"))
        ids = np.unique(np.concatenate([src, dst]))
        u, v = np.searchsorted(ids, src), np.searchsorted(ids, dst)
        m = np.full((len(ids), len(ids)), np.inf)
        np.minimum.at(m, (u, v), dist)
        np.minimum(m, m.T, out=m)
        np.fill_diagonal(m, 0.0)
        return _frame(key[0], R.vr_pairs(m, 1, math.inf))

    if max_dim == 1 and modulus == 2:
        return rows.groupBy("cloud_id").applyInPandas(by_matrix, DIAGRAM)

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        ids = {v: i for i, v in enumerate(sorted(set(pdf["src"]) | set(pdf["dst"])))}
        least: dict[tuple[int, int], float] = {}
        for u, v, d in zip(pdf["src"].map(ids), pdf["dst"].map(ids), pdf["dist"]):
            if u != v and d <= least.get((min(u, v), max(u, v)), math.inf):
                least[min(u, v), max(u, v)] = d
        return _frame(key[0], R.reduce_complex(R.cliques(len(ids), least, max_dim + 1), max_dim, modulus))

    return rows.groupBy("cloud_id").applyInPandas(one, DIAGRAM)


def persistence_of_complex(simplices: DataFrame, max_dim: int = 2, modulus: int = 2, close: bool = False) -> DataFrame:
    """Diagrams of filtered complexes; close adds missing faces."""
    rows = complexes.closure(simplices) if close else simplices

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        s = [(f, tuple(int(x) for x in v)) for f, v in zip(pdf["filtration"], pdf["vertices"])]
        return _frame(key[0], R.reduce_complex(s, max_dim, modulus))

    return rows.select("cloud_id", "vertices", "filtration").groupBy("cloud_id").applyInPandas(one, DIAGRAM)


def cycles_of_complex(simplices: DataFrame, max_dim: int = 1) -> DataFrame:
    """(diagram_id, dim, birth, death, cycle): pairs with the simplices of a representative."""

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        s = [(f, tuple(int(x) for x in v)) for f, v in zip(pdf["filtration"], pdf["vertices"])]
        rows = R.reduce_complex(s, max_dim, cycles=True)
        return pd.DataFrame([(str(key[0]), d, b, e, [list(x) for x in c]) for d, b, e, c in rows], columns=[*_COLUMNS, "cycle"])

    return simplices.select("cloud_id", "vertices", "filtration").groupBy("cloud_id").applyInPandas(one, DIAGRAM + ", cycle array<array<long>>")


def components_diagram(points: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Dimension 0 of clouds of any size: deaths are the spanning forest's lengths, one infinite pair a component.

    Without edges: of all Euclidean distances of the points, which are not listed.
    """
    forest = cut((point_forest(points) if edges is None else spanning_forest(edges)).select("cloud_id", "dist"))
    finite = forest.where("dist > 1e-12").select("cloud_id", F.col("dist").alias("death"))
    n = points.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("n"))
    m = forest.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("m"))
    left = n.join(m, "cloud_id", "left").select("cloud_id", F.explode(F.array_repeat(F.lit(math.inf), (F.col("n") - F.coalesce("m", F.lit(0))).cast("int"))).alias("death"))
    rows = finite.unionByName(left)
    return rows.select(F.col("cloud_id").cast("string").alias("diagram_id"), F.lit(0).alias("dim"), F.lit(0.0).alias("birth"), "death")


def persistence_of_events(events: DataFrame, max_dim: int = 2) -> DataFrame:
    """Diagrams after replaying (cloud_id, seq, op, vertices); a simplex's value is its dimension."""

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", kind="stable")
        there = R.replay(zip(pdf["op"], ([int(v) for v in x] for x in pdf["vertices"])))
        return _frame(key[0], R.reduce_complex([(float(len(s) - 1), s) for s in there], max_dim))

    return events.select("cloud_id", "seq", "op", "vertices").groupBy("cloud_id").applyInPandas(one, DIAGRAM)


def persistence_of_grid(grid: DataFrame, how: str = "sublevel") -> DataFrame:
    """Dimensions 0 and 1 of scalar grids (grid_id, x, y, value)."""
    return persistence_of_complex(complexes.level_set(grid, how), 1)


def alpha_persistence(points: DataFrame, max_dim: int = 1) -> DataFrame:
    """Half-distance filtration of the complete graph."""
    return persistence(points, max_dim).withColumns({c: F.col(c) / 2 for c in ("birth", "death")})


def farthest_landmarks(points: DataFrame, k: int) -> DataFrame:
    """(cloud_id, point_id, rank): k farthest points of each cloud from its smallest id on."""

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id").reset_index(drop=True)
        at = R.farthest_points(np.array(pdf["coords"].tolist(), dtype=float), k)
        return pd.DataFrame({"cloud_id": str(key[0]), "point_id": pdf["point_id"].iloc[at].to_numpy(), "rank": range(len(at))})

    return points.select("cloud_id", "point_id", "coords").groupBy("cloud_id").applyInPandas(one, "cloud_id string, point_id long, rank int")


def sparse_rips(points: DataFrame, cover: float, max_dim: int = 1) -> DataFrame:
    """Diagrams of farthest-point landmarks that cover each cloud within `cover`."""

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf.sort_values("point_id")["coords"].tolist(), dtype=float)
        order = R.farthest_points(x, len(x), cover)
        return _frame(key[0], R.vr_pairs(R.distances(x[order]), max_dim))

    return points.select("cloud_id", "point_id", "coords").groupBy("cloud_id").applyInPandas(one, DIAGRAM)


def witness_edges(landmarks: DataFrame, witnesses: DataFrame, radius: float = math.inf) -> DataFrame:
    """(cloud_id, src, dst, dist) of landmark pairs: the least, over the cloud's witnesses w, of max(d(w, src), d(w, dst)).

    Every point of witnesses counts, with no bound on their number; the minimum is a partial aggregate.
    """
    x = F.zip_with("coords", "at", lambda a, b: (a - b) * (a - b))
    d = witnesses.select("cloud_id", F.col("point_id").alias("w"), F.col("coords").alias("at"))
    d = d.join(landmarks.select("cloud_id", "point_id", "coords"), "cloud_id")
    d = d.select("cloud_id", "w", "point_id", F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, b: a + b)).alias("d"))
    near = d.groupBy("cloud_id", "w").agg(F.sort_array(F.collect_list(F.struct("point_id", "d"))).alias("near"))
    pairs = near.select("cloud_id", "near", F.posexplode("near").alias("i", "a"))
    pairs = pairs.select("cloud_id", "a", F.explode(F.slice("near", F.col("i") + 2, F.size("near"))).alias("b"))
    edges = pairs.groupBy("cloud_id", F.col("a.point_id").alias("src"), F.col("b.point_id").alias("dst"))
    return edges.agg(F.min(F.greatest("a.d", "b.d")).alias("dist")).where((F.col("dist") <= radius) & (F.col("dist") < math.inf))


def witness_persistence(points: DataFrame, landmarks: int, max_dim: int = 1, radius: float = math.inf) -> DataFrame:
    """Weak-witness diagrams over so many farthest-point landmarks; all points of a cloud are its witnesses."""
    chosen = farthest_landmarks(points, landmarks).select(F.col("cloud_id").alias("c"), F.col("point_id").alias("p"))
    marks = points.join(chosen, (F.col("cloud_id").cast("string") == F.col("c")) & (F.col("point_id") == F.col("p"))).select(points.columns)
    return persistence_of_edges(witness_edges(marks, points, radius), max_dim, marks)


def union_find_grid(grid: DataFrame) -> DataFrame:
    """Dimension 0 of sublevel sets of grids, from the forest of the grid's edges with their vertex births (elder rule)."""
    return persistence_of_complex(complexes.skeleton(complexes.level_set(grid), 1), 0)


# distances between diagrams: one pair of diagrams a group


#: Diagrams of a block of diagram_distances: a task holds two blocks.
DIAGRAM_BLOCK = 32


def diagram_distances(diagrams: DataFrame, how: str = "wasserstein", p: float = 2.0, q: float = 2.0, dim: int | None = None) -> DataFrame:
    """(id_a, id_b, dist) of all pairs id_a < id_b by exact assignment of the finite points (of one dim).

    how: wasserstein, bottleneck or sinkhorn. Diagrams are packed once, dealt into
    blocks by a hash, and every two blocks meet in a group of their own: an equi-join
    on the blocks in effect, with nothing broadcast.
    """
    choice(how, "how", ("wasserstein", "bottleneck", "sinkhorn"))
    d = diagrams if dim is None else diagrams.where(F.col("dim") == dim)
    finite = F.col("death") < F.lit(math.inf)
    packed = cut(d.groupBy("diagram_id").agg(F.collect_list(F.when(finite, F.array("birth", "death"))).alias("points")))
    blocks = max(1, -(-packed.count() // DIAGRAM_BLOCK))
    own = F.pmod(F.xxhash64("diagram_id"), F.lit(blocks)).cast("int")
    rows = packed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.select("diagram_id", "points", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    distance = {"wasserstein": lambda x, y: assign.wasserstein(x, y, p, q), "bottleneck": assign.bottleneck, "sinkhorn": lambda x, y: assign.sinkhorn(x, y, p)}[how]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("diagram_id")
        ids, side = pdf["diagram_id"].tolist(), pdf["own"].tolist()
        points = [np.array([np.asarray(r, float) for r in v], float).reshape(-1, 2) for v in pdf["points"]]
        across = pdf["i"].iloc[0] != pdf["j"].iloc[0]
        out = [
            (ids[a], ids[b], distance(points[a], points[b]))
            for a in range(len(ids)) for b in range(a + 1, len(ids)) if not across or side[a] != side[b]
        ]
        return pd.DataFrame(out, columns=["id_a", "id_b", "dist"])

    return rows.groupBy("i", "j").applyInPandas(solve, "id_a string, id_b string, dist double")


def match_diagrams(ref: DataFrame, other: DataFrame, limit: float = math.inf) -> DataFrame:
    """(diagram_id, i, j, dist): greedy nearest matches in the order of dim, birth and death."""

    def one(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        order = ["dim", "birth", "death"]
        a, b = a.sort_values(order), b.sort_values(order)
        rows = assign.greedy_match(a[["birth", "death"]].to_numpy(), b[["birth", "death"]].to_numpy(), limit)
        return pd.DataFrame([(str(key[0]), *r) for r in rows], columns=["diagram_id", "i", "j", "dist"])

    ref, other = ref.select(*_COLUMNS).toDF(*_COLUMNS), other.select(*_COLUMNS).toDF(*_COLUMNS)  # both may stem from one table
    return ref.groupBy("diagram_id").cogroup(other.groupBy("diagram_id")).applyInPandas(one, "diagram_id string, i int, j int, dist double")


def chunked(points: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """(chunk_id, cloud_id, point_id, coords): consecutive points in chunks of `size`, overlapping by `overlap`.

    The last chunks may be short. Points are numbered in their cloud by one window a cloud.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be below the size")
    from pyspark.sql import Window

    stride = size - overlap
    i = F.row_number().over(Window.partitionBy("cloud_id").orderBy("point_id")) - 1
    p = points.withColumn("i", i)
    low = F.greatest(F.ceil((F.col("i") - size + 1) / stride), F.lit(0)).cast("long")
    return p.withColumn("chunk", F.explode(F.sequence(low, F.floor(F.col("i") / stride).cast("long")))).withColumn(
        "chunk_id", F.concat_ws("/", "cloud_id", F.col("chunk").cast("string"))
    ).drop("chunk", "i")


def persistence_of_chunks(points: DataFrame, size: int, overlap: int = 0, max_dim: int = 1, full_only: bool = False) -> DataFrame:
    """Diagrams of count windows."""
    c = chunked(points, size, overlap).drop("cloud_id").withColumnRenamed("chunk_id", "cloud_id")
    if full_only:
        whole = c.groupBy("cloud_id").count().where(F.col("count") == size).select("cloud_id")
        c = c.join(whole, "cloud_id", "left_semi")
    return persistence(c, max_dim)


def sweep(points: DataFrame, radii: list[float], dims: list[int]) -> DataFrame:
    """Diagrams of every cloud for every radius and dimension, with the parameters as columns."""
    runs = [persistence(points, k, r).withColumns({"radius": F.lit(float(r)), "max_dim": F.lit(k)}) for r in radii for k in dims]
    return fold(DataFrame.unionByName, runs)


def bootstrap(points: DataFrame, replicates: int = 10, max_dim: int = 1, seed: int = 42) -> DataFrame:
    """(cloud_id, replicate, dim, birth, death): diagrams of seeded resamples with replacement."""

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf.sort_values("point_id")["coords"].tolist(), dtype=float)
        rng = np.random.default_rng([seed, int(key[1]), *str(key[0]).encode()])
        return _frame(key[0], R.vr_pairs(R.distances(x[rng.integers(0, len(x), len(x))]), max_dim)).assign(replicate=int(key[1]))

    p = points.select("cloud_id", "point_id", "coords", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    return p.groupBy("cloud_id", "replicate").applyInPandas(one, DIAGRAM + ", replicate int")


def approximate_bottleneck(diagrams: DataFrame, error: float) -> DataFrame:
    """(id_a, id_b, dist): bottleneck distances that are off by at most `error`, from births and deaths on a grid of it.

    Snapping moves a point by at most half the error, so each diagram by no more; equal
    values make the exact search short.
    """
    if not error > 0:
        raise ValueError("the error must be positive")
    snap = lambda c: F.when(F.col(c) < F.lit(math.inf), F.round(F.col(c) / error) * error).otherwise(F.col(c))
    return diagram_distances(diagrams.withColumns({"birth": snap("birth"), "death": snap("death")}), "bottleneck")

"""Kernels and set distances between diagrams, as joins of their pairs."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filtra.operators.blocks import grouped, spread
from filtra.operators.diagram import KEY, finite_pairs, persistence


def pair_ids(d: DataFrame, itself: bool = True) -> DataFrame:
    """(id_a, id_b) with id_a <= id_b (or <); one row a diagram is joined, not one a pair."""
    ids = d.select(KEY).distinct()
    a, b = ids.select(F.col(KEY).alias("id_a")), ids.select(F.col(KEY).alias("id_b"))
    return a.join(b, F.col("id_a") <= F.col("id_b") if itself else F.col("id_a") < F.col("id_b"))


#: Different points of a block of a diagram; a task holds two blocks.
POINT_BLOCK = 2048


def _weighted(d: DataFrame) -> DataFrame:
    """Finite pairs, equal ones once with their number n."""
    return finite_pairs(d).groupBy(KEY, "birth", "death").agg(F.count(F.lit(1)).alias("n"))


def _dealt(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points with their block, and a row (diagram, block) for each."""
    size = points.groupBy(KEY).agg(F.ceil(F.count(F.lit(1)) / POINT_BLOCK).cast("int").alias("_n"))
    p = points.join(size, KEY).withColumn("_block", F.pmod(F.xxhash64("birth", "death"), F.col("_n")).cast("int")).drop("_n")
    return p, size.select(KEY, F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_block"))


def _block_products(left: DataFrame, right: DataFrame, fold, schema: str, upper: bool = True) -> DataFrame:
    """fold(left arrays, right arrays), each (births, deaths, counts), over every two blocks of each two diagrams.

    upper: of diagrams id_a <= id_b only. The sides hold different points with their
    numbers; what is quadratic stays in a task's two blocks.
    """
    (a, blocks_a), (b, blocks_b) = _dealt(left), _dealt(right)
    on = (F.col("id_a") <= F.col("id_b")) if upper else F.lit(True)
    cols = ["id_a", "i", "id_b", "j", "birth", "death", "n"]
    name = lambda d, key, block: d.withColumnsRenamed({KEY: key, "_block": block})
    a = name(a, "id_a", "i").join(name(blocks_b, "id_b", "j"), on).select(*cols, F.lit(0).alias("side"))
    b = name(b, "id_b", "j").join(name(blocks_a, "id_a", "i"), on).select(*cols, F.lit(1).alias("side"))

    def solve(key, table):
        side = np.asarray(table["side"])
        x, y = (tuple(np.asarray(table[c])[side == k] for c in ("birth", "death", "n")) for k in (0, 1))
        return fold(x, y)

    return grouped(a.unionByName(b), ["id_a", "i", "id_b", "j"], solve, schema)


def _steps(x: tuple, y: tuple):
    """Rows of x at a time, as columns over all of y; few enough to stay in the cache."""
    width = max(1, (1 << 15) // max(1, len(y[0])))
    for at in range(0, len(x[0]), width):
        rows = slice(at, at + width)
        yield rows, x[0][rows, None], x[1][rows, None], y[0][None, :], y[1][None, :]


def _kernel_sums(left: DataFrame, right: DataFrame, value, upper: bool = True) -> DataFrame:
    """(id_a, id_b, k): sums of value(b1, d1, b2, d2) over all pairs of points of each two diagrams."""

    def fold(x, y):
        total, n2 = 0.0, y[2].astype(float)
        for rows, b1, d1, b2, d2 in _steps(x, y):
            total += float(x[2][rows] @ (value(b1, d1, b2, d2) @ n2))
        yield {"k": np.array([total])}

    kinds = dict(left.dtypes)[KEY], dict(right.dtypes)[KEY]
    sums = _block_products(left, right, fold, f"id_a {kinds[0]}, id_b {kinds[1]}, k double", upper)
    return sums.groupBy("id_a", "id_b").agg(F.sum("k").alias("k"))


def _square(b1, d1, b2, d2):
    return (b1 - b2) ** 2 + (d1 - d2) ** 2


def gaussian_kernel(d: DataFrame, sigma: float = 1.0) -> DataFrame:
    """(id_a, id_b, k): sum of exp(-distance^2 / 2 sigma^2) over the pairs of points."""
    f = _weighted(d)
    return _kernel_sums(f, f, lambda *p: np.exp(_square(*p) / (-2 * sigma * sigma)))


def scale_space_kernel(d: DataFrame, sigma: float = 1.0, weight: float = 0.5) -> DataFrame:
    """Like the Gaussian, on a mix of the distance and the difference of persistence."""
    f = _weighted(d)
    life = lambda b1, d1, b2, d2: ((d1 - b1) - (d2 - b2)) ** 2
    return _kernel_sums(f, f, lambda *p: np.exp(((1 - weight) * _square(*p) + weight * life(*p)) / (-2 * sigma * sigma)))


def heat_kernel(d: DataFrame, sigma: float = 1.0) -> DataFrame:
    """The persistence scale-space kernel: Gaussians less those mirrored at the diagonal."""
    f = _weighted(d)
    mirror = lambda b1, d1, b2, d2: (b1 - d2) ** 2 + (d1 - b2) ** 2
    return _kernel_sums(f, f, lambda *p: (np.exp(_square(*p) / (-8 * sigma)) - np.exp(mirror(*p) / (-8 * sigma))) / (8 * math.pi * sigma))


def fisher_kernel(d: DataFrame, sigma: float = 1.0) -> DataFrame:
    """The Gaussian kernel of diagrams whose points weigh their share of the persistence."""
    f = _weighted(d)
    total = finite_pairs(d).groupBy(KEY).agg(F.sum(persistence()).alias("t"))
    j = _kernel_sums(f, f, lambda b1, d1, b2, d2: (d1 - b1) * (d2 - b2) * np.exp(_square(b1, d1, b2, d2) / (-2 * sigma * sigma))).withColumnRenamed("k", "s")
    j = j.join(total.select(F.col(KEY).alias("id_a"), F.col("t").alias("ta")), "id_a").join(total.select(F.col(KEY).alias("id_b"), F.col("t").alias("tb")), "id_b")
    return j.select("id_a", "id_b", F.coalesce(F.try_divide("s", F.col("ta") * F.col("tb")), F.lit(0.0)).alias("k"))


def sliced_wasserstein(d: DataFrame, slices: int = 10) -> DataFrame:
    """(id_a, id_b, dist): mean over angles of the mean gap of the sorted projections.

    The points of one diagram are projected to the diagonal and added to the other,
    as the distance demands; projections are matched by rank.
    """
    f = finite_pairs(d).select(KEY, "birth", "death")
    both = pair_ids(f)
    mid = (F.col("birth") + F.col("death")) / 2
    a = both.join(f.withColumnRenamed(KEY, "id_a"), "id_a")
    b = both.join(f.withColumnRenamed(KEY, "id_b"), "id_b")
    side = lambda x, s: x.select("id_a", "id_b", F.lit(s).alias("side"), "birth", "death")
    flat = lambda x, s: x.select("id_a", "id_b", F.lit(s).alias("side"), mid.alias("birth"), mid.alias("death"))
    points = side(a, 0).unionAll(flat(b, 0)).unionAll(side(b, 1)).unionAll(flat(a, 1))
    angle = F.explode(F.array(*[F.struct(F.lit(i).alias("s"), F.lit(math.cos(x)).alias("c"), F.lit(math.sin(x)).alias("n")) for i, x in ((i, -math.pi / 2 + math.pi * i / slices) for i in range(slices))])).alias("u")
    rows = points.select("id_a", "id_b", "side", "birth", "death", angle).select("id_a", "id_b", "side", "u.s", (F.col("birth") * F.col("u.c") + F.col("death") * F.col("u.n")).alias("v"))
    rank = Window.partitionBy("id_a", "id_b", "side", "s").orderBy("v")
    rows = rows.withColumn("r", F.row_number().over(rank))
    gap = rows.groupBy("id_a", "id_b", "s", "r").agg(F.abs(F.sum(F.when(F.col("side") == 0, F.col("v")).otherwise(-F.col("v")))).alias("g"))
    return gap.groupBy("id_a", "id_b").agg((F.sum("g") / F.lit(float(slices))).alias("dist"))


def sliced_wasserstein_kernel(d: DataFrame, slices: int = 10, sigma: float = 1.0) -> DataFrame:
    return sliced_wasserstein(d, slices).select("id_a", "id_b", F.exp(-F.col("dist") / (2 * sigma * sigma)).alias("k"))


def linear_kernel(vectors: DataFrame) -> DataFrame:
    """(id_a, id_b, k) of (diagram_id, vector): the dot product."""
    a = vectors.select(F.col(KEY).alias("id_a"), F.col("vector").alias("va"))
    b = vectors.select(F.col(KEY).alias("id_b"), F.col("vector").alias("vb"))
    k = F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    return a.join(b, F.col("id_a") <= F.col("id_b")).select("id_a", "id_b", k.alias("k"))


def full_matrix(kernel: DataFrame) -> DataFrame:
    """Both triangles from the upper one."""
    return kernel.unionByName(kernel.where("id_a <> id_b").select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"), "k"))


def normalise_matrix(kernel: DataFrame) -> DataFrame:
    """k(a, b) / sqrt(k(a, a) k(b, b)); 0 where a norm is 0."""
    own = kernel.where("id_a = id_b")
    k = kernel.join(own.select("id_a", F.col("k").alias("ka")), "id_a").join(own.select("id_b", F.col("k").alias("kb")), "id_b")
    size = F.sqrt(F.col("ka") * F.col("kb"))
    return k.select("id_a", "id_b", F.when(size > 0, F.col("k") / size).otherwise(0.0).alias("k"))


def centre_matrix(kernel: DataFrame) -> DataFrame:
    """Row and column means off, the mean of all on."""
    full = full_matrix(kernel)
    row, col = F.avg("k").over(Window.partitionBy("id_a")), F.avg("k").over(Window.partitionBy("id_b"))
    mean = full.agg(F.avg("k").alias("mean"))
    return full.withColumn("r", row).withColumn("c", col).crossJoin(F.broadcast(mean)).select("id_a", "id_b", (F.col("k") - F.col("r") - F.col("c") + F.col("mean")).alias("k"))


def nearest_gaps(d: DataFrame) -> DataFrame:
    """(id_a, id_b, gap_ab, gap_ba means and maxima): from each point to the nearest of the other diagram, L-infinity."""
    def fold(x, y):
        near = np.full(len(y[0]), np.inf)
        far = np.empty(len(x[0]))
        for rows, b1, d1, b2, d2 in _steps(x, y):
            gap = np.maximum(np.abs(b1 - b2), np.abs(d1 - d2))
            far[rows] = gap.min(1, initial=np.inf)
            np.minimum(near, gap.min(0, initial=np.inf), out=near)
        for side, own, gap in ((0, x, far), (1, y, near)):
            yield {"side": np.full(len(gap), side, np.int32), "b": own[0], "d": own[1], "n": own[2], "gap": gap}

    f, kind = _weighted(d), dict(d.dtypes)[KEY]
    rows = _block_products(f, f, fold, f"id_a {kind}, id_b {kind}, side int, b double, d double, n long, gap double")
    least = rows.groupBy("id_a", "id_b", "side", "b", "d", "n").agg(F.min("gap").alias("gap")).where("gap < double('infinity')")
    ab, ba = (least.where(F.col("side") == k).withColumnRenamed("n", f"n{k + 1}") for k in (0, 1))
    ab = ab.groupBy("id_a", "id_b").agg(F.max("gap").alias("max_ab"), (F.sum(F.col("gap") * F.col("n1")) / F.sum("n1")).alias("mean_ab"))
    ba = ba.groupBy("id_a", "id_b").agg(F.max("gap").alias("max_ba"), (F.sum(F.col("gap") * F.col("n2")) / F.sum("n2")).alias("mean_ba"))
    return ab.join(ba, ["id_a", "id_b"])


def hausdorff(d: DataFrame) -> DataFrame:
    return nearest_gaps(d).select("id_a", "id_b", F.greatest("max_ab", "max_ba").alias("dist"))


def chamfer(d: DataFrame) -> DataFrame:
    return nearest_gaps(d).select("id_a", "id_b", (F.col("mean_ab") + F.col("mean_ba")).alias("dist"))


def distance_statistics(distances: DataFrame) -> DataFrame:
    x = F.col("dist")
    return distances.agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"), F.stddev_pop(x).alias("std"))


def cell_distance(d: DataFrame, cell: float = 1.0) -> DataFrame:
    """(id_a, id_b, dist): L1 distance of the diagrams' counts in square cells, an equi-join on cells."""
    f = finite_pairs(d).groupBy(KEY, F.floor(F.col("birth") / cell).alias("i"), F.floor(F.col("death") / cell).alias("j")).agg(F.count(F.lit(1)).alias("n"))
    both = pair_ids(f, itself=False)
    a = both.join(f.withColumnRenamed(KEY, "id_a"), "id_a").select("id_a", "id_b", "i", "j", "n")
    b = both.join(f.withColumnRenamed(KEY, "id_b"), "id_b").select("id_a", "id_b", "i", "j", (-F.col("n")).alias("n"))
    gap = a.unionByName(b).groupBy("id_a", "id_b", "i", "j").agg(F.abs(F.sum("n")).alias("g"))
    return gap.groupBy("id_a", "id_b").agg(F.sum("g").alias("dist"))


def similar_vectors(vectors: DataFrame, limit: float, bucket: float = 1.0, tables: int = 4, seed: int = 7) -> DataFrame:
    """(id_a, id_b, dist): vectors of one size within `limit`, candidates by random-projection buckets (approximate)."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    v = vectors.select(KEY, array_to_vector("vector").alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=bucket, numHashTables=tables, seed=seed).fit(v)
    j = model.approxSimilarityJoin(v, v, limit, "dist")
    return j.select(F.col(f"datasetA.{KEY}").alias("id_a"), F.col(f"datasetB.{KEY}").alias("id_b"), "dist").where("id_a < id_b")


def gaussian_kernel_points(a: DataFrame, b: DataFrame, sigma: float = 1.0) -> DataFrame:
    """(diagram_id, b1, d1, b2, d2, k): the Gaussian of every two finite points of a diagram's a side and b side.

    Every pair is a row of the result; both sides are dealt into blocks, so that one
    diagram's pairs come from many tasks.
    """
    x, y = (_dealt(finite_pairs(d).where(persistence() > 0).select(KEY, "birth", "death")) for d in (a, b))
    each = lambda side, other, own, far: side[0].withColumnRenamed("_block", own).join(other[1].withColumnRenamed("_block", far), KEY)
    p = each(x, y, "_i", "_j").select(KEY, "_i", "_j", F.col("birth").alias("b1"), F.col("death").alias("d1"))
    q = each(y, x, "_j", "_i").select(KEY, "_i", "_j", F.col("birth").alias("b2"), F.col("death").alias("d2"))
    square = (F.col("b1") - F.col("b2")) * (F.col("b1") - F.col("b2")) + (F.col("d1") - F.col("d2")) * (F.col("d1") - F.col("d2"))
    j = spread(p, KEY, "_i", "_j").join(spread(q, KEY, "_i", "_j"), [KEY, "_i", "_j"])
    return j.select(KEY, "b1", "d1", "b2", "d2", F.exp(-square / (2 * sigma * sigma)).alias("k"))


def cross_similarity(left: DataFrame, right: DataFrame, sigma: float = 0.5) -> DataFrame:
    """(id_a, id_b, k): the Gaussian kernel of every diagram of one set with every diagram of another.

    All pairs of diagrams are the result; equal points of a diagram count once, with a weight.
    """

    return _kernel_sums(_weighted(left), _weighted(right), lambda *p: np.exp(_square(*p) / (-2 * sigma * sigma)), upper=False)

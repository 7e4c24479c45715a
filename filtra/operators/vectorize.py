"""Diagrams as vectors: curves and images on dense grids.

A grid is exploded for each diagram (from its range, or one given) and joined with the
diagram's pairs by the diagram; sums are partial aggregates. Deaths must be finite
unless said otherwise. Every result has a row a grid place, also where nothing is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filtra.operators.diagram import KEY, finite_pairs, persistence
from filtra.schema import INF, choice


def _grid(span: DataFrame, n: int, lo: str = "lo", hi: str = "hi", name: str = "t", index: str = "i") -> DataFrame:
    """n evenly spaced places from lo to hi, a row each."""
    g = span.withColumn(index, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    step = F.col(lo) if n == 1 else F.col(lo) + F.col(index) * (F.col(hi) - F.col(lo)) / F.lit(float(n - 1))
    return g.withColumn(name, step)


def _span(d: DataFrame, lo: Column, hi: Column, x_range: tuple[float, float] | None = None, pad: float = 0.0) -> DataFrame:
    if x_range is not None:
        return d.select(KEY).distinct().select(KEY, F.lit(float(x_range[0])).alias("lo"), F.lit(float(x_range[1])).alias("hi"))
    s = d.groupBy(KEY).agg(lo.alias("a"), hi.alias("b"))
    margin = (F.col("b") - F.col("a")) * pad
    return s.select(KEY, (F.col("a") - margin).alias("lo"), (F.col("b") + margin).alias("hi"))


def tent(t: Column) -> Column:
    return F.greatest(F.least(t - F.col("birth"), F.col("death") - t), F.lit(0.0))


def landscape(d: DataFrame, levels: int = 5, samples: int = 100, x_range: tuple[float, float] | None = None, pad: float = 0.1) -> DataFrame:
    """(diagram_id, level, i, t, value): the level-th largest tent at each place, 0 where there are fewer."""
    f = finite_pairs(d)
    g = _grid(_span(f, F.min("birth"), F.max("death"), x_range, pad), samples).select(KEY, "i", "t")
    h = g.join(f.select(KEY, "birth", "death"), KEY).withColumn("value", tent(F.col("t"))).where("value > 0")
    order = Window.partitionBy(KEY, "i").orderBy(F.col("value").desc())
    top = h.withColumn("level", F.row_number().over(order)).where(F.col("level") <= levels).select(KEY, "i", "level", "value")
    dense = g.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(levels))))
    return dense.join(top, [KEY, "i", "level"], "left").fillna(0.0, ["value"]).select(KEY, "level", "i", "t", "value")


def silhouette(d: DataFrame, samples: int = 100, power: float = 1.0, x_range: tuple[float, float] | None = None, pad: float = 0.1, divide: str = "weights") -> DataFrame:
    """(diagram_id, i, t, value): tents weighted by persistence^power, over the sum of weights or the count."""
    choice(divide, "divide", ("weights", "count"))
    f = finite_pairs(d)
    g = _grid(_span(f, F.min("birth"), F.max("death"), x_range, pad), samples).select(KEY, "i", "t")
    w = F.pow(persistence(), F.lit(power))
    below = F.sum(w) if divide == "weights" else F.count(F.lit(1)).cast("double")
    value = F.coalesce(F.try_divide(F.sum(w * tent(F.col("t"))), below), F.lit(0.0))
    return g.join(f, KEY).groupBy(KEY, "i", "t").agg(value.alias("value"))


def betti_curve(d: DataFrame, samples: int = 100, most: float | None = None) -> DataFrame:
    """(diagram_id, dim, i, t, betti): classes with birth <= t < death from 0 to the largest finite death (or most)."""
    high = F.max(F.when(F.col("death") < F.lit(INF), F.col("death")))
    span = _span(d, F.lit(0.0), high, None if most is None else (0.0, most))
    g = _grid(span.fillna(0.0, ["hi"]), samples).select(KEY, "i", "t")
    g = g.join(d.select(KEY, "dim").distinct(), KEY)
    alive = (F.col("birth") <= F.col("t")) & (F.col("death") > F.col("t"))
    return g.join(d, [KEY, "dim"]).groupBy(KEY, "dim", "i", "t").agg(F.count_if(alive).alias("betti"))


def betti_steps(d: DataFrame) -> DataFrame:
    """(diagram_id, dim, t, betti): the curve where it changes, by one sweep over births and deaths."""
    ups = d.select(KEY, "dim", F.col("birth").alias("t"), F.lit(1).alias("step"))
    downs = d.where(F.col("death") < F.lit(INF)).select(KEY, "dim", F.col("death").alias("t"), F.lit(-1).alias("step"))
    change = ups.unionAll(downs).groupBy(KEY, "dim", "t").agg(F.sum("step").alias("step")).where("step <> 0")
    run = Window.partitionBy(KEY, "dim").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return change.select(KEY, "dim", "t", F.sum("step").over(run).alias("betti"))


def euler_curve(d: DataFrame) -> DataFrame:
    """(diagram_id, t, euler): alternating sum of the Betti numbers where it changes."""
    sign = F.when(F.col("dim") % 2 == 0, F.lit(1)).otherwise(F.lit(-1))
    ups = d.select(KEY, F.col("birth").alias("t"), sign.alias("step"))
    downs = d.where(F.col("death") < F.lit(INF)).select(KEY, F.col("death").alias("t"), (-sign).alias("step"))
    change = ups.unionAll(downs).groupBy(KEY, "t").agg(F.sum("step").alias("step")).where("step <> 0")
    run = Window.partitionBy(KEY).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return change.select(KEY, "t", F.sum("step").over(run).alias("euler"))


def persistence_count_curve(d: DataFrame, samples: int = 100) -> DataFrame:
    """(diagram_id, i, t, n): pairs that live longer than t, from 0 to the largest persistence."""
    f = finite_pairs(d).withColumn("p", persistence())
    g = _grid(_span(f, F.lit(0.0), F.max("p")), samples).select(KEY, "i", "t")
    return g.join(f, KEY).groupBy(KEY, "i", "t").agg(F.count_if(F.col("p") > F.col("t")).alias("n"))


def persistence_image(
    d: DataFrame, resolution: int = 20, sigma: float = 0.1, weight: str = "persistence", axes: str = "persistence",
    pad: float = 0.0, normalise: bool = False,
) -> DataFrame:
    """(diagram_id, ix, iy, value): weighted Gaussians at the pairs, on birth and persistence (or death) axes.

    Weight: persistence, square or uniform. A degenerate range is widened by one.
    Pairs of no persistence are left out. normalise: the image sums to 1.
    """
    choice(weight, "weight", ("persistence", "square", "uniform"))
    choice(axes, "axes", ("persistence", "death"))
    f = finite_pairs(d).withColumn("p", persistence()).where("p > 0").withColumn("y", F.col("p") if axes == "persistence" else F.col("death"))
    s = f.groupBy(KEY).agg(F.min("birth").alias("x0"), F.max("birth").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    wide = {}
    for c in "xy":
        lo, hi = F.col(f"{c}0"), F.col(f"{c}1")
        hi = F.when(hi > lo, hi).otherwise(lo + 1)
        wide |= {f"{c}a": lo - pad * (hi - lo), f"{c}b": hi + pad * (hi - lo)}
    g = _grid(s.withColumns(wide), resolution, "xa", "xb", "gx", "ix")
    g = _grid(g, resolution, "ya", "yb", "gy", "iy").select(KEY, "ix", "iy", "gx", "gy")
    w = {"persistence": F.col("p"), "square": F.col("p") * F.col("p"), "uniform": F.lit(1.0)}[weight]
    r2 = (F.col("gx") - F.col("birth")) * (F.col("gx") - F.col("birth")) + (F.col("gy") - F.col("y")) * (F.col("gy") - F.col("y"))
    image = g.join(f, KEY).groupBy(KEY, "ix", "iy").agg(F.sum(w * F.exp(-r2 / (2 * sigma * sigma))).alias("value"))
    if normalise:
        total = F.sum("value").over(Window.partitionBy(KEY))
        image = image.withColumn("value", F.coalesce(F.try_divide("value", total), F.lit(0.0)))
    return image


def adaptive_sigma(d: DataFrame, least: float = 0.1, most: float = 10.0) -> DataFrame:
    """(diagram_id, sigma): half the spread of births and persistences over the root of the count, within limits."""
    f = finite_pairs(d)
    spread = (F.max("birth") - F.min("birth") + F.max(persistence()) - F.min(persistence())) / 2
    return f.groupBy(KEY).agg(F.greatest(F.lit(least), F.least(F.lit(most), spread / (2 * F.sqrt(F.count(F.lit(1)))))).alias("sigma"))


def heat_kernel_signature(d: DataFrame, samples: int = 100, sigma: float = 0.1, time: float = 1.0) -> DataFrame:
    """(diagram_id, i, t, value): Gaussians at the persistences over their range."""
    f = finite_pairs(d).withColumn("p", persistence())
    g = _grid(_span(f, F.min("p"), F.max("p")), samples).select(KEY, "i", "t")
    value = F.sum(F.exp(-F.pow(F.col("t") - F.col("p"), F.lit(2.0)) / (2 * sigma * sigma * time)))
    return g.join(f, KEY).groupBy(KEY, "i", "t").agg(value.alias("value"))


def heat_vector(d: DataFrame, resolution: int = 100, sigma: float = 1.0, time: float = 1.0) -> DataFrame:
    """(diagram_id, i, t, value): persistence-weighted Gaussians at the midpoints, damped by exp(-time)."""
    f = finite_pairs(d).withColumn("mid", (F.col("birth") + F.col("death")) / 2)
    g = _grid(_span(f, F.min("birth"), F.max("death")), resolution).select(KEY, "i", "t")
    value = F.sum(persistence() * F.exp(-F.pow(F.col("t") - F.col("mid"), F.lit(2.0)) / (2 * sigma * sigma)))
    return g.join(f, KEY).groupBy(KEY, "i", "t").agg((F.lit(math.exp(-time)) * value).alias("value"))


METHODS = {
    "landscape": (landscape, ["level", "i"], "value"),
    "silhouette": (silhouette, ["i"], "value"),
    "betti": (betti_curve, ["dim", "i"], "betti"),
    "image": (persistence_image, ["iy", "ix"], "value"),
    "heat": (heat_kernel_signature, ["i"], "value"),
    "heat_vector": (heat_vector, ["i"], "value"),
}


def to_vector(d: DataFrame, method: str = "landscape", **options: object) -> DataFrame:
    """(diagram_id, vector): a vectorisation's values in the order of its grid."""
    choice(method, "method", tuple(METHODS))
    fn, order, value = METHODS[method]
    rows = fn(d, **options).groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("v")))).alias("s"))
    return rows.select(KEY, F.transform("s", lambda x: x["v"]).alias("vector"))


def fixed_size(vectors: DataFrame, size: int) -> DataFrame:
    """Vectors cut or padded with zeros to one size."""
    padded = F.concat(F.slice("vector", 1, size), F.array_repeat(F.lit(0.0), size))
    return vectors.withColumn("vector", F.slice(padded, 1, size))

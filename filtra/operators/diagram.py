"""Filters, normalisation and statistics of diagrams in long form (diagram_id, dim, birth, death)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filtra.schema import EPS, INF, choice

KEY = "diagram_id"


def persistence() -> Column:
    return F.col("death") - F.col("birth")


def is_finite() -> Column:
    """NaN sorts above infinity in Spark, so it needs its own test."""
    return (F.col("death") < F.lit(INF)) & ~F.isnan("death")


def finite_pairs(d: DataFrame) -> DataFrame:
    return d.where(is_finite())


def of_dimension(d: DataFrame, dim: int) -> DataFrame:
    return d.where(F.col("dim") == dim)


def clamp_negative(d: DataFrame) -> DataFrame:
    """A finite death before its birth becomes the birth."""
    return d.withColumn("death", F.greatest("birth", "death"))


def threshold(d: DataFrame, least: float = 0.0, most: float | None = None) -> DataFrame:
    keep = persistence() >= least
    return d.where(keep if most is None else keep & (persistence() <= most))


def approximate(d: DataFrame, tolerance: float = EPS) -> DataFrame:
    """Infinite pairs, and finite ones that live at least the tolerance."""
    return d.where(~is_finite() | (F.abs(persistence()) >= max(tolerance, EPS)))


def replace_infinite(d: DataFrame, how: str = "max", factor: float = 2.0, value: float | None = None) -> DataFrame:
    """Infinite deaths removed, or set to the diagram's largest finite death times factor, or to a value.

    Without finite deaths the largest birth times factor stands in; the result is
    never before the largest birth of the infinite pairs.
    """
    choice(how, "how", ("remove", "max", "value"))
    if how == "remove":
        return finite_pairs(d)
    w = Window.partitionBy(KEY)
    floor = F.max(F.when(~is_finite(), F.col("birth"))).over(w)
    if how == "value":
        late = F.when(floor > value, F.raise_error(F.lit("a birth lies after the value")).cast("double")).otherwise(F.lit(float(value)))
    else:
        high = F.max(F.when(is_finite(), F.col("death"))).over(w)
        late = F.greatest(F.coalesce(high * factor, F.max("birth").over(w) * factor), floor)
    return d.withColumn("death", F.when(is_finite(), F.col("death")).otherwise(late))


def normalise(d: DataFrame, how: str = "minmax") -> DataFrame:
    """Births and deaths each to [0, 1], or to mean 0 and population deviation 1, a diagram."""
    choice(how, "how", ("minmax", "standard", "none"))
    if how == "none":
        return d
    w = Window.partitionBy(KEY)
    out = d
    for c in ("birth", "death"):
        low, scale = (F.min(c).over(w), F.max(c).over(w) - F.min(c).over(w)) if how == "minmax" else (F.avg(c).over(w), F.stddev_pop(c).over(w))
        out = out.withColumn(f"_{c}", (F.col(c) - low) / F.greatest(scale, F.lit(EPS)))
    return out.withColumns({c: F.col(f"_{c}") for c in ("birth", "death")}).drop("_birth", "_death")


def remove_outliers(d: DataFrame, how: str = "iqr", limit: float = 1.5) -> DataFrame:
    """Without finite pairs whose persistence lies outside limit quartile ranges or deviations; infinite ones stay."""
    choice(how, "how", ("iqr", "zscore"))
    f = finite_pairs(d).withColumn("p", persistence())
    if how == "iqr":
        q = f.groupBy(KEY).agg(F.percentile("p", F.lit(0.25)).alias("a"), F.percentile("p", F.lit(0.75)).alias("b"))
        q = q.select(KEY, (F.col("a") - limit * (F.col("b") - F.col("a"))).alias("lo"), (F.col("b") + limit * (F.col("b") - F.col("a"))).alias("hi"))
    else:
        q = f.groupBy(KEY).agg(F.avg("p").alias("m"), F.stddev_pop("p").alias("s"))
        reach = F.when(F.col("s") < EPS, F.lit(INF)).otherwise(limit * F.col("s"))
        q = q.select(KEY, (F.col("m") - reach).alias("lo"), (F.col("m") + reach).alias("hi"))
    return d.join(q, KEY, "left").where(~is_finite() | persistence().between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def most_persistent(d: DataFrame, most: int) -> DataFrame:
    """The `most` longest pairs of each diagram; ties by dim, birth, death."""
    order = Window.partitionBy(KEY).orderBy(persistence().desc(), "dim", "birth", "death")
    return d.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")


def uniform_subsample(d: DataFrame, bins: int) -> DataFrame:
    """The longest pair of each of equally wide birth bins (half open; the largest birth counts to the last)."""
    w = Window.partitionBy(KEY)
    low, width = F.min("birth").over(w), (F.max("birth").over(w) - F.min("birth").over(w)) / bins
    bin_ = F.when(width > 0, F.least(F.floor((F.col("birth") - low) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    order = Window.partitionBy(KEY, "_b").orderBy(persistence().desc(), "dim", "birth", "death")
    return d.withColumn("_b", bin_).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_b", "_r")


def random_subsample(d: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """`most` pairs of each diagram by a seeded hash of the pair, so that reruns agree."""
    order = Window.partitionBy(KEY).orderBy(F.xxhash64(F.lit(seed), KEY, "dim", "birth", "death"), "dim", "birth", "death")
    return d.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")


def clean(d: DataFrame, infinite: str = "max", least: float = 0.0, most: int | None = None, how: str = "none", outliers: bool = False) -> DataFrame:
    """Infinite deaths, threshold, outliers, subsample, normalisation, in this order."""
    d = threshold(replace_infinite(d, infinite), least)
    d = remove_outliers(d) if outliers else d
    d = most_persistent(d, most) if most else d
    return normalise(d, how)


# statistics: each a row a diagram (and dim, if asked for)


def _by(per_dim: bool) -> list[str]:
    return [KEY, "dim"] if per_dim else [KEY]


def total_persistence(d: DataFrame, p: float = 1.0, per_dim: bool = False) -> DataFrame:
    return d.groupBy(*_by(per_dim)).agg(F.sum(F.pow(persistence(), F.lit(p))).alias("total_persistence"))


def entropy(d: DataFrame, base: float = math.e, per_dim: bool = False) -> DataFrame:
    """-sum p log p over the shares of the finite persistences above 0; 0 without any.

    From the two sums of x and x log x in one aggregate, so that nothing is joined back.
    """
    x = F.when(is_finite() & (persistence() > 0), persistence())
    total, weighted = F.sum(x), F.sum(x * F.log(x))
    value = F.when(total >= EPS, F.log(total) - weighted / total).otherwise(F.lit(0.0))
    return d.groupBy(*_by(per_dim)).agg((value / F.lit(math.log(base))).alias("entropy"))


def statistics(d: DataFrame, per_dim: bool = True) -> DataFrame:
    """Counts, and moments of the finite persistences; the infinite pairs are only counted."""
    x = F.when(is_finite(), persistence())
    up = F.when(x > 0, x)
    total = F.sum(up)
    return d.groupBy(*_by(per_dim)).agg(
        F.count(F.lit(1)).alias("n_features"),
        F.count_if(~is_finite()).alias("n_infinite"),
        F.coalesce(F.sum(x), F.lit(0.0)).alias("total_persistence"),
        F.coalesce(F.avg(x), F.lit(0.0)).alias("mean_persistence"),
        F.coalesce(F.max(x), F.lit(0.0)).alias("max_persistence"),
        F.coalesce(F.var_pop(x), F.lit(0.0)).alias("variance"),
        F.coalesce(F.when(total >= EPS, F.log(total) - F.sum(up * F.log(up)) / total), F.lit(0.0)).alias("entropy"),
        F.avg("birth").alias("mean_birth"),
        F.coalesce(F.avg(F.when(is_finite(), F.col("death"))), F.lit(0.0)).alias("mean_death"),
    )


def n_features(d: DataFrame, least: float = 0.0) -> DataFrame:
    """Pairs a diagram and dim that live at least so long; infinite ones do."""
    return d.groupBy(KEY, "dim").agg(F.count_if(persistence() >= least).alias("n_features"))


def alive_at(d: DataFrame, t: float) -> DataFrame:
    """Classes a diagram and dim with birth <= t < death."""
    return d.groupBy(KEY, "dim").agg(F.count_if((F.col("birth") <= t) & (F.col("death") > t)).alias("betti"))


def betti_numbers(d: DataFrame) -> DataFrame:
    """Infinite pairs for every dim up to the diagram's largest."""
    count = d.groupBy(KEY, "dim").agg(F.count_if(~is_finite()).cast("long").alias("betti"))
    dims = d.groupBy(KEY).agg(F.max("dim").alias("m")).select(KEY, F.explode(F.sequence(F.lit(0), "m")).alias("dim"))
    return dims.join(count, [KEY, "dim"], "left").fillna(0, ["betti"])


def amplitude(d: DataFrame, how: str = "persistence", p: float = 2.0) -> DataFrame:
    """bottleneck: the largest persistence; persistence: sum of p-th powers; wasserstein: its p-th root."""
    choice(how, "how", ("bottleneck", "persistence", "wasserstein"))
    f = finite_pairs(d)
    power = F.sum(F.pow(persistence(), F.lit(p)))
    value = {"bottleneck": F.max(persistence()), "persistence": power, "wasserstein": F.pow(power, F.lit(1 / p))}[how]
    return f.groupBy(KEY).agg(value.alias("amplitude"))


def summary_features(d: DataFrame, least: float = 0.1) -> DataFrame:
    """Count, mean, maximum, population deviation, and the number above `least`."""
    x = persistence()
    return finite_pairs(d).groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.max(x).alias("max"), F.stddev_pop(x).alias("std"), F.count_if(x > least).alias("n_long")
    )


def birth_curve(d: DataFrame, bins: int = 50, how: str = "count") -> DataFrame:
    """(diagram_id, bin, value): births in equally wide bins, the last closed; count, sum or mean of persistence."""
    choice(how, "how", ("count", "sum", "mean"))
    f = finite_pairs(d)
    span = f.groupBy(KEY).agg(F.min("birth").alias("lo"), F.max("birth").alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("birth") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    value = {"count": F.count(F.lit(1)).cast("double"), "sum": F.sum(persistence()), "mean": F.avg(persistence())}[how]
    got = f.join(span, KEY).groupBy(KEY, at.cast("int").alias("bin")).agg(value.alias("value"))
    dense = span.select(KEY, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return dense.join(got, [KEY, "bin"], "left").fillna(0.0, ["value"])


def canonical_order(d: DataFrame) -> DataFrame:
    return d.orderBy(KEY, "dim", "birth", "death")


def drift_score(baseline: DataFrame, current: DataFrame, bins: int = 20) -> DataFrame:
    """(diagram_id, drift): shifts of the mean birth, death and persistence in baseline deviations, of the count, and of
    the births' histogram (chi-squared, half its weight), over five.

    A histogram has `bins` bins from 0 to the diagram's largest birth or death; births below 0 are in the first.
    """

    def profile(d: DataFrame, tag: str) -> DataFrame:
        cols = {"b": F.col("birth"), "d": F.col("death"), "p": persistence()}
        aggs = [f(x).alias(f"{n}{k}{tag}") for k, x in cols.items() for n, f in (("m", F.avg), ("s", F.stddev_pop))]
        return finite_pairs(d).groupBy(KEY).agg(F.count(F.lit(1)).alias(f"n{tag}"), *aggs)

    def histogram(d: DataFrame, tag: str) -> DataFrame:
        f = finite_pairs(d)
        top = f.groupBy(KEY).agg(F.greatest(F.max("birth"), F.max("death")).alias("top"))
        top = top.withColumn("top", F.when(F.col("top") > 0, F.col("top")).otherwise(F.lit(1.0)))
        at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.col("birth") / F.col("top") * bins)))
        return f.join(top, KEY).groupBy(KEY, at.alias("bin")).agg(F.count(F.lit(1)).alias(f"h{tag}"))

    both = histogram(baseline, "0").join(histogram(current, "1"), [KEY, "bin"], "full").fillna(0, ["h0", "h1"])
    h0, h1 = F.col("h0"), F.col("h1")
    chi = both.groupBy(KEY).agg(F.sum((h0 - h1) * (h0 - h1) / (h0 + h1)).alias("chi"))
    j = profile(baseline, "0").join(profile(current, "1"), KEY).join(chi, KEY)
    shift = lambda k: F.abs(F.col(f"m{k}1") - F.col(f"m{k}0")) / F.greatest(F.col(f"s{k}0"), F.lit(EPS))
    score = shift("b") + shift("d") + shift("p") + 2 * F.abs(1 - F.col("n1") / F.col("n0")) + F.col("chi") / 2
    return j.select(KEY, (score / 5).alias("drift"))

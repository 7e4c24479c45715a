"""Table layouts, tolerances and parameter guards.

clouds: cloud_id, point_id, coords. edges: cloud_id, src < dst, dist. complexes:
cloud_id, dim, vertices (sorted), filtration. diagrams: diagram_id, dim, birth, death,
with an infinite death for a class that never dies.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLOUD = "cloud_id string, point_id long, coords array<double>"
EDGES = "cloud_id string, src long, dst long, dist double"
COMPLEX = "cloud_id string, dim int, vertices array<long>, filtration double"
DIAGRAM = "diagram_id string, dim int, birth double, death double"
VERSION = 1

#: A pair is kept if it lives longer than this.
EPS = 1e-12
INF = math.inf


def positive_int(value: object, name: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
        raise ValueError(f"{name} must be a positive whole number, not {value!r}")
    return value


def nonnegative_int(value: object, name: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 0:
        raise ValueError(f"{name} must be a whole number of at least 0, not {value!r}")
    return value


def finite(value: object, name: str, least: float = -math.inf) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value) or value < least:
        raise ValueError(f"{name} must be a finite number of at least {least}, not {value!r}")
    return float(value)


def choice(value: str, name: str, options: tuple[str, ...]) -> str:
    if value not in options:
        raise ValueError(f"{name} must be one of {', '.join(options)}, not {value!r}")
    return value


def has_schema(df: DataFrame, layout: str) -> DataFrame:
    """df with the layout's columns and types; a missing column is an error."""
    pairs = [x.strip().rsplit(" ", 1) if "<" not in x else x.strip().split(" ", 1) for x in layout.split(", ")]
    missing = [n for n, _ in pairs if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(n).cast(t).alias(n) for n, t in pairs])


def valid_point() -> object:
    """Whether coords is non-empty and finite."""
    bad = F.exists("coords", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(INF)))
    return F.col("coords").isNotNull() & (F.size("coords") > 0) & ~bad


def validate_points(points: DataFrame) -> DataFrame:
    """points, failing at run time on an empty, null, infinite or NaN coordinate list."""
    message = F.concat(F.lit("bad point "), F.coalesce(F.col("point_id").cast("string"), F.lit("null")))
    return points.withColumn("coords", F.when(valid_point(), F.col("coords")).otherwise(F.raise_error(message).cast("array<double>")))


def valid_pair() -> object:
    """Finite birth, and a death that is no NaN and not before the birth."""
    birth, death = F.col("birth"), F.col("death")
    return (
        birth.isNotNull() & death.isNotNull() & ~F.isnan(birth) & ~F.isnan(death)
        & (F.abs(birth) < F.lit(INF)) & (death >= birth) & (F.coalesce(F.col("dim"), F.lit(-1)) >= 0)
    )


def validate_diagram(diagram: DataFrame) -> DataFrame:
    """diagram, failing at run time on an invalid pair."""
    return diagram.withColumn("birth", F.when(valid_pair(), F.col("birth")).otherwise(F.raise_error(F.lit("invalid pair")).cast("double")))


def validate_finite_deaths(diagram: DataFrame) -> DataFrame:
    """diagram, failing at run time on an infinite death."""
    ok = F.col("death") < F.lit(INF)
    return diagram.withColumn("death", F.when(ok, F.col("death")).otherwise(F.raise_error(F.lit("deaths must be finite")).cast("double")))

"""Distances between two array columns, as expressions that run in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def chebyshev(a: Column, b: Column) -> Column:
    return F.coalesce(F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y))), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def cosine(a: Column, b: Column) -> Column:
    """One less the cosine of the angle; 1 where a vector has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, 1 - dot(a, b) / size).otherwise(F.lit(1.0))


def minkowski(p: float = 3.0) -> Callable[[Column, Column], Column]:
    return lambda a, b: F.pow(_sum(F.zip_with(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(p)))), F.lit(1.0 / p))


def canberra(a: Column, b: Column) -> Column:
    """Coordinates that are both zero add nothing."""
    return _sum(F.zip_with(a, b, lambda x, y: F.when(F.abs(x) + F.abs(y) > 0, F.abs(x - y) / (F.abs(x) + F.abs(y))).otherwise(0.0)))


def braycurtis(a: Column, b: Column) -> Column:
    below = _sum(F.zip_with(a, b, lambda x, y: F.abs(x + y)))
    return F.when(below > 0, manhattan(a, b) / below).otherwise(F.lit(0.0))


def correlation(a: Column, b: Column) -> Column:
    """The cosine distance after each vector's mean is taken off."""
    centre = lambda v: F.transform(v, lambda x: x - _sum(v) / F.size(v))
    return cosine(centre(a), centre(b))


METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "euclidean": euclidean,
    "l2": euclidean,
    "manhattan": manhattan,
    "cityblock": manhattan,
    "l1": manhattan,
    "chebyshev": chebyshev,
    "linf": chebyshev,
    "cosine": cosine,
    "minkowski": minkowski(),
    "canberra": canberra,
    "braycurtis": braycurtis,
    "correlation": correlation,
}


def metric(name: str | Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    """A metric by name, or any function of two array columns."""
    if callable(name):
        return name
    try:
        return METRICS[name]
    except KeyError:
        raise ValueError(f"unknown metric {name!r}; known: {', '.join(METRICS)}") from None


def between(x: np.ndarray, y: np.ndarray, name: str, step: int = 1 << 15) -> Iterator[tuple[slice, np.ndarray]]:
    """(rows of x, their distances to all of y) under a metric by name, some rows at a time and coordinate by coordinate."""
    name = {"l2": "euclidean", "l1": "manhattan", "cityblock": "manhattan", "linf": "chebyshev"}.get(name, name)
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; known: {', '.join(METRICS)}")
    if name == "correlation":
        x, y, name = x - x.mean(1, keepdims=True), y - y.mean(1, keepdims=True), "cosine"
    width = max(1, step // max(1, len(y)))
    axes = np.ascontiguousarray(y.T)
    size_y = np.sqrt((y * y).sum(1)) if name == "cosine" else None
    for at in range(0, len(x), width):
        rows = slice(at, min(at + width, len(x)))
        part = x[rows]
        out = np.zeros((len(part), len(y)))
        if name == "cosine":
            size = np.sqrt((part * part).sum(1))[:, None] * size_y[None, :]
            with np.errstate(invalid="ignore", divide="ignore"):
                yield rows, np.where(size > 0, 1 - part @ y.T / size, 1.0)
            continue
        below = np.zeros_like(out) if name == "braycurtis" else None
        d, cube = np.empty_like(out), np.empty_like(out)
        for k in range(x.shape[1]):
            a, b = part[:, k, None], axes[None, k]
            np.subtract(a, b, out=d)
            if name == "euclidean":
                d *= d
                out += d
                continue
            np.abs(d, out=d)
            if name == "chebyshev":
                np.maximum(out, d, out=out)
            elif name == "minkowski":
                np.multiply(d, d, out=cube)
                cube *= d
                out += cube
            elif name == "canberra":
                total = np.abs(a) + np.abs(b)
                out += np.divide(d, total, out=np.zeros_like(d), where=total > 0)
            else:
                out += d
                if below is not None:
                    np.add(a, b, out=d)
                    np.abs(d, out=d)
                    below += d
        if name == "euclidean":
            np.sqrt(out, out=out)
        elif name == "minkowski":
            np.cbrt(out, out=out)
        elif name == "braycurtis":
            out = np.divide(out, below, out=np.zeros_like(out), where=below > 0)
        yield rows, out

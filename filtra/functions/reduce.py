"""Persistence of one complex in memory: union-find for components, column reduction over Z_p above.

Plain Python and NumPy without Spark; the grouped operators call it for one cloud.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from itertools import combinations

import numpy as np

from filtra.functions import rips
from filtra.schema import EPS

Simplex = tuple[int, ...]
Pair = tuple[int, float, float]


class BudgetError(ValueError):
    """A complex would hold more simplices than allowed."""


def find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def forest(n: int, edges: Iterable[tuple[float, int, int]]) -> tuple[list[tuple[float, int, int]], list[int]]:
    """Minimum spanning forest of edges (weight, u, v), ties by (u, v), and each vertex's smallest neighbour reached."""
    parent = list(range(n))
    kept = []
    for w, u, v in sorted(edges):
        a, b = find(parent, u), find(parent, v)
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append((w, u, v))
    return kept, [find(parent, i) for i in range(n)]


def cliques(n: int, edges: dict[tuple[int, int], float], top: int, start: Sequence[float] | None = None, budget: int = 5_000_000) -> list[tuple[float, Simplex]]:
    """The flag complex up to dimension top: a simplex appears with its last edge (or vertex).

    Each simplex is grown by the later vertices that neighbour all of it, so that it is
    met once; more than budget simplices raise BudgetError.
    """
    start = start if start is not None else [0.0] * n
    later: list[dict[int, float]] = [{} for _ in range(n)]
    for (u, v), d in edges.items():
        later[min(u, v)][max(u, v)] = d
    out: list[tuple[float, Simplex]] = [(float(start[i]), (i,)) for i in range(n)]
    level = [(float(start[i]), (i,), {j: max(d, start[i], start[j]) for j, d in later[i].items()}) for i in range(n)]
    for _ in range(top):
        grown = []
        for value, simplex, reach in level:
            for j, d in reach.items():
                new = max(value, d)
                common = {k: max(e, reach[k]) for k, e in later[j].items() if k in reach}
                grown.append((new, (*simplex, j), common))
        out += [(v, s) for v, s, _ in grown]
        if len(out) > budget:
            raise BudgetError(f"over {budget} simplices: lower the radius or the dimension, or take landmarks")
        level = grown
    return out


def ordered(simplices: Iterable[tuple[float, Simplex]]) -> list[tuple[float, Simplex]]:
    """By value, dimension and vertices: every face comes before what it bounds."""
    return sorted(simplices, key=lambda x: (x[0], len(x[1]), x[1]))


def reduce_complex(simplices: Iterable[tuple[float, Simplex]], top: int, modulus: int = 2, tolerance: float = EPS, cycles: bool = False) -> list:
    """Pairs (dim, birth, death) for dims 0 to top of a filtered complex that is closed under faces.

    Columns are reduced from the highest dimension down, and a column that is the
    pivot of a higher one is cleared without work. With cycles, each pair also holds
    the simplices of a representative: the reduced boundary of a finite class.
    """
    order = ordered(simplices)
    number = {s: i for i, (_, s) in enumerate(order)}
    by_dim: dict[int, list[int]] = {}
    for i, (_, s) in enumerate(order):
        by_dim.setdefault(len(s) - 1, []).append(i)
    paired: dict[int, tuple[int, tuple]] = {}  # birth index -> (death index, reduced column)
    killers: set[int] = set()
    for dim in sorted(by_dim, reverse=True):
        if dim == 0:
            continue
        columns: dict[int, dict[int, int]] = {}
        for j in by_dim[dim]:
            if j in paired:
                continue  # it gives birth: its column would reduce to zero
            s = order[j][1]
            column = {number[s[:i] + s[i + 1 :]]: (1 if i % 2 == 0 else modulus - 1) for i in range(len(s))}
            while column:
                low = max(column)
                other = columns.get(low)
                if other is None:
                    break
                factor = -column[low] * pow(other[low], -1, modulus) % modulus
                for row, x in other.items():
                    y = (column.get(row, 0) + factor * x) % modulus
                    if y:
                        column[row] = y
                    else:
                        column.pop(row, None)
            if column:
                low = max(column)
                columns[low] = column
                paired[low] = (j, tuple(sorted(column)))
                killers.add(j)
    out = []
    for i, (birth, s) in enumerate(order):
        dim = len(s) - 1
        if dim > top or i in killers:
            continue
        death = order[paired[i][0]][0] if i in paired else math.inf
        if death - birth > tolerance:
            chain = [order[r][1] for r in paired[i][1]] if i in paired else [s]
            out.append((dim, birth, death, chain) if cycles else (dim, birth, death))
    return out


def distances(points: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """The distance matrix of one cloud."""
    if metric in ("cosine",):
        size = np.linalg.norm(points, axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            d = 1 - (points @ points.T) / np.outer(size, size)
        return np.where(np.outer(size, size) > 0, np.maximum(d, 0), 1.0)
    gap = np.abs(points[:, None, :] - points[None, :, :])
    if metric in ("manhattan", "cityblock", "l1"):
        return gap.sum(-1)
    if metric in ("chebyshev", "linf"):
        return gap.max(-1, initial=0.0)
    if metric in ("euclidean", "l2"):
        return np.sqrt((gap**2).sum(-1))
    raise ValueError(f"unknown metric {metric!r}")


def vr_pairs(matrix: np.ndarray, top: int, radius: float | None = None, modulus: int = 2, start: Sequence[float] | None = None, budget: int = 5_000_000) -> list[Pair]:
    """Vietoris-Rips pairs of a distance matrix; radius None: the largest distance.

    Dimension 0 needs the spanning forest only, dimension 1 mod 2 no list of
    triangles; whatever else is asked for builds the complex within the budget.
    """
    n = len(matrix)
    if n == 0:
        return []
    radius = float(matrix.max()) if radius is None else radius
    if start is None and top == 0:
        lengths, roots = rips.component_lengths(matrix, radius)
        return [(0, 0.0, w) for w in lengths if w > EPS] + [(0, 0.0, math.inf)] * roots
    if start is None and top == 1 and modulus == 2:
        return rips.pairs(matrix, radius)
    u, v = np.triu_indices(n, 1)
    d = matrix[u, v]
    keep = np.isfinite(d) & (d <= radius)
    edges = list(zip(d[keep].tolist(), u[keep].tolist(), v[keep].tolist()))
    return reduce_complex(cliques(n, {(a, b): w for w, a, b in edges}, top + 1, start, budget), top, modulus)


def closure(simplices: Iterable[tuple[float, Simplex]]) -> dict[Simplex, float]:
    """All faces with the smallest value of what they bound."""
    out: dict[Simplex, float] = {}
    for value, simplex in simplices:
        s = tuple(sorted(simplex))
        for k in range(1, len(s) + 1):
            for face in combinations(s, k):
                if value < out.get(face, math.inf):
                    out[face] = value
    return out


def replay(events: Iterable[tuple[str, Sequence[int]]]) -> set[Simplex]:
    """The complex after adding and removing simplices in order.

    A simplex may only be added when all its facets are there; removing one that is
    absent or still bounds another changes nothing.
    """
    there: set[Simplex] = set()
    for op, vertices in events:
        s = tuple(sorted(vertices))
        if not s or len(set(s)) != len(s) or s[0] < 0:
            raise ValueError(f"bad simplex {vertices!r}")
        if op == "add":
            if len(s) > 1 and any(s[:i] + s[i + 1 :] not in there for i in range(len(s))):
                raise ValueError(f"a facet of {s} is missing")
            there.add(s)
        elif op == "remove":
            if s in there and not any(len(x) == len(s) + 1 and set(s) < set(x) for x in there):
                there.discard(s)
        else:
            raise ValueError(f"unknown operation {op!r}")
    return there


def farthest_points(points: np.ndarray, k: int, cover: float = -math.inf) -> list[int]:
    """k indices: the first, then always the farthest from those taken; the first of equals.

    Ends as soon as all points lie within cover of those taken.
    """
    if not len(points) or k <= 0:
        return []
    taken = [0]
    gap = np.linalg.norm(points - points[0], axis=1)
    while len(taken) < min(k, len(points)):
        i = int(np.argmax(gap))
        if gap[i] <= cover:
            break
        taken.append(i)
        gap = np.minimum(gap, np.linalg.norm(points - points[i], axis=1))
    return taken

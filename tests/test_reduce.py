"""The in-memory reducer and matchings against definitions."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from filtra.functions import assign as A
from filtra.functions import reduce as R


def pairs(points, top=1, radius=None, **options):
    return sorted(R.vr_pairs(R.distances(np.array(points, float)), top, radius, **options))


HEXAGON = [(math.cos(k * math.pi / 3), math.sin(k * math.pi / 3)) for k in range(6)]


def test_closed_forms():
    inf = math.inf
    assert pairs([(0, 0), (1, 0)]) == [(0, 0, 1), (0, 0, inf)]
    assert pairs([(0, 0), (0.5, 0), (1, 0)], radius=1) == [(0, 0, 0.5), (0, 0, 0.5), (0, 0, inf)]
    square = pairs([(0, 0), (1, 0), (0, 1), (1, 1)], 1)
    assert [p[:2] + (round(p[2], 9),) for p in square] == [(0, 0, 1), (0, 0, 1), (0, 0, 1), (0, 0, inf), (1, 1, round(math.sqrt(2), 9))]
    equi = pairs([(0, 0), (1, 0), (0.5, math.sqrt(3) / 2)], 1)
    assert [d for d, _, _ in equi] == [0, 0, 0]
    hexa = pairs(HEXAGON, 1, 1.5)
    assert sum(d == 0 and e == inf for d, _, e in hexa) == 1 and sum(d == 1 and e == inf for d, _, e in hexa) == 1
    tetra = [(1, 1, 1), (1, -1, -1), (-1, 1, -1), (-1, -1, 1)]
    assert [p[0] for p in pairs(np.array(tetra) / math.sqrt(8), 2)] == [0, 0, 0, 0]
    assert pairs([(0,)]) == [(0, 0, inf)] and R.vr_pairs(np.zeros((0, 0)), 1) == []
    octahedron = [v for k in range(3) for v in (np.eye(3)[k], -np.eye(3)[k])]
    assert [p[0] for p in pairs(octahedron, 2) if p[0] == 2] == [2]


def rank_z(rows, p):
    m, rank = [list(r) for r in rows], 0
    for c in range(len(m[0]) if m else 0):
        k = next((i for i in range(rank, len(m)) if m[i][c] % p), None)
        if k is None:
            continue
        m[rank], m[k] = m[k], m[rank]
        inv = pow(m[rank][c], -1, p)
        m[rank] = [x * inv % p for x in m[rank]]
        for i in range(len(m)):
            if i != rank and m[i][c] % p:
                f = m[i][c]
                m[i] = [(x - f * y) % p for x, y in zip(m[i], m[rank])]
        rank += 1
    return rank


def betti_at(simplices, t, dim, p):
    """Rank-nullity on the complex at time t."""
    there = [s for f, s in simplices if f <= t]
    by = {k: sorted(s for s in there if len(s) == k + 1) for k in range(-1, dim + 2)}

    def rank(k):
        if k <= 0 or not by[k]:
            return 0
        at = {s: i for i, s in enumerate(by[k - 1])}
        rows = []
        for s in by[k]:
            row = [0] * len(by[k - 1])
            for i in range(len(s)):
                row[at[s[:i] + s[i + 1 :]]] = (1 if i % 2 == 0 else -1) % p
            rows.append(row)
        return rank_z(rows, p)

    return len(by[dim]) - rank(dim) - rank(dim + 1)


@settings(max_examples=40, deadline=None)
@given(st.integers(3, 7), st.integers(0, 10**6), st.sampled_from([2, 3, 5]))
def test_alive_pairs_are_the_betti_numbers(n, seed, p):
    m = np.random.default_rng(seed).integers(1, 9, (n, n)).astype(float)
    m = np.triu(m, 1) + np.triu(m, 1).T
    simplices = R.cliques(n, {(i, j): m[i, j] for i in range(n) for j in range(i + 1, n)}, 3)
    got = R.reduce_complex(simplices, 2, p)
    for t in sorted({f for f, _ in simplices}):
        for dim in (0, 1, 2):
            assert sum(d == dim and b <= t < e for d, b, e in got) == betti_at(simplices, t, dim, p)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 12), st.integers(0, 10**6), st.sampled_from([4, 9, 10**6]), st.sampled_from([0.5, 0.8, 1.0]))
def test_short_cut_agrees_with_the_complex(n, seed, steps, part):
    """Ties (few steps) and cut radii included."""
    m = np.random.default_rng(seed).integers(1, steps, (n, n)).astype(float)
    m = np.triu(m, 1) + np.triu(m, 1).T
    r = float(m.max()) * part
    edges = {(i, j): m[i, j] for i in range(n) for j in range(i + 1, n) if m[i, j] <= r}
    want = sorted(R.reduce_complex(R.cliques(n, edges, 2), 1))
    assert sorted(R.vr_pairs(m, 1, r)) == want
    assert sorted(R.vr_pairs(m, 0, r)) == [p for p in want if p[0] == 0]


def test_projective_plane_depends_on_the_field():
    """The six-vertex projective plane has a class in dimensions 1 and 2 mod 2 only."""
    top = [(0, 1, 2), (0, 2, 3), (0, 3, 4), (0, 4, 5), (0, 1, 5), (1, 2, 4), (2, 4, 5), (2, 3, 5), (1, 3, 5), (1, 3, 4)]
    complex_ = [(0.0, s) for s in R.closure((0.0, t) for t in top)]
    count = lambda p: [sum(d == k for d, _, _ in R.reduce_complex(complex_, 2, p)) for k in range(3)]
    assert count(2) == [1, 1, 1] and count(3) == [1, 0, 0]


def test_cycles_are_boundaries():
    simplices = R.cliques(4, {(0, 1): 1, (1, 2): 1, (2, 3): 1, (0, 3): 1, (0, 2): 2, (1, 3): 2}, 2)
    loop = next(x for x in R.reduce_complex(simplices, 1, cycles=True) if x[0] == 1)
    ends = [v for edge in loop[3] for v in edge]
    assert all(ends.count(v) == 2 for v in set(ends))


def test_budget():
    with pytest.raises(R.BudgetError):
        R.vr_pairs(R.distances(np.zeros((30, 1))), 3, 1.0, budget=1000)


def test_replay():
    events = [("add", [0]), ("add", [1]), ("add", [0, 1]), ("remove", [0]), ("remove", [7]), ("remove", [1, 0]), ("remove", [0])]
    assert R.replay(events) == {(1,)}
    for bad in ([("add", [0, 1])], [("add", [0, 0])], [("add", [-1])], [("swap", [0])]):
        with pytest.raises(ValueError):
            R.replay(bad)


def test_farthest_points():
    assert R.farthest_points(np.array([[0.0], [1], [10], [4]]), 3) == [0, 2, 3]
    assert R.farthest_points(np.zeros((0, 1)), 3) == []


POINTS = st.lists(st.tuples(st.integers(0, 8), st.integers(1, 6)).map(lambda x: (x[0], x[0] + x[1])), max_size=3)


def brute_matchings(a, b, p, q):
    cost = A.padded_cost(np.array(a, float).reshape(-1, 2), np.array(b, float).reshape(-1, 2), p, q)
    return [[cost[i, j] for i, j in enumerate(s)] for s in itertools.permutations(range(len(cost)))]


@settings(max_examples=80, deadline=None)
@given(POINTS, POINTS)
def test_distances_against_all_matchings(a, b):
    w = min(sum(c) for c in brute_matchings(a, b, 2, 2)) ** 0.5 if a or b else 0
    assert A.wasserstein(a, b) == pytest.approx(w)
    m = min(max(c) for c in brute_matchings(a, b, 1, math.inf)) if a or b else 0
    assert A.bottleneck(a, b) == pytest.approx(m)
    assert A.wasserstein(a, b) == pytest.approx(A.wasserstein(b, a))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(0, 10**6))
def test_hungarian(n, seed):
    cost = np.random.default_rng(seed).integers(-5, 9, (n, n)).astype(float)
    match, total = A.hungarian(cost)
    assert sorted(match) == list(range(n))
    assert total == min(sum(cost[i, j] for i, j in enumerate(s)) for s in itertools.permutations(range(n)))


def test_sinkhorn_nears_wasserstein():
    a, b = [(0, 4), (1, 3)], [(0.5, 4.5)]
    assert A.sinkhorn(a, b, reg=0.01, rounds=2000) == pytest.approx(A.wasserstein(a, b), rel=0.02)


def test_infinite_points_are_left_out():
    assert A.bottleneck([(0, math.inf)], []) == 0 == A.wasserstein([(0, math.inf)], [])


def test_greedy():
    assert A.greedy_match([(0, 1), (0, 2)], [(0, 2)]) == [(0, 0, 1.0)]
    assert A.greedy_match([(0, 1)], [(0, 9)], 2) == []

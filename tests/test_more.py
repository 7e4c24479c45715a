"""Geometry, matchings, covers, summaries and files against brute force and closed forms."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from filtra.functions import assign
from filtra.operators import distance, geometry, mapper, persistence, summary
from filtra.plans.tables import memoize
from filtra.sources import formats

INF = float("inf")


def cloud(spark, x, name="c"):
    return spark.createDataFrame([(name, i, [float(v) for v in p]) for i, p in enumerate(x)], "cloud_id string, point_id long, coords array<double>")


def diagrams(spark, named):
    return spark.createDataFrame([(k, 0, float(b), float(d)) for k, v in named.items() for b, d in v], "diagram_id string, dim int, birth double, death double")


def every_matching(a, b, p, q):
    """The distance over all ways to match points with each other or with the diagonal."""
    best = math.inf
    for k in range(min(len(a), len(b)) + 1):
        for rows in itertools.combinations(range(len(a)), k):
            for cols in itertools.permutations(range(len(b)), k):
                costs = [np.linalg.norm(a[i] - b[j], q) for i, j in zip(rows, cols)]
                costs += [np.linalg.norm((x[1] - x[0]) / 2 * np.ones(2), q) for d, used in ((a, rows), (b, cols)) for i, x in enumerate(d) if i not in used]
                value = max(costs, default=0.0) if math.isinf(p) else sum(c**p for c in costs) ** (1 / p)
                best = min(best, value)
    return best


def small_diagrams(seed):
    rng = np.random.default_rng(seed)
    birth = rng.uniform(0, 4, 4)
    return np.stack((birth, birth + rng.uniform(0.1, 3, 4)), 1)[: rng.integers(0, 5)]


@pytest.mark.parametrize("seed", range(6))
def test_distances_by_enumeration(seed):
    a, b = small_diagrams(seed), small_diagrams(seed + 100)
    for p, q in ((1.0, 2.0), (2.0, 2.0), (2.0, math.inf)):
        exact = assign.wasserstein(a, b, p, q)
        assert exact == pytest.approx(every_matching(a, b, p, q), abs=1e-9)
        assert assign.greedy_bound(a, b, p, q) >= exact - 1e-9
    exact = assign.bottleneck(a, b)
    assert exact == pytest.approx(every_matching(a, b, math.inf, math.inf), abs=1e-9)
    assert assign.greedy_bound(a, b, math.inf) >= exact - 1e-9


@pytest.mark.parametrize("n", [1, 2, 5, 7])
def test_cheapest_matching_by_enumeration(n):
    rng = np.random.default_rng(n)
    for cost in (rng.uniform(0, 1, (n, n)), rng.integers(0, 3, (n, n)).astype(float)):
        match, total = assign.hungarian(cost)
        assert sorted(match) == list(range(n)) and total == pytest.approx(cost[np.arange(n), match].sum())
        assert total == pytest.approx(min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n))))


def test_frechet_and_transport():
    line = np.array([[0.0, 0], [1, 0], [2, 0]])
    assert assign.frechet(line, line + [0, 3]) == 3 and assign.frechet(line, line[::-1]) == 2
    assert assign.transport(line, line[::-1]) == 0 and assign.transport(line, line + [0, 2]) == pytest.approx(2)
    with pytest.raises(ValueError):
        assign.transport(line, line[:2])


def test_distances_of_many_diagrams(spark, monkeypatch):
    monkeypatch.setattr(persistence, "DIAGRAM_BLOCK", 2)
    named = {str(k): small_diagrams(k) for k in range(7)}
    named = {k: v for k, v in named.items() if len(v)}
    d = diagrams(spark, named)
    got = {(r.id_a, r.id_b): r.dist for r in persistence.diagram_distances(d, "bottleneck").collect()}
    assert set(got) == set(itertools.combinations(sorted(named), 2))
    for (a, b), x in got.items():
        assert x == pytest.approx(assign.bottleneck(named[a], named[b]))
    near = {(r.id_a, r.id_b): r.dist for r in persistence.approximate_bottleneck(d, 0.2).collect()}
    assert all(abs(near[k] - x) <= 0.2 + 1e-9 for k, x in got.items())


@pytest.mark.parametrize("metric, norm", [("euclidean", 2), ("manhattan", 1), ("chebyshev", np.inf)])
def test_nearest_in_blocks(spark, monkeypatch, metric, norm):
    monkeypatch.setattr(distance, "NEAREST_BLOCK", 7)
    x = np.random.default_rng(1).integers(0, 6, (40, 3)).astype(float)  # many ties
    for itself in (False, True):
        got = distance.nearest(cloud(spark, x), 4, metric, itself=itself).collect()
        for i in range(len(x)):
            d = np.linalg.norm(x - x[i], norm, axis=1)
            want = sorted((round(d[j], 9), j) for j in range(len(x)) if itself or j != i)[:4]
            assert [(round(r.dist, 9), r.dst) for r in sorted((r for r in got if r.src == i), key=lambda r: r["rank"])] == want
    asked = distance.nearest(cloud(spark, x), 50, metric, queries=cloud(spark, x[:3] + 0.25)).groupBy("src").count().collect()
    assert {r.src: r["count"] for r in asked} == {0: 40, 1: 40, 2: 40}


def test_geometry(spark):
    t = cloud(spark, [(0, 0, 0), (3, 0, 0), (0, 4, 0)])
    s = spark.createDataFrame([("c", 2, [0, 1, 2], 0.0)], "cloud_id string, dim int, vertices array<long>, filtration double")
    a, b, c = F.col("p0"), F.col("p1"), F.col("p2")
    row = geometry.with_corners(s, t, 3).select(
        geometry.triangle_area(a, b, c).alias("area"), geometry.circumradius(a, b, c).alias("r"), geometry.enclosing_radius(a, b, c).alias("e"),
        geometry.angle(a, b, c).alias("angle"), geometry.circumradius(a, a, b).alias("flat"), geometry.angle(a, a, b).alias("none"),
    ).first()
    assert (row.area, row.r, row.e, row.flat, row.none) == (6, 2.5, 2.5, INF, 0) and row.angle == pytest.approx(math.pi / 2)
    even = cloud(spark, [(0, 0), (1, 0), (0.5, math.sqrt(3) / 2)])
    cech = {r.dim: r.filtration for r in geometry.cech_complex(even, 0.6).where("dim > 0").collect()}
    assert cech[1] == pytest.approx(0.5) and cech[2] == pytest.approx(1 / math.sqrt(3))
    assert geometry.cech_complex(even, 0.55).where("dim = 2").count() == 0


def test_dominated_edges_of_a_path_and_a_triangle(spark):
    e = spark.createDataFrame([("p", 0, 1, 1.0), ("p", 1, 2, 1.0), ("t", 0, 1, 1.0), ("t", 1, 2, 1.0), ("t", 0, 2, 1.0)], "cloud_id string, src long, dst long, dist double")
    got = {(r.cloud_id, r.src, r.dst) for r in geometry.dominated_edges(e).collect()}
    assert got == {("p", 0, 1), ("p", 2, 1), *(("t", a, b) for a, b in itertools.permutations(range(3), 2))}


def test_covers_filters_and_means(spark):
    p = cloud(spark, [(0, 0), (0.1, 0), (5, 5), (5.1, 5), (5.2, 5)])
    lens = {r.point_id: r.lens for r in mapper.density_filter(p, 0.15).collect()}
    assert lens == {0: 1, 1: 1, 2: 1, 3: 2, 4: 1}
    held = mapper.unit_cover(p.withColumn("lens", F.col("point_id") / 4), 3, 0.5).groupBy("cover_index").count().collect()
    assert {r.cover_index: r["count"] for r in held} == {0: 3, 1: 3, 2: 3}
    grid = mapper.grid_cover(p, [F.col("coords")[0], F.col("coords")[1]], 2, 0.0)
    assert {r.cover_index: r["count"] for r in grid.groupBy("cover_index").count().collect()} == {0: 2, 1: 3}
    label = mapper.kmeans(np.array([[0.0], [0.1], [9], [9.1], [9.2]]), 2)
    assert label[0] == label[1] != label[2] == label[3] == label[4]
    assert len(set(mapper.kmeans(np.zeros((4, 2)), 3))) == 1


def test_noise_is_the_same_on_every_run(spark):
    p = cloud(spark, np.zeros((400, 2)))
    a, b = (sorted(map(str, summary.noisy_copies(p.repartition(n), 2, 0.5).collect())) for n in (1, 5))
    assert a == b and len(a) == 800
    x = np.array([r.coords for r in summary.noisy_copies(p, 2, 0.5).collect()])
    assert abs(x.mean()) < 0.06 and abs(x.std() - 0.5) < 0.05
    assert summary.noisy_copies(p, 1, 0.0).where("coords[0] <> 0").count() == 0


def test_padding_goes_from_the_end_only(spark):
    rows = spark.createDataFrame([("a", i, b, 0.0) for i, b in enumerate([1.0, 0.0, 2.0, 0.0, 0.0])] + [("z", 0, 0.0, 0.0)], "diagram_id string, row int, birth double, death double")
    assert [r.row for r in summary.trim_trailing(rows).orderBy("row").collect()] == [0, 1, 2]


def test_memoize_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    assert [memoize(spark, str(tmp_path), "key", build).count() for _ in range(2)] == [3, 3] and len(calls) == 1


def test_files(spark, tmp_path):
    import io

    p = cloud(spark, [(0, 0, 1), (1, 0, 0), (0, 1, 0)])
    row = formats.npy_bytes(p).first()
    assert np.load(io.BytesIO(bytes(row.value))).tolist() == [[0, 0, 1], [1, 0, 0], [0, 1, 0]]
    faces = spark.createDataFrame([("c", [2, 0, 1])], "cloud_id string, vertices array<long>")
    assert formats.off_with_faces(p, faces).first().value.split("\n")[1:] == ["3 1 0", "0.0 0.0 1.0", "1.0 0.0 0.0", "0.0 1.0 0.0", "3 2 0 1"]
    for name, text in (("short.off", "OFF\n3 0 0\n0 0 0\n"), ("nan.off", "OFF\n1 0 0\n0 nan 0\n"), ("short.ply", "ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nend_header\n0 0 0\n")):
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception, match="ends before|finite"):
            formats.load_cloud(spark, str(tmp_path / name)).collect()


def test_command_line(spark, tmp_path, capsys):
    from filtra.__main__ import main

    (tmp_path / "square.off").write_text("OFF\n4 0 0\n0 0 0\n1 0 0\n0 1 0\n1 1 0\n")
    main(["compute", str(tmp_path / "square.off"), "--max-dim", "1", "--out", str(tmp_path / "pairs.csv")])
    main(["info", str(tmp_path / "square.off")])
    said = capsys.readouterr().out
    assert "n_points" in said
    assert formats.load_csv(spark, str(tmp_path / "pairs.csv")).where("dim = 0").count() == 4

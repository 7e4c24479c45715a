"""Pairs and neighbourhoods by blocks and cells: the same results as plain joins, with nothing quadratic in a plan."""

import pytest
from pyspark.sql import functions as F

from filtra.operators import blocks, distance


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_VALUES", 32 * 7)
    monkeypatch.setattr(blocks, "CELL_PART", 5)


@pytest.fixture(scope="module")
def cloud(spark):
    """90 points of two clouds in the plane, some of them equal."""
    i = F.col("id")
    coords = F.array((i * 37 % 23).cast("double") / 4, (i * 11 % 17).cast("double") / 8)
    return spark.range(90).select((i % 2).cast("string").alias("cloud_id"), i.alias("point_id"), coords.alias("coords"))


@pytest.mark.parametrize("name", ["euclidean", "cosine", "minkowski", "manhattan", "chebyshev", "braycurtis", "canberra", "correlation"])
def test_pair_statistics(cloud, small_blocks, name):
    want = distance.pairwise(cloud, name).groupBy("cloud_id").agg(F.count(F.lit(1)), F.sum("dist"), F.min("dist"), F.max("dist")).collect()
    found = distance.pair_statistics(cloud.withColumn("coords", F.col("coords")), name)
    assert "Join [src" not in plan(found)
    got = {r[0]: r[1:] for r in found.collect()}
    for r in want:
        assert got[r[0]] == pytest.approx(tuple(r[1:]), abs=1e-9)


def test_cross_statistics(cloud, small_blocks):
    a, b = cloud.where("point_id < 40"), cloud.where("point_id >= 40 AND cloud_id = '1'")
    got = distance.pair_statistics(a, others=b).collect()
    want = distance.cross_distances(a, b).groupBy("cloud_id").agg(F.count(F.lit(1)), F.sum("dist")).collect()
    assert [(r[0], r[1]) for r in got] == [(r[0], r[1]) for r in want] and got[0][2] == pytest.approx(want[0][2])


def test_metric_queries_join_no_pairs(spark):
    from filtra.plans import registry

    for name in ("cross_distances", "metric_braycurtis", "metric_cosine", "metric_minkowski", "metric_manhattan", "metric_chebyshev"):
        p = plan(registry.queries()[name](spark, "/root/testdata/sf0.001"))
        assert "FlatMapGroupsInArrow" in p and "src#" not in p


@pytest.mark.parametrize("x, places, want", [(1.005, 2, 1.0), (4.705, 2, 4.71), (-2.5, 0, -3.0), (1e12, 2, 1e12), (0.0000005, 6, 0.000001)])
def test_rounding_as_sql(spark, x, places, want):
    from filtra.plans.inputs import half_away

    assert spark.range(1).select(half_away(F.lit(x), places)).first()[0] == want


@pytest.mark.parametrize("name", ["diagram_normalise_minmax", "diagram_normalise_standard", "kernel_centred"])
def test_halves_match_sql(spark, tmp_path, name):
    """Balances whose third decimal is a half, which decimal and binary rounding part."""
    import duckdb

    from filtra.plans import registry

    c = duckdb.connect()
    c.sql(f"COPY (SELECT i AS s_suppkey, 'n' AS s_name, CAST(i % 25 AS INTEGER) AS s_nationkey, 1005.0 + 10 * i AS s_acctbal FROM range(300) t(i)) TO '{tmp_path}/supplier.parquet'")
    c.sql(f"COPY (SELECT * FROM '/root/testdata/sf0.001/nation.parquet') TO '{tmp_path}/nation.parquet'")
    for t in ("supplier", "nation"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got = registry.queries()[name](spark, str(tmp_path))
    want = c.sql(registry.oracle_sql()[name])
    cols = sorted(got.columns)
    rows = sorted(tuple(r[k] for k in cols) for r in got.collect())
    at = [want.columns.index(k) for k in cols]
    assert rows == sorted(tuple(r[i] for i in at) for r in want.fetchall())


@pytest.fixture(scope="module")
def diagrams(spark):
    i = F.col("id")
    birth = (i * 37 % 19).cast("double") / 4
    return spark.range(120).select((i % 3).cast("string").alias("diagram_id"), (i % 2).cast("int").alias("dim"), birth.alias("birth"), (birth + (i % 7) / 2.0).alias("death"))


@pytest.mark.parametrize("name", ["gaussian", "scale_space", "heat", "fisher"])
def test_kernels_by_blocks(diagrams, monkeypatch, name):
    import math

    from filtra.operators import kernels

    monkeypatch.setattr(kernels, "POINT_BLOCK", 5)
    found = getattr(kernels, f"{name}_kernel")(diagrams)
    assert "b1#" not in plan(found)  # no row a pair of points
    points = {}
    for r in diagrams.collect():
        points.setdefault(r.diagram_id, []).append((r.birth, r.death))
    sq = lambda a, b: (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2
    life = lambda a: a[1] - a[0]
    value = {
        "gaussian": lambda a, b: math.exp(-sq(a, b) / 2),
        "scale_space": lambda a, b: math.exp(-(sq(a, b) + (life(a) - life(b)) ** 2) / 4),
        "heat": lambda a, b: (math.exp(-sq(a, b) / 8) - math.exp(-sq(a, b[::-1]) / 8)) / 8 / math.pi,
        "fisher": lambda a, b: life(a) * life(b) * math.exp(-sq(a, b) / 2),
    }[name]
    norm = {k: sum(map(life, v)) if name == "fisher" else 1 for k, v in points.items()}
    got = {(r.id_a, r.id_b): r.k for r in found.collect()}
    assert len(got) == 6
    for (a, b), k in got.items():
        assert k == pytest.approx(sum(value(x, y) for x in points[a] for y in points[b]) / norm[a] / norm[b])


def test_gaps_and_points_by_blocks(diagrams, monkeypatch):
    from filtra.operators import kernels

    whole = [sorted(map(str, f.collect())) for f in (kernels.hausdorff(diagrams), kernels.chamfer(diagrams).withColumn("dist", F.round("dist", 9)))]
    monkeypatch.setattr(kernels, "POINT_BLOCK", 5)
    found = kernels.hausdorff(diagrams)
    assert "b1#" not in plan(found)
    assert whole == [sorted(map(str, f.collect())) for f in (found, kernels.chamfer(diagrams).withColumn("dist", F.round("dist", 9)))]
    a, b = diagrams.where("dim = 0"), diagrams.where("dim = 1")
    pairs = kernels.gaussian_kernel_points(a, b)
    assert "_i#" in plan(pairs)  # dealt by blocks, not by diagrams alone
    n = a.where("death > birth").alias("a").join(b.where("death > birth").alias("b"), "diagram_id").count()
    assert pairs.count() == n
    k = {(r.id_a, r.id_b): r.k for r in kernels.cross_similarity(a, b, 1.0).collect()}
    own = pairs.groupBy("diagram_id").agg(F.sum("k").alias("k")).collect()
    assert len(k) == 9 and all(r.k <= k[r.diagram_id, r.diagram_id] for r in own)


def test_matching_of_many_points_is_quick():
    import time

    import numpy as np

    from filtra.functions import assign

    rng = np.random.default_rng(1)
    a, b = rng.random((6000, 2)), rng.random((6000, 2))
    began = time.perf_counter()
    rows = assign.greedy_match(a, b, 0.05)
    assert time.perf_counter() - began < 5  # a list of 6,000 by 6,000 gaps took minutes
    left = list(range(300))
    for i, j, g in assign.greedy_match(a[:300], b[:300]):
        gaps = [float(np.abs(b[k] - a[i]).max()) for k in left]
        assert (j, g) == (left[int(np.argmin(gaps))], min(gaps))
        left.remove(j)
    assert len({j for _, j, _ in rows}) == len(rows)


def test_cover_ends_when_it_covers():
    import numpy as np

    from filtra.functions import reduce as R

    x = np.random.default_rng(2).random((200_000, 2))
    at = R.farthest_points(x, len(x), 0.25)  # all 200,000 in turn took hours
    assert len(at) < 60 and at == R.farthest_points(x, len(at))


def test_drift_of_long_series_is_the_same(spark):
    import numpy as np

    from filtra.operators import anomaly

    v = np.random.default_rng(3).random(40_000) * np.linspace(1, 9, 40_000)
    s = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)], "k string, t long, v double")
    got = anomaly.lifetime_drift(s, "k", "t", "v", 50, 60, 1.0).orderBy("t").collect()
    q, now = np.linspace(0, 1, 32), 1.0
    assert [r.t for r in got] == list(range(50, 40_000))
    for r in got[:200]:
        window = np.sort(v[max(0, r.t - 59) : r.t + 1])
        score = float(np.abs(np.quantile(window, q) - np.quantile(np.sort(v[:50]), q)).mean())
        assert r.score == score and r.drift == (score > now)
        now = (now + score) / 2 if score > now else now


def test_step_up_ranges(spark):
    """Ties, nulls of no family, and no frame that is read anew for every row."""
    from filtra.operators import anomaly

    rows = [("a" if i % 3 else "b", (i * 7919 % 97) / 97) for i in range(500)]
    found = anomaly.benjamini_hochberg(spark.createDataFrame(rows, "f string, p double"), "f")
    assert "UnboundedFollowing" not in plan(found) and "unboundedfollowing" not in plan(found)
    got = {(r.f, r.p): r.adjusted for r in found.collect()}
    assert found.count() == 500
    for f in "ab":
        p = sorted(x for g, x in rows if g == f)
        rate = 1.0
        for r in range(len(p), 0, -1):
            rate = min(rate, p[r - 1] * len(p) / r)
            assert got[f, p[r - 1]] == pytest.approx(rate) or (r < len(p) and p[r] == p[r - 1])


RADIUS = 0.9


@pytest.fixture(scope="module")
def simplices(cloud):
    from filtra.operators import complexes

    p = cloud.withColumn("coords", F.col("coords"))
    return complexes.flag_complex(complexes.vertices_of(p), distance.pairwise(p).where(F.col("dist") <= RADIUS), 2).localCheckpoint()


def rows(df) -> list:
    return sorted(str([x if not isinstance(x, float) else round(x, 7) + 0.0 for x in r]) for r in df.collect())


def joins_on_points_only(df) -> bool:
    """No edge or triangle is a row of a shuffle or a join."""
    p = plan(df)
    return "src#" not in p.split("FlatMapGroupsInArrow", 1)[1] and "SortMergeJoin [src" not in p


def test_rips_by_cells(cloud, simplices, small_blocks):
    from filtra.operators import complexes

    c = complexes.vietoris_rips(cloud, RADIUS)
    assert "Join [cloud_id#" not in plan(c).split("FlatMapGroupsInArrow")[0]
    assert rows(c.select(*complexes.COLUMNS)) == rows(simplices.select(*complexes.COLUMNS))


def test_weights_travel_with_points(cloud, small_blocks):
    from filtra.operators import complexes

    w = cloud.select("cloud_id", "point_id", (F.col("point_id") / 90).alias("weight"))
    for how in ("inverse_distance", "exponential", "linear"):
        got = complexes.weighted_range_edges(cloud, w, RADIUS, how)
        assert plan(got).split("FlatMapGroupsInArrow")[0].count("Join") == 0
        assert rows(got) == rows(complexes.weighted_edges(distance.pairwise(cloud).where(F.col("dist") <= RADIUS), w, how))


def test_counts_of_classes(cloud, simplices, small_blocks):
    from filtra.operators import complexes, graph

    n = complexes.rips_counts(cloud, RADIUS)
    assert joins_on_points_only(n)
    assert rows(n.selectExpr("cloud_id", "n0 - n1 + n2")) == rows(complexes.euler_characteristic(simplices).select("cloud_id", "euler"))
    trace = complexes.laplacian(simplices, 1).where("row = col").groupBy("cloud_id").agg(F.sum("value"))
    assert rows(n.selectExpr("cloud_id", "2 * n1 + 3 * n2")) == rows(trace)
    at = complexes.neighbour_counts(cloud, RADIUS).where("degree > 1").selectExpr("point_id", "2.0D * triangles / (degree * (degree - 1)) AS c")
    assert rows(at) == rows(graph.clustering(distance.pairwise(cloud).where(F.col("dist") <= RADIUS)))
    entries = complexes.laplacian(simplices.where("dim < 2"), 0).selectExpr("cloud_id", "row[0]", "col[0]", "value")
    assert rows(complexes.graph_laplacian(cloud, RADIUS)) == rows(entries)


def test_folds_of_triangles(cloud, simplices, small_blocks):
    from filtra.operators import complexes, geometry

    closed = complexes.closure(simplices.where("dim = 2")).groupBy("cloud_id", "dim").agg(F.count(F.lit(1)), F.sum("filtration"))
    assert rows(complexes.rips_closure(cloud, RADIUS).select("cloud_id", "dim", "n", "total")) == rows(closed)
    ordered = complexes.ordered(simplices).groupBy("cloud_id", "dim").agg(F.count(F.lit(1)), F.sum("place"))
    found = complexes.places(simplices)
    assert "row_number" not in plan(found) and rows(found.select("cloud_id", "dim", "n", "places")) == rows(ordered)
    assert complexes.boundary(simplices, closed=True).count() == complexes.boundary(simplices).count()
    assert "Join" not in plan(complexes.boundary(simplices, closed=True))
    e = distance.pairwise(cloud).where(F.col("dist") <= RADIUS)
    assert rows(geometry.range_dominated_edges(cloud, RADIUS)) == rows(geometry.dominated_edges(e))
    assert complexes.missing_rips_faces(cloud, RADIUS).isEmpty()
    faces = complexes.rips_faces(cloud, RADIUS).distinct()
    assert faces.count() == complexes.closure(simplices.where("dim = 2")).where("dim = 1").count()


def test_cech_by_cells(cloud, simplices, small_blocks):
    from filtra.operators import geometry

    t = geometry.with_corners(simplices.where("dim = 2"), cloud, 3)
    t = t.withColumn("f", geometry.enclosing_radius(F.col("p0"), F.col("p1"), F.col("p2"))).where(F.col("f") <= RADIUS / 2)
    got = geometry.cech_complex(cloud, RADIUS / 2)
    assert rows(got.where("dim = 2").select("cloud_id", "vertices", "filtration")) == rows(t.select("cloud_id", "vertices", "f"))
    assert got.where("dim = 1").count() == simplices.where("dim = 1").count()


def test_critical_simplices(cloud, simplices, small_blocks):
    """Of the Euler characteristic's alternating sum, and matched: far fewer triangles are critical than there are."""
    from filtra.operators import complexes, morse

    n = morse.rips_critical(cloud, RADIUS)
    euler = n.groupBy("cloud_id").agg(F.sum(F.when(F.col("dim") == 1, -F.col("n")).otherwise(F.col("n"))).alias("e"))
    assert rows(euler) == rows(complexes.euler_characteristic(simplices).select("cloud_id", "euler"))
    every = {(r.cloud_id, r.dim): r["count"] for r in simplices.groupBy("cloud_id", "dim").count().collect()}
    left = {(r.cloud_id, r.dim): r.n for r in n.collect()}
    best = {(r.cloud_id, r.dim): r["count"] for r in morse.morse_matching(simplices).where("partner IS NULL").groupBy("cloud_id", "dim").count().collect()}
    for k, m in left.items():
        assert 0 <= m <= every[k]
        assert m >= best.get(k, 0) or k[1] == 0
    assert all(left[c, 1] < every[c, 1] / 2 for c in ("0", "1"))


def test_matchings_of_one_birth():
    import math
    import time

    import numpy as np

    from filtra.functions import assign

    rng = np.random.default_rng(4)
    deaths = lambda n: np.c_[np.full(n, 1.0), 1 + np.round(rng.random(n) * 3, 1)]
    for _ in range(60):
        a, b = deaths(rng.integers(0, 8)), deaths(rng.integers(1, 8))
        for p, q in ((2.0, 2.0), (1.0, math.inf), (3.0, 1.0)):
            assert assign.wasserstein(a, b, p, q) == pytest.approx(assign.hungarian(assign.padded_cost(a, b, p, q))[1] ** (1 / p))
        cost = assign.padded_cost(a, b, 1.0, math.inf)
        fits = lambda r: assign._perfect([np.flatnonzero(row <= r).tolist() for row in cost], len(cost))  # noqa: B023, E731
        assert assign.bottleneck(a, b) == min(r for r in np.unique(cost) if fits(r))
    a, b = np.c_[np.zeros(3000), rng.random(3000)], np.c_[np.zeros(3000), rng.random(3000)]
    began = time.perf_counter()
    assign.wasserstein(a, b)
    assign.bottleneck(a, b)
    assert time.perf_counter() - began < 5  # assignments of 6,000 rows took minutes


def test_forest_of_points(cloud, monkeypatch):
    """With ties, the very edges of the forest of all pairs, whatever the blocks."""
    from filtra.operators import graph

    want = rows(graph.spanning_forest(distance.pairwise(cloud)).select("cloud_id", "src", "dst", "dist"))
    monkeypatch.setattr(graph, "FOREST_VALUES", 32 * 12)
    assert rows(graph.point_forest(cloud)) == want
    monkeypatch.setattr(graph, "FOREST_EDGES", 1)
    assert rows(graph.point_forest(cloud)) == want


def test_graph_of_points_without_its_edges(cloud, monkeypatch):
    from filtra.operators import graph, persistence

    monkeypatch.setattr(graph, "FOREST_VALUES", 32 * 12)
    e = distance.pairwise(cloud).where("dist <= 0.3")
    v = cloud.select(F.col("point_id").alias("v"))
    assert rows(graph.components(v, graph.point_forest(cloud).where("dist <= 0.3"))) == rows(graph.components(v, e))
    assert rows(graph.point_betti(cloud, 0.3)) == rows(graph.betti(v, e))
    assert rows(persistence.components_diagram(cloud)) == rows(persistence.components_diagram(cloud, distance.pairwise(cloud)))


def test_lengths_without_a_matrix():
    import numpy as np

    from filtra.functions import reduce as R
    from filtra.functions import rips

    x = np.random.default_rng(5).random((60, 3))
    for radius in (None, 0.2):
        lengths, roots = rips.point_lengths(x, "euclidean", radius)
        want, n = rips.component_lengths(R.distances(x), np.inf if radius is None else radius)
        assert roots == n and sorted(lengths) == pytest.approx(sorted(want))


def test_linkage_of_sets_by_blocks(spark, monkeypatch):
    import numpy as np

    from filtra.operators import graph, mapper

    monkeypatch.setattr(graph, "FOREST_VALUES", 32 * 12)
    x = np.random.default_rng(6).random((80, 3))
    covered = spark.createDataFrame([(i % 2, 1000 - i, p.tolist()) for i, p in enumerate(x)], "cover_index long, point_id long, coords array<double>")
    found = mapper.cluster_cover(covered, "single_linkage", eps=0.25)
    assert "FlatMapGroupsInPandas" not in plan(found)  # no task holds a set and its matrix
    got = {(r.cover_index, r.point_id): r.cluster for r in found.collect()}
    for c in (0, 1):
        at = [i for i in range(79, -1, -1) if i % 2 == c]
        assert [got[c, 1000 - i] for i in at] == mapper.single_linkage(x[at], 0.25).tolist()


def test_edges_of_many_triangles(spark):
    """A complete graph of 5.4 million triangles, which raised BudgetError; and small graphs as by reduction."""
    import numpy as np

    from filtra.functions import reduce as R
    from filtra.operators import persistence

    x = np.random.default_rng(7).random((320, 2))
    p = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(x)], "cloud_id string, point_id long, coords array<double>")
    got = persistence.persistence_of_edges(distance.pairwise(p), 1, p)
    assert rows(got) == rows(persistence.persistence(p, 1))
    few = distance.pairwise(p).where("dist <= 0.08 AND src < 60 AND dst < 60").localCheckpoint()
    edges = {(r.src, r.dst): r.dist for r in few.collect()}
    ids = {v: i for i, v in enumerate(sorted({v for e in edges for v in e}))}
    want = R.reduce_complex(R.cliques(len(ids), {(ids[a], ids[b]): d for (a, b), d in edges.items()}, 2), 1)
    assert sorted((r.dim, r.birth, r.death) for r in persistence.persistence_of_edges(few, 1).collect()) == sorted(map(tuple, want))


def test_boundary_by_cells(cloud, simplices, small_blocks):
    from filtra.operators import complexes

    got = complexes.rips_boundary(cloud, RADIUS)
    assert "Join [cloud_id" not in plan(got).split("FlatMapGroupsInArrow")[0]
    assert rows(got.select("cloud_id", "dim", "row", "col", "sign")) == rows(complexes.boundary(simplices))

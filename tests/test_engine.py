"""The DataFrame operators: closed forms, shapes, streams and formats."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from filtra import schema
from filtra.functions import reduce as R
from filtra.functions import sql
from filtra.operators import anomaly, complexes, diagram, distance, graph, kernels, mapper, morse, persistence, spectral, vectorize
from filtra.plans import pipeline
from filtra.sources import formats
from filtra.streaming import windows

INF = math.inf


def cloud(spark, **clouds):
    return spark.createDataFrame([(k, i, [float(v) for v in p]) for k, ps in clouds.items() for i, p in enumerate(ps)], schema.CLOUD)


def dgm(spark, rows):
    return spark.createDataFrame([(str(a), b, float(c), float(d)) for a, b, c, d in rows], schema.DIAGRAM)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


SQUARE = [(0, 0), (1, 0), (0, 1), (1, 1)]
LINE = [(0,), (3,), (4,), (7,)]


def test_persistence_of_clouds(spark):
    p = cloud(spark, square=SQUARE, line=LINE, one=[(5,)])
    got = rows(persistence.persistence(p, 1), "diagram_id", "dim", "birth", F.round("death", 6))
    assert got == [("line", 0, 0, 1), ("line", 0, 0, 3), ("line", 0, 0, 3), ("line", 0, 0, INF), ("one", 0, 0, INF),
                   ("square", 0, 0, 1), ("square", 0, 0, 1), ("square", 0, 0, 1), ("square", 0, 0, INF), ("square", 1, 1, round(math.sqrt(2), 6))]
    assert persistence.persistence(p, 3, engine="ph0").agg(F.max("dim")).first()[0] == 0
    assert persistence.persistence(p.limit(0)).count() == 0
    same = rows(persistence.components_diagram(p, distance.pairwise(p)), "diagram_id", "death")
    assert same == [(a, round(d, 9)) for a, k, _, d in got if k == 0]


def test_joins_build_the_same_complex_as_the_reducer(spark):
    rng = np.random.default_rng(4)
    p = cloud(spark, a=rng.random((14, 2)), b=rng.random((9, 3)))
    c = complexes.vietoris_rips(p, 0.6, 3)
    assert complexes.missing_faces(c).count() == 0
    got = rows(persistence.persistence_of_complex(c, 1), "diagram_id", "dim", F.round("birth", 9), F.round("death", 9))
    assert got == rows(persistence.persistence(p, 1, 0.6), "diagram_id", "dim", F.round("birth", 9), F.round("death", 9))
    edges = distance.range_edges(p, 0.6)
    assert got == rows(persistence.persistence_of_edges(edges, 1, p), "diagram_id", "dim", F.round("birth", 9), F.round("death", 9))
    assert {(r.src, r.dst) for r in edges.collect()} == {(r.src, r.dst) for r in distance.pairwise(p).where("dist <= 0.6").collect()}


def test_bad_points_fail(spark):
    for bad in ([math.nan], [INF], []):
        p = spark.createDataFrame([("a", 0, bad)], schema.CLOUD)
        with pytest.raises(Exception, match="bad point"):
            schema.validate_points(p).collect()
    with pytest.raises(Exception, match="invalid pair"):
        schema.validate_diagram(dgm(spark, [(1, 0, 2, 1)])).collect()
    with pytest.raises(ValueError):
        schema.positive_int(True, "k")
    with pytest.raises(Exception, match="finite"):
        schema.validate_finite_deaths(dgm(spark, [(1, 0, 0, INF)])).collect()


def test_diagram_rules(spark):
    d = dgm(spark, [("a", 0, 0, 1), ("a", 1, 2, 6), ("a", 0, 1, INF), ("b", 0, 5, 5), ("c", 0, 3, INF)])
    assert rows(diagram.replace_infinite(d), "diagram_id", "death") == [("a", 1), ("a", 6), ("a", 12), ("b", 5), ("c", 6)]
    assert rows(diagram.replace_infinite(d, "remove"), "diagram_id") == [("a",), ("a",), ("b",)]
    assert rows(diagram.betti_numbers(d), "diagram_id", "dim", "betti") == [("a", 0, 1), ("a", 1, 0), ("b", 0, 0), ("c", 0, 1)]
    e = dict(rows(diagram.entropy(dgm(spark, [("x", 0, 0, 1), ("x", 0, 0, 1), ("y", 0, 0, 0)])), "diagram_id", "entropy"))
    assert e["x"] == pytest.approx(math.log(2)) and e["y"] == 0
    assert rows(diagram.normalise(dgm(spark, [("s", 0, 5, 5)])), "birth", "death") == [(0, 0)]
    assert rows(diagram.most_persistent(d, 1), "diagram_id", "death") == [("a", INF), ("b", 5), ("c", INF)]
    s = {r.diagram_id: r for r in diagram.statistics(d, False).collect()}
    assert (s["a"].n_features, s["a"].n_infinite, s["a"].total_persistence) == (3, 1, 5) and s["c"].mean_persistence == 0
    assert diagram.clean(diagram.finite_pairs(d), most=2, how="minmax", outliers=True).count() > 0
    assert diagram.random_subsample(d, 1).count() == 3 and diagram.uniform_subsample(d, 2).count() >= 3
    for f in (diagram.statistics, diagram.entropy, diagram.betti_numbers, vectorize.landscape, vectorize.persistence_image, vectorize.betti_curve):
        assert f(d.limit(0)).count() == 0


def test_vectors(spark):
    d = dgm(spark, [("a", 0, 0, 2), ("a", 0, 0, 2), ("a", 0, 1, 3)])
    top = {r.level: r["value"] for r in vectorize.landscape(d, 3, 5, (0, 4)).where("i = 1").collect()}
    assert top == {1: 1, 2: 1, 3: 0}
    assert [r.betti for r in vectorize.betti_curve(d, 4).orderBy("i").collect()] == [2, 3, 1, 0]
    assert [r.betti for r in vectorize.betti_steps(d).orderBy("t").collect()] == [2, 3, 1, 0]
    v = vectorize.fixed_size(vectorize.to_vector(d, "silhouette", samples=7), 10).first()["vector"]
    assert len(v) == 10 and v[7:] == [0, 0, 0]
    image = vectorize.persistence_image(d, 4, normalise=True).agg(F.sum("value")).first()[0]
    assert image == pytest.approx(1)


def test_kernels(spark):
    d = dgm(spark, [("a", 0, 0, 2), ("b", 0, 0, 2), ("c", 0, 0, 5)])
    k = {(r.id_a, r.id_b): r.k for r in kernels.gaussian_kernel(d).collect()}
    assert k["a", "b"] == 1 and k["a", "c"] == pytest.approx(math.exp(-4.5))
    n = kernels.normalise_matrix(kernels.gaussian_kernel(d))
    assert all(r.k == pytest.approx(1) for r in n.where("id_a = id_b").collect())
    assert kernels.centre_matrix(kernels.gaussian_kernel(d)).agg(F.sum("k")).first()[0] == pytest.approx(0)
    s = {(r.id_a, r.id_b): r.dist for r in kernels.sliced_wasserstein(d, 20).collect()}
    assert s["a", "b"] == pytest.approx(0) and s["a", "c"] > 0
    assert {(r.id_a, r.id_b): r.dist for r in kernels.hausdorff(d).collect()}["a", "c"] == 3
    w = {(r.id_a, r.id_b): r.dist for r in persistence.diagram_distances(d, "bottleneck").collect()}
    assert w == {("a", "b"): 0, ("a", "c"): 2.5, ("b", "c"): 2.5}
    assert rows(persistence.match_diagrams(d, d), "diagram_id", "dist") == [("a", 0), ("b", 0), ("c", 0)]


def test_complex_algebra(spark):
    tri = spark.createDataFrame([("a", 2, [0, 1, 2], 1.0), ("a", 1, [2, 3], 0.5)], schema.COMPLEX)
    c = complexes.closure(tri)
    assert rows(c, "dim", "vertices", "filtration")[:4] == [(0, [0], 1), (0, [1], 1), (0, [2], 0.5), (0, [3], 0.5)]
    assert complexes.euler_characteristic(c).first()["euler"] == 1
    b = complexes.boundary(c)
    zero = b.where("dim = 2").alias("x").join(b.where("dim = 1").alias("y"), F.col("x.row") == F.col("y.col"))
    assert zero.groupBy("x.col", "y.row").agg(F.sum(F.col("x.sign") * F.col("y.sign")).alias("s")).where("s <> 0").count() == 0
    assert rows(complexes.link(c, 0), "vertices") == [([1],), ([1, 2],), ([2],)]
    assert complexes.union_min(c, c.withColumn("filtration", F.lit(0.0))).agg(F.max("filtration")).first()[0] == 0
    l = spectral.spectral_features(spectral.spectrum(complexes.laplacian(c, 0))).first()
    assert l.nullity == 1 and l.gap > 0
    grid = spark.createDataFrame([("g", x, y, float((x - 1) ** 2 + y)) for x in range(3) for y in range(2)], "grid_id string, x int, y int, value double")
    assert complexes.euler_characteristic(complexes.level_set(grid)).first()["euler"] == 1
    assert rows(complexes.grid_extrema(grid).where("kind = 'minimum'"), "x", "y") == [(1, 0)]
    assert rows(persistence.persistence_of_grid(grid), "dim", "birth", "death") == [(0, 0, INF)]


def test_graphs(spark):
    v = spark.createDataFrame([(i,) for i in range(40)], "v long")
    e = spark.createDataFrame([(i, i + 1) for i in range(19)] + [(25, 25 + i) for i in range(1, 8)] + [(30, 31), (5, 5)], "src long, dst long")
    got = dict(rows(graph.components(v, e), "v", "component"))
    assert all(got[i] == 0 for i in range(20)) and all(got[i] == 25 for i in range(25, 33)) and got[39] == 39
    assert tuple(graph.betti(v, e).first()) == (40 - 19 - 7, 1)
    assert rows(graph.hops(e, spark.createDataFrame([(17,)], "v long")).where("hops <= 2"), "v", "hops") == [(15, 2), (16, 1), (17, 0), (18, 1), (19, 2)]
    w = spark.createDataFrame([("c", 0, 1, 1.0), ("c", 1, 2, 1.0), ("c", 0, 2, 1.0), ("c", 2, 3, 5.0), ("d", 0, 1, 2.0)], schema.EDGES)
    assert rows(graph.spanning_forest(w), "cloud_id", "src", "dst") == [("c", 0, 1), ("c", 0, 2), ("c", 2, 3), ("d", 0, 1)]
    ev = spark.createDataFrame([("x", "add", 1), ("x", "remove", 4), ("y", "add", 2)], "key string, op string, time int")
    assert rows(graph.event_lifetimes(ev), "key", "birth", "death") == [("x", 1, 4), ("y", 2, INF)]


def test_mapper_of_a_circle(spark):
    p = formats.circle(spark, 300)
    for how, options in (("single_linkage", {"eps": 0.3}), ("dbscan", {"eps": 0.3, "least": 2})):
        _, nodes, edges = mapper.mapper(p, "coordinate", 6, 0.5, how, **options)
        n, m = nodes.count(), edges.count()
        assert n == m and n >= 8  # one loop
    _, nodes, _ = mapper.mapper(p, "eccentricity", 3)
    assert nodes.count() >= 1
    assert mapper.mapper(p, "pca", 4, how="kmeans", k=2)[1].count() == 8


def test_series(spark):
    s = spark.createDataFrame([("a", i, float(i >= 10)) for i in range(20)], "k string, t int, v double")
    best = anomaly.change_points(s, "k", "t", "v", 5).orderBy(F.desc("change")).first()
    assert (best.t, best.change) == (10, 1)
    assert anomaly.trend(s, "k", "t", "v").first().trending
    assert anomaly.ks_statistic(s.where("t < 10"), s.where("t >= 10"), "k", "v").first().ks == 1
    assert rows(anomaly.regimes(s, "k", "t", "v"), "v", "start", "stop", "n") == [(0, 0, 9, 10), (1, 10, 19, 10)]
    z = spark.createDataFrame([(0.0,), (1.96,)], "z double").select(anomaly.p_value(F.col("z")).alias("p")).collect()
    assert z[0].p == pytest.approx(1, abs=1e-6) and z[1].p == pytest.approx(0.05, abs=1e-4)
    left = spark.createDataFrame([("a", 1), ("a", 5)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 7.0), ("a", 5, 9.0)], "k string, t int, v double")
    assert [r.last_v for r in anomaly.as_of(left, right, "k", "t", "v").orderBy("t").collect()] == [None, 9]
    t = spark.createDataFrame([("f", 0.01), ("f", 0.02), ("f", 0.9)], "f string, p double")
    assert [round(r.adjusted, 6) for r in anomaly.benjamini_hochberg(t, "f").orderBy("p").collect()] == [0.03, 0.03, 0.9]
    d = anomaly.lifetime_drift(s, "k", "t", "v", 5, 5, 0.3).where("drift").count()
    assert d > 0
    p = anomaly.permutation_test(s.where("t < 10"), s.where("t >= 10"), "v", 50).first()
    assert p.difference == -1 and p.p < 0.1


def test_formats(spark, tmp_path):
    d = dgm(spark, [("a", 0, 0, 1), ("a", 1, 0.5, INF)])
    formats.auto_save(d, f"{tmp_path}/x.csv")
    assert rows(formats.auto_load(spark, f"{tmp_path}/x.csv"), "dim", "birth", "death") == [(0, 0, 1), (1, 0.5, INF)]
    formats.save_json(d, f"{tmp_path}/y")
    assert rows(formats.load_json_lines(spark, f"{tmp_path}/y"), "dim", "birth", "death") == [(0, 0, 1), (1, 0.5, INF)]
    (tmp_path / "z.json").write_text('{"diagrams": [[{"birth": 1, "death": null, "dimension": 1}], [{"birth": 0, "death": 2, "dimension": 0}]]}')
    assert rows(formats.load_json(spark, f"{tmp_path}/z.json"), "dim", "birth", "death") == [(0, 0, 2), (1, 1, INF)]
    (tmp_path / "c.csv").write_text("birth,death,dimension\n0,,0\n1,2,1\n")
    assert rows(formats.load_csv(spark, f"{tmp_path}/c.csv"), "dim", "birth", "death") == [(0, 0, INF), (1, 1, 2)]
    p = cloud(spark, c=[(0, 1, 2), (3, 4, 5.5)])
    (tmp_path / "m.off").write_text(formats.off_text(p).first()["value"])
    (tmp_path / "m.ply").write_text(formats.ply_text(p).first()["value"])
    np.save(tmp_path / "m.npy", np.array([[0, 1, 2], [3, 4, 5.5]]))
    for kind in ("off", "ply", "npy"):
        assert rows(formats.load_cloud(spark, f"{tmp_path}/m.{kind}"), "point_id", "coords") == [(0, [0, 1, 2]), (1, [3, 4, 5.5])]
    assert rows(formats.from_lists(spark, {"dgms": [[(0, 1)], [(2, INF)]]}), "dim", "birth", "death") == [(0, 0, 1), (1, 2, INF)]
    assert rows(formats.from_pairs(spark, [(1, (0, 2)), (0.0, 1.0, 0)]), "dim", "birth", "death") == [(0, 0, 1), (1, 0, 2)]
    for f in (formats.sphere, formats.torus, formats.swiss_roll, formats.mobius_strip, formats.klein_bottle):
        assert f(spark, 10).where(schema.valid_point()).count() == 10


def test_sql_names(spark):
    sql.register(spark)
    cloud(spark, a=SQUARE, b=LINE).createOrReplaceTempView("clouds")
    got = spark.sql("SELECT * FROM vr_persistence(TABLE(SELECT * FROM clouds) PARTITION BY cloud_id)")
    assert rows(got.where("dim = 0 AND diagram_id = 'b'"), "death") == [(1,), (3,), (3,), (INF,)]
    w = spark.sql("SELECT diagram_bottleneck(array(named_struct('birth', 0D, 'death', 4D)), array(named_struct('birth', 0D, 'death', 5D))) AS d").first()
    assert w.d == 1


def test_streams_agree_with_batch(spark, tmp_path):
    rng = np.random.default_rng(2)
    data = [(c, i, rng.random(2).tolist()) for c in "ab" for i in range(25)]
    src = spark.createDataFrame(data, "cloud_id string, seq long, coords array<double>")
    src.where("seq < 13").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    out = lambda: windows.run_to_table(windows.count_windows(spark.readStream.schema(src.schema).parquet(f"{tmp_path}/in"), 10, 5, 1), f"{tmp_path}/out", f"{tmp_path}/state")
    out()
    src.where("seq >= 13").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    out()
    got = spark.read.parquet(f"{tmp_path}/out").select(F.concat_ws("/", "cloud_id", F.col("window").cast("string")).alias("diagram_id"), "dim", "birth", "death")
    want = persistence.persistence_of_chunks(src.withColumnRenamed("seq", "point_id"), 10, 5, 1, full_only=True)
    assert rows(got, "*") == rows(want, "*") and got.count() > 0


def test_simplex_event_stream(spark, tmp_path):
    e = [("a", 0, "add", [0]), ("a", 1, "add", [1]), ("a", 2, "add", [0, 1])], [("a", 3, "remove", [0, 1]), ("a", 4, "remove", [9])]
    for part in e:
        spark.createDataFrame(part, "cloud_id string, seq long, op string, vertices array<long>").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        s = spark.readStream.schema("cloud_id string, seq long, op string, vertices array<long>").parquet(f"{tmp_path}/in")
        windows.run_to_table(windows.simplex_events(s), f"{tmp_path}/out", f"{tmp_path}/state")
    assert rows(spark.read.parquet(f"{tmp_path}/out"), "window", "dim", "birth", "death") == [(0, 0, 0, 1), (0, 0, 0, INF), (1, 0, 0, INF), (1, 0, 0, INF)]


def test_pipelines(spark):
    p = cloud(spark, a=SQUARE, b=LINE)
    assert pipeline.vr_pipeline(1, least=2.0)(p).count() == 4
    assert pipeline.analysis_pipeline(1, "silhouette", samples=8)(p).count() == 2
    both = pipeline.side_by_side(n=lambda d: d.groupBy("diagram_id").count(), e=diagram.entropy)(persistence.persistence(p))
    assert both.count() == 4 and set(both.columns) == {"diagram_id", "count", "entropy", "branch"}
    assert pipeline.conditional(False, lambda d: d.limit(0))(p).count() == 8


def test_sheaf_laplacian_of_a_constant_sheaf_is_the_graph_laplacian(spark):
    e = spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long")
    maps = e.select("src", "dst", F.explode(F.array("src", "dst")).alias("vertex")).select("src", "dst", "vertex", F.lit(0).alias("a"), F.lit(0).alias("i"), F.lit(1.0).alias("value"))
    got = rows(spectral.sheaf_laplacian(e, maps), "row", "col", "value")
    assert got == [(float(a), float(b), float(v)) for a, b, v in rows(graph.laplacian(e), "row", "col", "value")]


def test_bootstrap_and_sweep_repeat(spark):
    p = cloud(spark, a=SQUARE, b=LINE)
    assert rows(persistence.bootstrap(p, 2), "*") == rows(persistence.bootstrap(p.repartition(3), 2), "*")
    assert persistence.sweep(p, [1.0, 2.0], [0]).select("radius").distinct().count() == 2
    assert rows(persistence.sparse_rips(p, 100.0), "diagram_id", "death") == [("a", INF), ("b", INF)]


def test_ml_stages(spark):
    from pyspark.ml import PipelineModel

    from filtra.plans.estimators import MapperTransformer, PersistenceTransformer, VectorTransformer

    p = cloud(spark, a=SQUARE, b=LINE)
    v = PipelineModel([PersistenceTransformer(), VectorTransformer("silhouette", 12, samples=10)]).transform(p)
    assert all(len(r["vector"]) == 12 for r in v.collect()) and v.count() == 2
    assert PersistenceTransformer(method="heat", samples=5).transform(p).count() == 2
    assert MapperTransformer("coordinate", 4).transform(formats.circle(spark, 50)).count() == 3


def test_gradients(spark):
    rng = np.random.default_rng(3)
    c = complexes.vietoris_rips(cloud(spark, a=rng.random((10, 2))), 0.5)
    m = morse.morse_matching(c)
    euler = lambda x: x.agg(F.sum(F.when(F.col("dim") % 2 == 0, 1).otherwise(-1))).first()[0]
    assert euler(m.where("partner IS NULL")) == euler(c)
    grid = spark.createDataFrame([("g", x, 0, float(v)) for x, v in enumerate([3, 1, 2, 5, 4, 0, 9])], "grid_id string, x int, y int, value double")
    assert rows(morse.watershed(grid), "x", "bx") == [(0, 1), (1, 1), (2, 1), (3, 1), (4, 5), (5, 5), (6, 5)]
    v = spark.createDataFrame([(i, float(min(i, 8 - i))) for i in range(8)], "v long, value double")
    e = spark.createDataFrame([(i, (i + 1) % 8) for i in range(8)], "src long, dst long")
    cover = morse.level_components(v, e, 4)
    assert morse.reeb_edges(cover, e).count() == cover.select("component").distinct().count()  # one loop


def test_similar_vectors(spark):
    v = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [0.1, 0.0]), ("c", [9.0, 9.0])], "diagram_id string, vector array<double>")
    assert rows(kernels.similar_vectors(v, 1.0, 2.0), "id_a", "id_b") == [("a", "b")]
    d = dgm(spark, [("a", 0, 0, 1), ("b", 0, 0, 1), ("c", 0, 5, 6)])
    assert rows(kernels.cell_distance(d), "id_a", "id_b", "dist") == [("a", "b", 0), ("a", "c", 2), ("b", "c", 2)]


def _as_plane(monkeypatch, clouds):
    from filtra.plans import registry

    monkeypatch.setattr(registry.I, "part_plane", lambda spark, sf: clouds)
    return registry.queries()


def test_registered_h1_takes_whole_clouds(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.random((60, 2)) * 12
    got = _as_plane(monkeypatch, cloud(spark, a=x))["vr_persistence_h1"](spark, "")
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    edges = {(i, j): float(d[i, j]) for i in range(60) for j in range(i + 1, 60) if d[i, j] <= 6.0}
    want = R.reduce_complex(R.cliques(60, edges, 2), 1)
    key = lambda p: (p[0], round(p[1], 6), None if p[2] == INF else round(p[2], 6))
    assert sorted(map(str, map(key, want))) == sorted(str((r.dim, r.birth, r.death)) for r in got.collect())


def test_witness_persistence_uses_every_witness(spark, monkeypatch):
    rng = np.random.default_rng(5)
    t = np.sort(rng.random(70)) * 2 * math.pi
    x = np.c_[np.cos(t), np.sin(t)] * 5 + rng.random((70, 2))
    got = _as_plane(monkeypatch, cloud(spark, a=x))["witness_persistence"](spark, "")
    at = R.farthest_points(x, 40)
    d = np.linalg.norm(x[:, None] - x[at][None], axis=2)
    edges = {(i, j): float(np.maximum(d[:, i], d[:, j]).min()) for i in range(40) for j in range(i + 1, 40)}
    want = R.reduce_complex(R.cliques(40, edges, 2), 1)
    near = lambda p: (float(p[0]), p[1], -1.0 if p[2] in (INF, None) else p[2])
    got = sorted(near((r.dim, r.birth, r.death)) for r in got.collect())
    assert len(got) == len(want) and np.allclose(got, sorted(map(near, want)), atol=1e-5)
    pair = persistence.witness_edges(cloud(spark, a=[[0.0, 0.0], [4.0, 0.0]]), cloud(spark, a=[[0.0, 0.0], [2.0, 0.0], [4.0, 0.0]]))
    assert rows(pair, "dist") == [(2.0,)]

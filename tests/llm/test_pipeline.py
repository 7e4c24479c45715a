import random

import pytest

import corpus_pipeline as P


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    bench = [(i, text(30)) for i in range(5)]
    clean = [text(rng.randint(60, 150)) for _ in range(120)]
    docs = [(i, t) for i, t in enumerate(clean)]
    docs += [(200 + i, clean[i]) for i in range(5)]  # copies
    docs += [(300 + i, " ".join(w + "***" for w in text(80).split())) for i in range(40)]  # junk
    docs += [(400 + i, text(10) + "\n" + bench[i][1] + "\n" + text(10)) for i in range(5)]  # leaks
    rows = [(i, t, "en", rng.choice(["s0", "s1", "s2"]), len(t)) for i, t in docs]
    rows += [(500, None, None, None, None), (501, "", "en", "s0", 0)]
    labels = [(i, int(not 300 <= i < 400), 0) for i, *_ in rows]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), {i for i, *_ in rows}


def test_stages_keep_what_they_should(spark, folder):
    d, ids = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names, columns = [n for n, _ in P.STAGES], docs.columns
    assert len(names) == 5
    seen = {}
    for name, stage in P.STAGES:
        docs = stage(spark, docs, d)
        rows = docs.collect()
        assert docs.columns == columns
        seen[name] = [r.doc_id for r in rows]
        docs = spark.createDataFrame(rows, docs.schema)
    clean = set(range(120))
    assert clean <= set(seen["quality"]) and len([i for i in seen["quality"] if 300 <= i < 400]) <= 4
    assert set(seen["lines"]) == set(seen["quality"])
    assert clean <= set(seen["near_duplicates"])
    assert not set(range(400, 405)) & set(seen["benchmark"]) and clean <= set(seen["benchmark"])
    assert set(seen["mixture"]) <= set(seen["benchmark"])


def test_run(spark, folder):
    d, _ = folder
    out = P.run(spark, d)
    assert out.count() > 100 and P.ORACLE_SQL is None

import math
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from filtra.llm import quality_classifier as Q
from filtra.llm import toxicity as T
from filtra.llm.common import held_out


def full_scores(hits, n):
    x = [-T.DRIFT] * n
    for i, s in hits:
        x[i] = s
    return x


def brute_segments(x):
    """All maximal scoring subsequences by their definition: repeatedly the best, then left and right of it."""

    def solve(lo, hi):
        best = None
        for a in range(lo, hi):
            total = 0.0
            for b in range(a, hi):
                total += x[b]
                if total > 1e-12 and (best is None or total > best[0] + 1e-12):
                    best = (total, a, b + 1)
        return solve(lo, best[1]) + [best] + solve(best[2], hi) if best else []

    return solve(0, len(x))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([None, None, None, 1.2371, 3.0113, -2.0307, 0.7619]), max_size=25))
def test_segments_are_the_maximal_ones(values):
    hits = [(i, v) for i, v in enumerate(values) if v is not None]
    got = T.segments(hits)
    want = brute_segments(full_scores(hits, len(values)))
    assert [round(s, 6) for s, _, _ in got] == [round(s, 6) for s, _, _ in want]


def test_segments_take_linear_time():
    began = time.perf_counter()
    for sign in (1, -1):
        T.segments([(i, 1.0 + sign * i * 1e-6 if i % 2 else -1.0) for i in range(400_000)])
        T.segments([(3 * i, 1.0 + sign * i * 1e-6) for i in range(200_000)])
    assert time.perf_counter() - began < 30


def test_stems_end_between_characters():
    assert T.stems("äöüß".encode()) == ["äö*".encode(), "äöü*".encode()]


def test_clean_words_have_log_odds(spark):
    docs, labels = corpus(spark)
    model = T.fit(docs, labels, ~held_out("_id", 3, 1))
    clean = {w: x for w, x in model.weight.items() if x < 0}
    assert len(clean) > 50 and all(x <= -T.DRIFT for x in clean.values()) and len(set(clean.values())) > 5


def test_names_that_clash(spark):
    docs, labels = corpus(spark, 60)
    names = ["label", "_id", "part", "score", "quality", "word"]
    more = docs.select("*", *[F.lit(n).alias(n) for n in names])
    model, machine = T.fit(more, labels, F.lit(True)), Q.fit(more, labels, F.lit(True))
    rows = T.score_toxicity(Q.score_quality(more, machine, out="good"), model).collect()
    assert len(rows) == docs.count() and all([r[n] for n in names] == names for r in rows)
    with pytest.raises(ValueError):
        Q.score_quality(more, machine)


def test_lambda_solves_its_equation():
    w, p = np.array([4.0, 2.0]), np.array([0.001, 0.01])
    x = T.karlin_lambda(w, p)
    assert abs((p * np.exp(x * w)).sum() + (1 - p.sum()) * math.exp(-x * T.DRIFT) - 1) < 1e-6


def corpus(spark, n=600, seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(2000)]
    docs, labels = [], []
    for i in range(n):
        toxic, junk = rng.random() < 0.3, rng.random() < 0.3
        words = [rng.choice(vocab) for _ in range(rng.randint(30, 200))]
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["vilewort", "badmouth"]) + rng.choice(["", "e", "er"])
        if junk:
            words = [w + rng.choice(["***", "$$$"]) for w in words]
        docs.append((i, " ".join(words), len(words)))
        labels.append((i, int(not junk), int(toxic)))
    docs += [(9001, None, None), (9002, "", 0), (3, docs[3][1], None), (None, docs[4][1], 1)]
    labels += [(9003, 1, 1), (5, None, None), (None, 1, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark):
    docs, labels = corpus(spark)
    model = T.fit(docs, labels, ~held_out("_id", 3, 1))
    rows = T.score_toxicity(docs, model).join(labels, "doc_id").where(held_out("doc_id", 3, 1) & F.col("toxic").isNotNull()).collect()
    right = sum((r.toxicity.score >= 0.7) == bool(r.toxic) for r in rows)
    assert right >= 0.95 * len(rows)
    every = T.score_toxicity(docs, model).collect()
    assert len(every) == docs.count() and all(0 <= r.toxicity.score <= 1 for r in every)
    some = next(r for r in every if r.toxicity.passages)
    p = some.toxicity.passages[0]
    assert any(w.startswith(("vilewort", "badmouth")) for w in some.text.split()[p.start : p.stop])


def test_nothing_to_learn_from(spark):
    docs, labels = corpus(spark, 5)
    for few in (labels.limit(0), labels.where("toxic = 0")):
        model = T.fit(docs, few, F.lit(True))
        assert T.score_toxicity(docs, model).count() == docs.count()
        machine = Q.fit(docs, few, F.lit(True))
        assert Q.score_quality(docs, machine).count() == docs.count()
    assert T.score_toxicity(docs.limit(0), model).count() == 0


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    m = Q.FactorMachine(0.3, rng.normal(size=Q.SIZE).astype(np.float32), rng.normal(size=(Q.SIZE, Q.FACTORS)).astype(np.float32))
    at, value = Q.inputs("One two two *** three.\nOne".encode(), 25)
    pairs = sum(float(m.factor[at[i]] @ m.factor[at[j]]) * value[i] * value[j] for i in range(len(at)) for j in range(i))
    assert m.raw(at, value) == pytest.approx(0.3 + float(m.weight[at] @ value) + pairs, rel=1e-4, abs=1e-3)


def test_quality_held_out(spark):
    docs, labels = corpus(spark)
    machine = Q.fit(docs, labels, ~held_out("_id", 5, 0))
    scored = Q.score_quality(docs, machine)
    told = labels.select("doc_id", F.col("quality").alias("label"))
    rows = scored.join(told, "doc_id").where(held_out("doc_id", 5, 0) & F.col("label").isNotNull() & F.col("text").isNotNull()).collect()
    right = sum((r.quality >= 0.3) == bool(r.label) for r in rows)
    assert right >= 0.95 * len(rows)
    assert scored.where("quality IS NULL").count() == 0


def test_few_bytes_are_gathered(spark, monkeypatch):
    docs, labels = corpus(spark)
    seen = []
    monkeypatch.setattr(Q, "train_machine", lambda data, label: seen.append(len(data)))
    Q.fit(docs, labels, F.lit(True))
    Q.fit(docs, labels, F.lit(True), most_bytes=600_000)
    assert 0 < seen[1] < 0.7 * seen[0]


def test_labels_and_source_never_enter_a_score(spark):
    docs, labels = corpus(spark, 200)
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.col("doc_id").cast("string"))
    machine = Q.fit(docs, labels, F.lit(True))
    a = {r.doc_id: r.quality for r in Q.score_quality(docs, machine).collect()}
    b = {r.doc_id: r.quality for r in Q.score_quality(other.select(F.lit(1).alias("z"), *other.columns), machine).collect()}
    assert a == b

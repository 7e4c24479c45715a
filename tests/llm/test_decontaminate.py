import hashlib
import random
import re
import time

import numpy as np
import pytest

from filtra.llm import decontaminate as D


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def brute(text, items, window=13):
    w = words(text)
    hit, got, longest = set(), set(), 0
    for item, t in items:
        v = words(t)
        k = min(window, len(v))
        for i in range(len(v) - k + 1 if v else 0):
            for p in range(len(w) - k + 1):
                if w[p : p + k] == v[i : i + k]:
                    hit |= set(range(p, p + k))
                    got |= {str(item)} - {"None"}
                    n = k
                    while p + n < len(w) and i + n < len(v) and w[p + n] == v[i + n]:
                        n += 1
                    longest = max(longest, n)
    return len(w), len(hit), sorted(got), longest, bool(hit) and 20 * len(hit) >= len(w)


def case(seed):
    rng = random.Random(seed)
    vocab = ["the", "of", "Äpfel", "x1", "run", "go", "zu", "b"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([2, 5, 13, 14, 30]))) for i in range(6)] + [(50, None), (51, " . "), (None, "the of"), (52, "Run, go!  ZU; b b b b the")]
    docs = []
    for i in range(30):
        t = text(rng.choice([0, 1, 12, 60, 300]))
        if i % 3 == 0:
            t = t.replace(" ", " zzz ", 40) + ".\n" + rng.choice(items)[1].__str__().upper() + " , " + text(3)
        docs.append((i, t))
    return docs + [(98, None), (99, ""), (3, docs[3][1]), (None, docs[0][1])], items


@pytest.mark.parametrize("block_bytes", [1, 1 << 20])
def test_against_brute_force(spark, block_bytes, monkeypatch):
    for seed in (1, 2):
        docs, items = case(seed)
        df = spark.createDataFrame([(a, b, "clash") for a, b in docs], "doc_id long, text string, n_words string")
        got = D.find_matches(df, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
        rows = got.select("doc_id", "text", "found", D.hit_words().alias("h"), D.contaminated().alias("c")).collect()
        assert len(rows) == len(docs)
        for r in rows:
            assert (r.found.n_words, r.h, sorted(r.found["items"]), r.found.longest, r.c) == brute(r.text, items)
        assert D.decontaminate(df, spark.createDataFrame(items, "item_id long, text string")).columns == df.columns


def test_empty_tables(spark):
    docs, items = case(1)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert D.find_matches(d.limit(0), b).count() == 0
    assert D.decontaminate(d, b.limit(0)).count() == len(docs)


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(0)
    for n in (1, 2, 50, 400):
        t = rng.integers(0, 3, n)
        order = D.suffix_array(t)
        suffixes = [t[i:].tolist() for i in order]
        assert suffixes == sorted(suffixes) and sorted(order.tolist()) == list(range(n))


def test_shards_of_one_document_agree(monkeypatch):
    docs, items = case(3)
    block = D.TestBlock(items, 13)
    arrays = [block.numbers(D.words_alnum((t or "").encode())) for _, t in docs]
    whole = D.match_shard(arrays, block)
    alone = [D.match_shard([a], block)[0] for a in arrays]
    assert whole == alone
    monkeypatch.setattr(D, "CHUNK", 7)
    assert D.match_shard(arrays, block) == alone


def test_the_same_word_over_and_over():
    """Every place matches every window: what is held stays in proportion to the text."""
    block = D.TestBlock([(1, "the " * 60), (2, "x " + "the " * 20)], 13)
    began = time.perf_counter()
    found = D.match_shard([block.numbers([b"the"] * 80_000)], block)[0]
    assert found == {"spans": [(0, 80_000)], "rows": {0, 1}, "longest": (60, 0, 0)}
    assert time.perf_counter() - began < 60


def test_what_the_stage_drops(spark):
    rng = random.Random(1)
    text = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(6)) for _ in range(n))
    item = text(40)
    docs = [(1, text(900) + " " + " ".join(item.split()[5:19]) + " " + text(300)), (2, text(50)), (3, "of the " + text(60)), (4, "of the"), (5, None)]
    df = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id long, text string, found string, n_words string")
    kept = D.decontaminate(df, spark.createDataFrame([(1, item), (2, "of the")], "item_id long, text string"))
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {2, 3, 5}
    with pytest.raises(ValueError):
        D.find_matches(df, df.select("doc_id", "text"), item_col="doc_id")


def test_digest_of_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")

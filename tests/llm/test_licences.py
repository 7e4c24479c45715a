import random
import re

import pytest

from filtra.llm import license_scan as N


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def base(t):
    w, out = words(t), []
    for label, phrase in N.BASE.items():
        p = phrase.split()
        out += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    return w, out


TEXTS = [
    "Licensed under the Apache License, Version 2.0.",
    "Released UNDER THE MIT LICENSE. cc by nc; CC-BY-NC under the mit license",
    "This work is licensed under the GNU General Public License, version 3.",
    "the quick brown licence fox", "", None, "apache license version 22", "apache\nlicense\tversion 2 " * 50,
    "MIT", "under the mit", "x" * 200000 + " under the mit license",
    "gnu general public license without more", "cc by 4.0", "zoë under the mit license é",
]


def test_base_places_against_brute_force(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(1, TEXTS[1], "x")], "doc_id long, text string, scan2 string")
    rows = N.scan_licences(df).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        w, hits = base(r.text)
        places = [i for i, _ in hits]
        assert (r.scan.n_words, r.scan.n_base) == (len(w), len(hits))
        assert (r.scan.first_word, r.scan.last_word) == (min(places, default=None), max(places, default=None))
        assert r.scan.base_labels == ",".join(sorted({x for _, x in hits}))
        assert set(r.scan.base_labels.split(",")) <= set(r.scan.labels.split(",")) | {""}
        assert 0 <= r.scan.score <= 1


@pytest.mark.parametrize("label, text", [
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc", "This work is licensed under CC BY-NC 4.0."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License);"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided"),
])
def test_notices(label, text):
    assert label in N.LicenceIndex({}, 10).scan(N.words_alnum(text.encode()))["labels"].split(",")


def test_key_phrase_is_mandatory():
    found = N.LicenceIndex({}, 10).scan(N.words_alnum(b"this work is licensed under the gnu general public licence version 3"))
    assert found["labels"] == "" and found["score"] == 0


def test_postings_start_at_the_rarest_word():
    index = N.LicenceIndex({b"mit": 1, b"license": 900, b"under": 1000, b"the": 1000}, 1000, [], {"mit": "under the mit license"})
    assert index.rarest == [b"mit"] and {w: p for w, p in index.postings.items()}[b"mit"] == [(0, 2)]
    assert index.starts({b"mit": [2, 9], b"under": [0, 7], b"the": [1, 8], b"license": [3]}) == {0: [0]}


def scan_by_brute_force(index, w):
    """Labels and score by trying every entry at every place."""
    labels, score, n = set(), 0.0, len(w)
    for e, (label, entry, keys) in enumerate(index.entries):
        for start in range(-len(entry), n + 1):
            at = [0 <= start + i < n and w[start + i] == x for i, x in enumerate(entry)]
            if keys is None:
                if all(at):
                    labels.add(label)
                    score = 1.0
                continue
            first = [next(i for i in range(len(entry)) if entry[i : i + len(k)] == k) for k in keys]
            if all(at[i] for f, k in zip(first, keys) for i in range(f, f + len(k))):
                share = min(1.0, sum(max(index.idf[x], 0.0) for x, ok in zip(entry, at) if ok) / index.weight[e])
                if share >= N.LEAST_COVER:
                    labels.add(label)
                    score = max(score, share)
    return ",".join(sorted(labels)), score


def test_labels_and_score_against_brute_force():
    rng = random.Random(2)
    df = {w: rng.choice([0, 1, 5, 50, 99]) for w in N.LicenceIndex({}, 0).vocabulary}
    index = N.LicenceIndex(df, 100)
    found = 0
    for _ in range(300):
        w = []
        for _ in range(rng.randint(0, 3)):
            notice = rng.choice(N.TEMPLATES)[1].split()
            for _ in range(rng.choice([0, 0, 1, 3])):
                notice[rng.randrange(len(notice))] = rng.choice(["license", "the", "zzz", "version"])
            w += notice[rng.choice([0, 0, 1, 4]) :] + rng.choice([[], ["x"], ["the", "license"]])
        w = [x.encode() for x in w]
        got = index.scan(w)
        labels, score = scan_by_brute_force(index, w)
        assert got["labels"] == labels and got["score"] == pytest.approx(score)
        found += bool(labels)
    assert found > 100


def test_a_column_called_as_the_result(spark):
    with pytest.raises(ValueError):
        N.scan_licences(spark.createDataFrame([(1, "x", "y")], "doc_id long, text string, scan string"))


def test_empty_table(spark):
    assert N.scan_licences(spark.createDataFrame([], "doc_id long, text string")).count() == 0

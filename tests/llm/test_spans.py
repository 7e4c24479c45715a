import random
import re
import time

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from filtra.llm import span_dedup as S


def _signed_hash(text):
    x = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
    return x - (1 << 64) if x >> 63 else x


def plain_sentences(text):
    """(start, stop, words) by the definition alone: cut at line ends, and after . ! ? before white space."""
    out, start = [], 0
    for i in range(len(text) + 1):
        here = text[i : i + 1]
        mark = here in (".", "!", "?") and here and (i + 1 == len(text) or text[i + 1].isspace())
        if mark or here in ("\n", ""):
            piece = text[start : i + bool(mark)]
            words = re.findall(r"[0-9a-z\x80-\U0010FFFF]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in piece))
            if words:
                out.append(words)
            start = i + bool(mark)
    return out


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab Z.!?\n\té5", max_size=40))
def test_sentences_by_their_definition(text):
    assert [s[2].decode().split(" ") for s in S.sentences(text.encode())] == plain_sentences(text)


@pytest.mark.parametrize("part", ["!", "!x", ". ", "a.", "\n"])
def test_sentences_take_linear_time(part):
    began = time.perf_counter()
    S.sentences((part * (2_000_000 // len(part)) + "x").encode())
    assert time.perf_counter() - began < 20


def test_names_that_clash(spark):
    names = ["place", "places", "doc", "key", "d", "k", "row", "_d", "_doc", "_places", "hash", "first_docs"]
    text = " ".join(f"word{i}" for i in range(25)) + "."
    df = spark.createDataFrame([(i, text, *names) for i in range(2)], ["doc_id", "text", *names])
    rows = S.remove_spans(df).orderBy("doc_id").collect()
    assert [r.dedup.n_removed for r in rows] == [0, 1] and all([r[n] for n in names] == names for r in rows)
    with pytest.raises(ValueError):
        S.remove_spans(df, out="ROW")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=30))
def test_runs_are_the_shortest(sizes):
    got = S.runs(sizes)
    want = set()
    for i in range(len(sizes)):
        for j in range(i + 1, len(sizes) + 1):
            if sum(sizes[i:j]) >= S.RUN_WORDS and (sum(sizes[i : j - 1]) < S.RUN_WORDS or sum(sizes[i + 1 : j]) < S.RUN_WORDS):
                want.add((i, j))
    assert set(got) == want and len(got) == len(want)


def test_sentences_end_at_marks_and_lines():
    parts = [S_[2] for S_ in S.sentences("One two. Three 3.5 four!\n...\nFive\tsix? seven".encode())]
    assert parts == [b"one two", b"three 3 5 four", b"five six", b"seven"]


def brute(docs):
    """Sentences to remove, by comparing every run with every earlier one."""
    seen, gone = {}, {}
    for i, text in sorted(dict.fromkeys(docs), key=lambda d: ((1 << 63) - 1 if d[0] is None else d[0], _signed_hash(d[1]))):
        found = S.sentences(text.encode()) if text else []
        for a, b in S.runs([s[3] for s in found]):
            key = b" ".join(s[2] for s in found[a:b])
            if key in seen:
                gone.setdefault((i, text), set()).update(range(a, b))
            seen.setdefault(key, (i, text, a))
    return gone


def test_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("the of run blue zürich going far 12 x".split()) + rng.choice("abcdefghij")
    sentence = lambda: " ".join(word() for _ in range(rng.randint(1, 15))).capitalize() + rng.choice([".", "!", "?", "\n"])
    passages = [" ".join(sentence() for _ in range(8)) for _ in range(4)]
    docs = []
    for i in range(30):
        parts = [sentence() for _ in range(rng.randint(0, 12))]
        for _ in range(rng.randint(0, 2)):
            parts.insert(rng.randint(0, len(parts)), rng.choice(passages))
        docs.append((i, " ".join(parts)))
    docs += [(40, docs[2][1]), (41, docs[2][1].upper()), (42, None), (43, ""), (5, docs[5][1]), (5, "Other text. " + docs[6][1]), (None, docs[7][1])]
    df = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, place int")
    gone = brute(docs)
    rows = S.remove_spans(df).collect()
    assert len(rows) == len(docs) and gone
    for r in rows:
        want = gone.get((r.doc_id, r.text), set())
        assert r.dedup.n_removed == len(want)
        if r.text is not None:
            found = S.sentences(r.text.encode())
            left = [s[2] for i, s in enumerate(found) if i not in want]
            assert [s[2] for s in S.sentences(r.dedup.text.encode())] == left
            if not want:
                assert r.dedup.text == r.text


def test_planted_passage_goes_from_all_but_the_first(spark):
    rng = random.Random(6)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) + ("." if k % 9 == 8 else "") for k in range(n)) + "."
    passage = text(60)
    docs = [(i, text(80) + " " + (passage + " " if i % 3 == 0 else "") + text(50)) for i in range(30)]
    rows = S.remove_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    for r in rows:
        assert (r.dedup.n_removed_words >= 45) == (r.doc_id % 3 == 0 and r.doc_id > 0)
        assert r.dedup.first_docs == ([0] if r.dedup.n_removed else [])


def test_empty_table(spark):
    assert S.remove_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0

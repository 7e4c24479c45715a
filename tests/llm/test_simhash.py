import random

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from filtra.llm.components import connected_components
from filtra.llm.simhash_dedup import covering_masks, hamming_links, near_dedup, simhash, simhash_components


def brute_fp(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    if not w:
        return 0
    sh = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(values, near):
    label = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i in range(len(values)):
            for j in range(len(values)):
                if near(values[i], values[j]) and label[j] > label[i]:
                    label[j] = label[i]
                    changed = True
    return label


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["A", "b", "ÄÖ", "c.", "the", "\x0bx", " ", "Zz"]), max_size=40), st.sampled_from([" ", "\n", "  \t"]))
def test_fingerprint_matches_definition(words, sep):
    t = sep.join(words)
    assert simhash(t.encode()) == brute_fp(t)


def test_masks_cover_every_small_set():
    masks = covering_masks(4)
    rng = random.Random(1)
    assert all(m.bit_count() >= 32 for m in masks)
    for _ in range(20000):
        d = sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
        assert any(not d & m for m in masks)


def test_links_connect_all_pairs_within_radius(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base:
        x = b
        for _ in range(rng.randint(0, 6)):
            for bit in rng.sample(range(64), rng.randint(1, 6)):
                x ^= 1 << bit
            fps.add(x)
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    want = brute_components(fps, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 4)
    for block in (3, 1024):  # 3: hot buckets are dealt into blocks
        links = hamming_links(spark.createDataFrame([(x,) for x in fps], "fp long"), 4, block)
        roots = {r.node: r.root for r in connected_components(links).collect()}
        got = {}
        for i, x in enumerate(fps):
            got.setdefault(roots.get(x, x), []).append(i)
        groups = {}
        for i, l in enumerate(want):
            groups.setdefault(l, []).append(i)
        assert sorted(got.values()) == sorted(groups.values())


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 180)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(61)}) == 1
    assert len({got[i] for i in range(100, 180)}) == 1
    assert got[0] != got[100]
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents_with_nulls_blanks_copies(spark):
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(3000))
    rows = [(5, long, "x"), (2, long.replace("w1 ", "q "), None), (9, long.upper(), "x"), (3, None, "x"), (1, " \n", None),
            (4, "", "x"), (8, "one two", "x"), (8, "one two", "x"), (7, "three", None), (6, "a b c d e", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")  # fp clashes with a column of ours
    got = {(r.doc_id, r.component_id) for r in simhash_components(df).collect()}
    ids = [r[0] for r in rows]
    want = brute_components([brute_fp(r[1]) for r in rows], lambda a, b: (a ^ b).bit_count() <= 4)
    least = {l: min(i for i, m in zip(ids, want) if m == l) for l in want}
    assert got == {(i, least[l]) for i, l in zip(ids, want)}
    kept = near_dedup(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))
    assert simhash_components(df.limit(0)).count() == 0

"""Benchmark decontamination with suffix arrays over shards of the training documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filtra.llm.common import new_column, read, unused, words_alnum

WINDOW = 13
#: Bytes of test text that one pass over the documents searches for; more texts take more passes.
BLOCK_BYTES = 8 << 20
#: Words of training text that one suffix array holds (a longer document is a shard of its own).
SHARD_WORDS = 2_000_000


class TestBlock:
    """Test items as word numbers, with every suffix of an item that starts a window.

    word: word -> number from 1. tokens: all items, a 0 after each. start, size, row:
    the suffixes' starts in tokens, their windows' lengths, and their items.
    """

    __test__ = False

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        self.word: dict[bytes, int] = {}
        tokens: list[int] = []
        start, size, row = [], [], []
        self.items = [i if i is None else str(i) for i, _ in items]
        for r, (_, text) in enumerate(items):
            ids = [self.word.setdefault(w, len(self.word) + 1) for w in words_alnum((text or "").encode())]
            least = min(window, len(ids))
            for i in range(len(ids) - least + 1 if ids else 0):
                start.append(len(tokens) + i)
                size.append(least)
                row.append(r)
            tokens += [*ids, 0]
        self.tokens = np.array([*tokens, 0], dtype=np.int32)
        self.start, self.size, self.row = (np.array(x, dtype=np.int64) for x in (start, size, row))
        self.least = min(size, default=0)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        get = self.word.get
        return np.array([get(w, 0) for w in words], dtype=np.int32)


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of tokens in order, by prefix doubling; the end sorts before any token."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    order = np.argsort(rank, kind="stable")
    step = 1
    while n and step < n and rank[order[-1]] < n:
        later = np.zeros(n, np.int64)
        later[: n - step] = rank[step:]
        key = rank * (n + 2) + later
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank[order] = np.cumsum(np.concatenate(([1], (ordered[1:] != ordered[:-1]).astype(np.int64))))
        step *= 2
    return order


def search(tokens: np.ndarray, order: np.ndarray, block: TestBlock) -> tuple[np.ndarray, np.ndarray]:
    """For each test suffix: the interval of `order` whose suffixes start with its window (empty: lo = hi).

    The interval is narrowed word by word, each time by two binary searches within
    it, for all test suffixes at once.
    """
    m = len(block.start)
    lo, hi = np.zeros(m, np.int64), np.full(m, len(order), np.int64)
    padded = np.concatenate((tokens, np.zeros(1, tokens.dtype)))
    live = np.arange(m)
    depth = 0
    while len(live):
        want = block.tokens[block.start[live] + depth]
        ends = []
        for above in (False, True):
            a, b = lo[live], hi[live]
            while (between := a < b).any():
                mid = (a + b) >> 1
                at = padded[np.minimum(order[np.minimum(mid, len(order) - 1)] + depth, len(tokens))]
                right = ((at <= want) if above else (at < want)) & between
                a, b = np.where(right, mid + 1, a), np.where(between & ~right, mid, b)
            ends.append(a)
        lo[live], hi[live] = ends
        depth += 1
        live = live[(ends[0] < ends[1]) & (block.size[live] > depth)]
    return lo, hi


def extend(tokens: np.ndarray, at: np.ndarray, suffix: np.ndarray, block: TestBlock) -> np.ndarray:
    """How many words agree from tokens[at] and the test suffix on (their windows do)."""
    padded = np.concatenate((tokens, np.zeros(1, tokens.dtype)))
    length = block.size[suffix].copy()
    live = np.arange(len(at))
    while len(live):
        ours = padded[np.minimum(at[live] + length[live], len(tokens))]
        live = live[(ours > 0) & (ours == block.tokens[block.start[suffix[live]] + length[live]])]
        length[live] += 1
    return length


#: Occurrences that are looked at together, which bounds a task's memory on repetitive texts.
CHUNK = 1 << 21


def match_shard(docs: list[np.ndarray], block: TestBlock) -> list[dict]:
    """For each document of a shard (its words' numbers): spans of hit words, item rows, and the longest match.

    The longest match is (words, place, item row), the first of the longest. Only
    stretches of at least the shortest window's length whose words all occur in the
    block enter the suffix array: any other suffix agrees with no window. Windows of
    equal words count once, their occurrences are summed up in chunks, and only
    matches that cannot be extended to the left are followed to the right, so that
    texts of a few words over and over stay within bounds.
    """
    out: list[dict] = [{"spans": [], "rows": set(), "longest": (0, 0, -1)} for _ in docs]
    if not block.least or not docs:
        return out
    gap = np.zeros(1, np.int32)
    known = np.concatenate([x for d in docs for x in (d, gap)])
    edge = np.diff(np.concatenate(([0], (known > 0).astype(np.int8), [0])))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    keep = end - begin >= block.least
    begin, end = begin[keep], end[keep]
    if not len(begin):
        return out
    lengths = end - begin + 1  # a 0 follows each stretch
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths - begin, lengths)
    tokens = known[place]
    order = suffix_array(tokens)
    lo, hi = search(tokens, order, block)
    hit = np.flatnonzero(hi > lo)
    if not len(hit):
        return out
    first = np.cumsum([0, *(len(d) + 1 for d in docs)])
    owner = np.searchsorted(first, place, side="right") - 1

    windows, inverse = np.unique(np.stack((lo[hit], hi[hit], block.size[hit]), 1), axis=0, return_inverse=True)
    edges, pairs = np.zeros(len(tokens) + 1, np.int64), []
    for w, at in _chunks(order, windows[:, 0], windows[:, 1]):
        np.add.at(edges, at, 1)
        np.add.at(edges, at + windows[w, 2], -1)
        pairs.append(np.unique(owner[at] * len(windows) + w))
    covered = place[np.flatnonzero(np.cumsum(edges)[:-1] > 0)]
    cut = np.flatnonzero(np.diff(covered) != 1) + 1
    for a, b in zip(covered[np.concatenate(([0], cut))], covered[np.concatenate((cut - 1, [-1]))]):
        d = int(np.searchsorted(first, a, side="right")) - 1
        out[d]["spans"].append((int(a - first[d]), int(b - first[d]) + 1))
    rows_of = [np.unique(block.row[hit[inverse == w]]).tolist() for w in range(len(windows))]
    for d, w in zip(*np.divmod(np.unique(np.concatenate(pairs)), len(windows))):
        out[d]["rows"].update(rows_of[w])

    before = np.concatenate((gap, tokens))  # the word before each place
    test_before = np.concatenate((gap, block.tokens))
    for s, at in _chunks(order, lo[hit], hi[hit]):
        s = hit[s]
        mine, theirs = before[at], test_before[block.start[s]]
        whole = (mine != theirs) | (mine == 0)
        at, s = at[whole], s[whole]
        length = extend(tokens, at, s, block)
        rank = np.lexsort((block.row[s], at, -length, owner[at]))
        at, s, length = at[rank], s[rank], length[rank]
        for i in np.unique(owner[at], return_index=True)[1].tolist():
            d = int(owner[at[i]])
            found = (int(length[i]), int(place[at[i]] - first[d]), int(block.row[s[i]]))
            out[d]["longest"] = min(out[d]["longest"], found, key=lambda x: (-x[0], x[1], x[2]))
    return out


def _chunks(order: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the interval, place) of all places in the intervals of `order`, at most CHUNK together."""
    total = np.cumsum(hi - lo)
    for a in range(0, int(total[-1]) if len(total) else 0, CHUNK):
        n = np.arange(a, min(a + CHUNK, int(total[-1])))
        which = np.searchsorted(total, n, side="right")
        yield which, order[lo[which] + n - (total[which] - (hi - lo)[which])]


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


FOUND = (
    "struct<n_words:bigint,spans:array<struct<start:bigint,stop:bigint>>,items:array<string>,"
    "longest:bigint,longest_at:bigint,longest_item:string>"
)
_SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
_FOUND = pa.struct([
    ("n_words", pa.int64()), ("spans", pa.list_(_SPAN)), ("items", pa.list_(pa.string())),
    ("longest", pa.int64()), ("longest_at", pa.int64()), ("longest_item", pa.string()),
])


def _add(was: dict | None, n_words: int, found: dict, block: TestBlock) -> dict:
    """What earlier blocks found in a document, and what this one finds."""
    was = was or {"spans": [], "items": [], "longest": 0, "longest_at": None, "longest_item": None}
    length, at, row = found["longest"]
    best = (was["longest"], was["longest_at"], was["longest_item"])
    if length and (-length, at) < (-best[0], best[1] or 0):
        best = (length, at, block.items[row])
    spans = [(s["start"], s["stop"]) for s in was["spans"]] + found["spans"]
    return {
        "n_words": n_words,
        "spans": [{"start": a, "stop": b} for a, b in _merge(spans)],
        "items": sorted({*was["items"], *(block.items[r] for r in found["rows"])} - {None}),
        "longest": best[0],
        "longest_at": best[1],
        "longest_item": best[2],
    }


def _pass(docs: DataFrame, text_col: str, block: TestBlock, found: str) -> DataFrame:
    """Add what one block finds to the column `found` of docs; all other columns stay."""
    shipped = docs.sparkSession.sparkContext.broadcast(block)
    text_at, found_at = docs.columns.index(text_col), docs.columns.index(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shipped.value
        for batch in batches:
            texts = batch.column(text_at).cast(pa.large_binary())
            hits: list[dict] = []
            sizes: list[int] = []
            shard, size = [], 0
            for text in texts:
                shard.append(block.numbers(words_alnum(text.as_py())))
                sizes.append(len(shard[-1]))
                size += sizes[-1]
                if size >= SHARD_WORDS or len(sizes) == len(texts):
                    hits += match_shard(shard, block)
                    shard, size = [], 0
            before = batch.column(found_at).to_pylist()
            after = [_add(*x, block) for x in zip(before, sizes, hits)]
            yield batch.set_column(found_at, batch.schema.field(found_at).name, pa.array(after, _FOUND))

    return docs.mapInArrow(run, docs.schema)


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> Iterator[TestBlock]:
    """The test items in blocks of bounded size, read part by part (one at least, even if empty)."""
    items, size, any_ = [], 0, False
    for row in benchmark.select(F.col(id_col).cast("string"), F.col(text_col)).toLocalIterator():
        items.append((row[0], row[1]))
        size += len(row[1] or "")
        if size >= block_bytes:
            yield TestBlock(items, window)
            items, size, any_ = [], 0, True
    if items or not any_:
        yield TestBlock(items, window)


def find_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    found: str = "found",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """docs with a column `found`: words, merged hit stretches (word offsets), the ids of matching items, and
    the longest verbatim match with its place and item (the first of the longest).

    Windows are `window` consecutive words of an item, or the whole of a shorter one.
    No shuffle: each Arrow batch of documents is a run of shards, and the test items
    are searched for in blocks, one pass over the documents a block. Null and empty
    texts have no words and no hits; items without words match nothing, and items
    without an id count for the hit words but are no item in the list; repeated rows
    get the same result each. Other columns stay as they are; one called as `found`
    raises a ValueError. Empty tables give empty ones, an empty benchmark no hits.
    """
    out = docs.withColumn(new_column(docs, found), F.lit(None).cast(FOUND))
    for block in benchmark_blocks(benchmark, item_col, item_text_col, window, block_bytes):
        out = _pass(out, text_col, block, found)
    return out


def hit_words(found: str = "found"):
    return F.aggregate(
        F.col(f"{found}.spans"), F.lit(0).cast("long"), lambda total, s: total + s["stop"] - s["start"]
    )


def contaminated(found: str = "found"):
    """At least one hit word in twenty."""
    hits = hit_words(found)
    return (hits > 0) & (20 * hits >= F.col(f"{found}.n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without those that hold WINDOW words of a test item in a row, columns as they are.

    So many words are verbatim test text however long the document around them is.
    Shorter items are common phrases as well: their matches count if they make up
    a twentieth of the document. Rows without a text stay.
    """
    found = unused("found", docs)
    out = find_matches(docs, benchmark, text_col, found=found)
    return out.where(~(contaminated(found) | (F.col(f"{found}.longest") >= WINDOW))).drop(found)


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = find_matches(docs, read(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        hit_words().alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.array_distinct("found.items")), ",").cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
        F.col("found.longest").alias("longest_match"),
        F.col("found.longest_at").alias("longest_at"),
    )

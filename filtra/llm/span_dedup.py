"""Substring dedup: repeated runs of consecutive sentences, joined over the whole corpus."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filtra.llm.common import columns_of, new_column, read, release, settle, unused, words_alnum

#: A run has as many consecutive sentences as it takes to reach this many words.
RUN_WORDS = 20
_STOP = re.compile(rb"[.!?](?=\s|\Z)|\n|\Z")
_LEAD = re.compile(rb"\s*")
_SEED = 42
#: A place is one long: the first sentence, and in the low bits the number of sentences less one.
_LENGTH_BITS = 5
_NO_ID = (1 << 63) - 1


def sentences(text: bytes | None) -> list[tuple[int, int, bytes, int]]:
    """(start, stop, normalised words, number of words) of the sentences that have a word.

    A sentence ends at a line end, or at . ! ? before white space. Byte offsets.
    """
    text = text or b""
    out, start = [], 0
    for m in _STOP.finditer(text):
        start = _LEAD.match(text, start).end()
        stop = m.start() + (m[0] not in (b"\n", b""))
        if stop > start:
            words = words_alnum(text[start:stop])
            if words:
                out.append((start, stop, b" ".join(words), len(words)))
            start = stop
    return out


def runs(sizes: list[int], least: int = RUN_WORDS) -> list[tuple[int, int]]:
    """(first, past-last) of the shortest run of at least `least` words from each sentence on, and up to each."""
    total = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    n = len(sizes)
    onward = np.searchsorted(total, total[:-1] + least, side="left")
    back = np.searchsorted(total, total[1:] - least, side="right") - 1
    found = {(i, j) for i, j in enumerate(onward.tolist()) if j <= n}
    found.update((i, j + 1) for j, i in enumerate(back.tolist()) if i >= 0)
    return sorted(found)


def span_hashes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(hash, doc, key, place) of every run of every text; key is a hash of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            hashes, owners, keys, places = [], [], [], []
            for doc, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary())):
                found = sentences(text.as_py())
                part = [s[2] for s in found]
                spans = runs([s[3] for s in found])
                hashes += [digest(b" ".join(part[i:j]), _SEED) for i, j in spans]
                places += [i << _LENGTH_BITS | j - i - 1 for i, j in spans]
                owners += [doc] * len(spans)
                keys += [key] * len(spans)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(hashes, np.uint64).view(np.int64)), *(pa.array(x, pa.int64()) for x in (owners, keys, places))],
                names=["hash", "doc", "key", "place"],
            )

    cols = [F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)), F.xxhash64(text_col), F.col(text_col)]
    return docs.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).mapInArrow(run, "hash long, doc long, key long, place long")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, key, places, first_docs): a text's occurrences of repeated runs but the first, by id, text hash and place.

    The first occurrence is a partial aggregate, and the join's other side has one
    row a hash, so that a run which stands in a third of all documents is split
    among tasks. No pairs of occurrences are made.
    """
    spans = settle(span_hashes(docs, id_col, text_col))
    rank = F.struct("doc", "key", "place")
    first = spans.groupBy("hash").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # a table of its own, so that the join may split the rows of a very common run
    first = settle(first.select("hash", F.col("first.doc").alias("d"), F.col("first.key").alias("k"), F.col("first.place").alias("p")))
    again = spans.join(first.hint("merge"), "hash").where("doc <> d OR key <> k OR place <> p")
    covered = again.groupBy("doc", "key").agg(F.collect_set("place").alias("places"), F.collect_set("d").alias("first_docs"))
    covered = settle(covered)
    release(spans, first)
    return covered


def remove_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "dedup") -> DataFrame:
    """docs with a column `out`: cleaned text, sentences, removed sentences and words, and where they stand first.

    Sentences covered by a non-first occurrence of a repeated run go, with the blanks
    before them, and with their line end if they are the whole line; all other
    characters stay. First is the smallest (id, place);
    rows that repeat both id and text are one document; rows without an id come last.
    Null stays null; texts of fewer than RUN_WORDS words have no run; ids are cast to
    long (others than numbers raise). Other columns stay as they are whatever their
    names; one called as `out` raises a ValueError. An empty table gives an empty one.
    """
    new_column(docs, out)
    covered = repeated_spans(docs, id_col, text_col)
    row = F.struct("*").alias("row")
    wide = docs.select(row, F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("d"), F.xxhash64(text_col).alias("k"))
    wide = wide.join(covered.hint("merge"), (F.col("d") == F.col("doc")) & (F.col("k") == F.col("key")), "left")
    kind = "struct<text:string,n_sentences:bigint,n_removed:bigint,n_removed_words:bigint,first_docs:array<bigint>>"
    names = docs.columns
    wide = wide.select("row.*", F.col("places").alias(unused("places", docs)), F.col("first_docs").alias(unused("first_docs", docs)))
    text_at, width = names.index(text_col), len(names)
    schema = docs.select(*columns_of(docs), F.lit(None).cast(kind).alias(out)).schema
    struct = pa.struct([
        ("text", pa.string()), ("n_sentences", pa.int64()), ("n_removed", pa.int64()),
        ("n_removed_words", pa.int64()), ("first_docs", pa.list_(pa.int64())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, places, first in zip(batch.column(text_at).cast(pa.large_binary()), batch.column(width), batch.column(width + 1)):
                rows.append(_clean(text.as_py(), places.as_py(), first.as_py()))
            cols = [batch.column(i) for i in range(width)] + [pa.array(rows, struct)]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, out])

    return wide.mapInArrow(run, schema)


def _clean(text: bytes | None, places: list[int] | None, first: list[int] | None) -> dict:
    if text is None:
        return {"text": None, "n_sentences": 0, "n_removed": 0, "n_removed_words": 0, "first_docs": []}
    found = sentences(text)
    gone = set()
    for p in places or ():
        start = p >> _LENGTH_BITS
        gone.update(range(start, start + (p & ((1 << _LENGTH_BITS) - 1)) + 1))
    left, at = b"", 0
    for i in sorted(gone):
        start, stop = found[i][:2]
        left += text[at:start].rstrip(b" \t")  # line ends stay: they end sentences
        whole = (not left or left.endswith(b"\n")) and text[stop : stop + 1] == b"\n"
        at = stop + whole
    left += text[at:]
    return {
        "text": (left if gone else text).decode("utf-8", "replace"),
        "n_sentences": len(found),
        "n_removed": len(gone),
        "n_removed_words": sum(found[i][3] for i in gone),
        "first_docs": sorted(first or ()),
    }


def op3_spans(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_spans(docs).select("doc_id", "dedup.*")

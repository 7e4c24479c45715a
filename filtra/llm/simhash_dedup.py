"""SimHash near-duplicates found with covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filtra.llm.common import binary_column, map_batches, release, settle, unused, words_space
from filtra.llm.components import connected_components

BITS = 64
SEED = 42


def simhash(text: bytes | None, shingle: int = 4) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles, repeats included; no words: zero."""
    words = words_space(text)
    if not words:
        return 0
    hash64 = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return hash64(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = [0, *accumulate(len(w) + 1 for w in words)]
    hashes = np.array([hash64(line[i : j - 1], SEED) for i, j in zip(ends, ends[shingle:])], dtype="<u8")
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 14):  # bounded memory on very long texts
        part = hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, key, fp): each row's text hash, and its SimHash as a signed long. Null and blank texts get 0."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([simhash(t, shingle) for t in binary_column(batch, "text")], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "key", "fp"])

    cols = [F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text")]
    return map_batches(docs, cols, run, "doc_id long, key long, fp long")


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """2^(radius+1) - 1 bit masks such that any set of at most radius bits misses one of them.

    Bit i gets the non-zero vector i mod (2^(radius+1)-1) + 1 over GF(2), and mask v
    holds the bits whose vector has an odd product with v. Radius bits span fewer
    than radius+1 dimensions, so some v is orthogonal to all of them: that mask
    holds none of them, and two fingerprints that differ in them agree under it.
    """
    tables = (1 << (radius + 1)) - 1
    vector = [i % tables + 1 for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() & 1) for v in range(1, tables + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(members: list[int], radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the graph 'at most radius differing bits' over one bounded block."""
    n = len(members)
    if n < 2:
        return []
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    values = np.array(members, dtype=np.int64) if n > 24 else None
    for i in range(n - 1):
        if values is None:
            near = [j for j in range(i + 1, n) if ((members[i] ^ members[j]) & (2**64 - 1)).bit_count() <= radius]
        else:
            near = np.flatnonzero(np.bitwise_count((values[i + 1 :] ^ values[i]).view(np.uint64)) <= radius) + i + 1
        for j in near:
            p, q = find(i), find(int(j))
            if p != q:
                root[q] = p
                out.append((members[i], members[int(j)]))
    return out


def hamming_links(fps: DataFrame, radius: int = 4, block: int = 1024) -> DataFrame:
    """(a, b): links that connect the same fingerprints as all pairs within radius do.

    fps has one row a distinct fp. Every fingerprint goes to one bucket a mask;
    buckets of one are dropped after a partial count. A bucket above block rows is
    dealt by hash into blocks and every pair of blocks is compared by a task of its
    own, so no task holds more than about two blocks and no link is lost. Each
    comparison returns a spanning forest, never its pairs.
    """
    masks = covering_masks(radius)
    keys = F.array(*[
        F.struct(F.lit(t).cast("short").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k"))
        for t, m in enumerate(masks)
    ])
    rows = fps.select("fp", F.explode(keys).alias("x")).select("x.t", "x.k", "fp")
    full = rows.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = rows.join(full.hint("merge"), ["t", "k"])
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select(
        "t", "k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp"
    )
    group = ["t", "k", "i", "j"]
    rows = rows.repartition(*[F.col(c) for c in group]).sortWithinPartitions(*group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, members = None, []
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(5)]
            out = []
            for *key, fp in zip(*cols):
                if key != last:
                    out += _forest(members, radius)
                    last, members = key, []
                members.append(fp)
            yield _links(out)
        yield _links(_forest(members, radius))

    return rows.mapInArrow(run, "a long, b long")


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, shingle: int = 4
) -> DataFrame:
    """(doc_id, key, fp, component_id, component_key) a row of docs.

    component_id is the smallest id reachable, component_key the smallest text hash
    that stands with it. Nulls and blank texts have fingerprint zero and link like any
    other. Equal fingerprints count once in the search, so copies cost nothing; a null
    id is larger than any other and keeps its row; ids are cast to long (others than
    numbers raise). Repeated rows and extra columns of any name change nothing; an
    empty table gives an empty one.
    """
    marked = settle(fingerprints(docs, id_col, text_col, shingle))
    known = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "key"))
    fps = settle(marked.groupBy("fp").agg(F.min(known).alias("first")))
    links = settle(hamming_links(fps.select("fp"), radius))
    roots = connected_components(links)
    placed = fps.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left")
    placed = placed.withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("first").alias("first"))
    member = settle(placed.drop("first").join(least.hint("merge"), "root").select("fp", "first"))
    release(fps, links, roots)
    return marked.join(member.hint("merge"), "fp").select(
        "doc_id", "key", "fp", F.col("first.doc_id").alias("component_id"), F.col("first.key").alias("component_key")
    )


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """One row of docs for each component, that of the smallest id (and text hash): one document a group stays.

    Of repeated rows with that id and text one stays; rows without an id all stay.
    The texts move once, to be joined with the ids that stay.
    """
    placed = settle(simhash_components(docs, id_col, text_col, radius))
    first = (F.col("doc_id") == F.col("component_id")) & (F.col("key") == F.col("component_key"))
    stay = settle(placed.where(first).groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n")))
    release(placed)
    own, key, again = (unused(c, docs) for c in ("stay_id", "stay_key", "stay_n"))
    stay = stay.select(F.col("doc_id").alias(own), F.col("key").alias(key), F.col("n").alias(again))
    same = (F.col(id_col).cast("long") == F.col(own)) & (F.xxhash64(text_col) == F.col(key))

    def those(rows: DataFrame) -> DataFrame:
        return docs.where(F.col(id_col).isNotNull()).join(rows.hint("merge"), same, "left_semi")

    without = docs.where(F.col(id_col).isNull())
    if stay.where(F.col(again) > 1).isEmpty():
        return docs.join(stay.hint("merge"), same, "left").where(F.col(own).isNotNull() | F.col(id_col).isNull()).drop(own, key, again)
    twice = those(stay.where(F.col(again) > 1)).dropDuplicates([id_col, text_col])
    return without.unionByName(those(stay.where(F.col(again) == 1))).unionByName(twice)


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    from filtra.llm.common import read

    out = simhash_components(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""Document quality by a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filtra.llm.common import columns_of, held_out, new_column, read, words_space

#: Labelled rows that the machine is fitted on, at most (in expectation), and bytes of inputs that the driver holds for it.
SAMPLE_ROWS, SAMPLE_BYTES = 12_000, 256 << 20
#: Hashed words, bins a structure statistic, factors an input.
WORD_BITS, BINS, FACTORS = 16, 12, 8
_N_WORDS = 1 << WORD_BITS
_SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOL = bytes(c for c in range(256) if c not in _SYMBOLS)
_NOT_UPPER = bytes(c for c in range(256) if not 0x41 <= c <= 0x5A)
_NOT_LOWER = bytes(c for c in range(256) if not 0x61 <= c <= 0x7A)
_NOT_DIGIT = bytes(c for c in range(256) if not 0x30 <= c <= 0x39)
_NOT_BANG = bytes(c for c in range(256) if c not in b"!?")
_NOT_STOP = bytes(c for c in range(256) if c not in b".!?")


def _log_bin(x: float) -> int:
    return min(BINS - 1, int(math.log2(1 + x)))


def _share_bin(part: float, whole: float) -> int:
    """0 for none, then by powers of two below one."""
    return 0 if part <= 0 or whole <= 0 else max(1, min(BINS - 1, BINS - 1 + int(math.floor(math.log2(part / whole)))))


def structure(text: bytes, words: list[bytes], count: Counter, n_chars: int | None) -> list[int]:
    """The bin of each structure statistic and of the metadata column n_chars."""
    size, n = len(text), len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    upper, lower = len(text.translate(None, _NOT_UPPER)), len(text.translate(None, _NOT_LOWER))
    twice = sum(a == b for a, b in zip(words, words[1:]))
    pairs = len(set(zip(words, words[1:], words[2:])))
    return [
        _log_bin(n),
        _log_bin(4 * size / max(n, 1)),
        _log_bin(len(lines)),
        _log_bin(n / max(len(lines), 1)),
        _log_bin(8 * n / max(len(text.translate(None, _NOT_STOP)), 1)),
        _share_bin(len(text.translate(None, _NOT_SYMBOL)), size),
        _share_bin(upper, upper + lower),
        _share_bin(len(text.translate(None, _NOT_DIGIT)), size),
        _share_bin(len(text.translate(None, _NOT_BANG)), size),
        _share_bin(n - len(count), n),
        _share_bin(twice, n),
        _share_bin(max(n - 2, 0) - pairs, n),
        _share_bin(len(lines) - len(set(lines)), len(lines)),
        _share_bin(max(count.values(), default=0), n),
        0 if n_chars is None else 1 + min(BINS - 2, int(math.log2(1 + max(n_chars, 0)) / 2)),
    ]


N_STATS = 15
SIZE = _N_WORDS + N_STATS * BINS


def inputs(text: bytes | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and values of a document's non-zero inputs: unit-length hashed words and one bin a statistic.

    Words count by the logarithm of their number over the whole text.
    """
    text = text or b""
    words = words_space(text)
    count = Counter(words)
    bins = structure(text, words, count, n_chars)
    at = np.empty(len(count) + N_STATS, np.int64)
    value = np.empty(len(at), np.float32)
    at[: len(count)] = [crc32(w) & (_N_WORDS - 1) for w in count]
    value[: len(count)] = np.log1p(np.fromiter(count.values(), np.float32, len(count)))
    value[: len(count)] /= max(float(np.sqrt((value[: len(count)] ** 2).sum())), 1e-9)
    at[len(count) :] = _N_WORDS + np.arange(N_STATS) * BINS + bins
    value[len(count) :] = 1.0
    return at, value


@dataclass
class FactorMachine:
    """Bias, weights, and FACTORS latent coordinates an input."""

    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def raw(self, at: np.ndarray, value: np.ndarray) -> float:
        """Bias + weights + all pairwise products, by the sum-of-squares identity in linear time."""
        z = self.factor[at] * value[:, None]
        total = z.sum(axis=0)
        return float(self.bias + self.weight[at] @ value + 0.5 * (total @ total - (z * z).sum()))

    def score(self, at: np.ndarray, value: np.ndarray) -> float:
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, self.raw(at, value)))))


def train_machine(
    rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, epochs: int = 8, batch: int = 256,
    rate: float = 0.08, ridge: float = 1e-4, seed: int = 7,
) -> FactorMachine:
    """Logistic loss, Adagrad on mini-batches; the same rows in the same order give the same machine."""
    rng = np.random.default_rng(seed)
    weight = np.zeros(SIZE, np.float32)
    factor = rng.normal(0, 0.02, (SIZE, FACTORS)).astype(np.float32)
    prior = float(np.clip(label.mean() if len(label) else 0.5, 0.02, 0.98))
    bias, bias_g = math.log(prior / (1 - prior)), 1e-2
    weight_g, factor_g = np.full(SIZE, 1e-2, np.float32), np.full((SIZE, FACTORS), 1e-2, np.float32)
    for _ in range(epochs if len(rows) else 0):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), batch):
            part = order[i : i + batch]
            at = np.concatenate([rows[j][0] for j in part])
            value = np.concatenate([rows[j][1] for j in part])
            sizes = np.array([len(rows[j][0]) for j in part])
            start, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(part)), sizes)
            z = factor[at] * value[:, None]
            total = np.add.reduceat(z, start)
            raw = bias + np.add.reduceat(weight[at] * value, start)
            raw += 0.5 * ((total**2).sum(1) - np.add.reduceat((z * z).sum(1), start))
            off = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label[part]).astype(np.float32) / len(part)
            used, inverse = np.unique(at, return_inverse=True)
            g_w = np.bincount(inverse, off[owner] * value, len(used)).astype(np.float32) + ridge * weight[used]
            pull = off[owner][:, None] * value[:, None] * (total[owner] - z)
            g_f = np.stack([np.bincount(inverse, pull[:, f], len(used)) for f in range(FACTORS)], 1).astype(np.float32) + ridge * factor[used]
            weight_g[used] += g_w**2
            factor_g[used] += g_f**2
            weight[used] -= rate * g_w / np.sqrt(weight_g[used])
            factor[used] -= rate * g_f / np.sqrt(factor_g[used])
            g_b = float(off.sum())
            bias_g += g_b**2
            bias -= rate * g_b / math.sqrt(bias_g)
    return FactorMachine(bias, weight, factor)


def fit(
    docs: DataFrame, labels: DataFrame, train: Column, rows: int = SAMPLE_ROWS, id_col: str = "doc_id",
    text_col: str = "text", chars_col: str = "n_chars", most_bytes: int = SAMPLE_BYTES,
) -> FactorMachine:
    """Fit on at most about `rows` labelled documents for whose _id `train` holds, chosen by a hash of the id.

    Fewer are taken if their inputs could exceed most_bytes: a word of at least one
    letter and its blank takes eight bytes, so a text takes four times its length at most.

    Of several labels of an id the smallest counts. Without labelled rows the machine
    gives one half to every document.
    """
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), F.col(chars_col).cast("long").alias("n_chars"))
    few = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("label")).where("_id IS NOT NULL AND label IN (0, 1)")
    few = few.where(train).groupBy("_id").agg(F.min("label").alias("label"))
    share = min(1.0, rows / max(1, few.count()))
    part = F.pmod(F.xxhash64("_id", F.lit("quality")), F.lit(1 << 20))
    picked = docs.join(F.broadcast(few.where(part < int(share * (1 << 20)))), "_id")  # bounded by `rows`
    held = 4 * (picked.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0)
    if held > most_bytes:
        picked = picked.where(part < int(share * most_bytes / held * (1 << 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [inputs(t.as_py(), n) for t, n in zip(batch.column(1).cast(pa.large_binary()), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([a.astype("<i4").tobytes() for a, _ in found]), pa.array([v.astype("<f4").tobytes() for _, v in found]), batch.column(3)],
                names=["id", "at", "value", "label"],
            )

    table = picked.select("_id", "text", "n_chars", "label")
    table = table.mapInArrow(run, "id long, at binary, value binary, label int").toArrow()
    got = sorted(zip(*(table.column(c).to_pylist() for c in ("id", "at", "value", "label"))))
    data = [(np.frombuffer(a, "<i4").astype(np.int64), np.frombuffer(v, "<f4")) for _, a, v, _ in got]
    return train_machine(data, np.array([x[3] for x in got], dtype=np.float32))


def score_quality(docs: DataFrame, machine: FactorMachine, text_col: str = "text", chars_col: str = "n_chars", out: str = "quality") -> DataFrame:
    """docs with a double column `out`, the probability that the label is 1. No shuffle.

    Null and empty texts have no words but have structure bins and a score; a null
    n_chars has a bin of its own. Other columns stay as they are; one called as `out`
    raises a ValueError.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(machine)  # a fixed number of weights
    wide = docs.select(*columns_of(docs), F.lit(None).cast("double").alias(new_column(docs, out)))
    at, text_at, chars_at = len(docs.columns), docs.columns.index(text_col), docs.columns.index(chars_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shipped.value
        for batch in batches:
            texts, chars = batch.column(text_at).cast(pa.large_binary()), batch.column(chars_at).to_pylist()
            scores = [machine.score(*inputs(t.as_py(), n)) for t, n in zip(texts, chars)]
            yield batch.set_column(at, batch.schema.field(at).name, pa.array(scores, pa.float64()))

    return wide.mapInArrow(run, wide.schema)


#: Documents whose probability of label 1 is lower are rejected.
THRESHOLD = 0.3


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    machine = fit(docs, read(spark, sf_dir, "labels"), ~held_out("_id", 5, 0))
    out = score_quality(docs, machine)
    return out.select(
        "doc_id",
        held_out("doc_id", 5, 0).alias("held_out"),
        F.col("quality").alias("score"),
        (F.col("quality") >= THRESHOLD).cast("int").alias("predicted"),
    )

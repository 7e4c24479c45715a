"""Toxic passages as maximum-scoring segments of token log-odds, calibrated by extreme-value statistics."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filtra.llm.common import columns_of, held_out, new_column, read, words_alnum

#: Labelled rows that the weights and the calibration are fitted on, at most (in expectation).
SAMPLE_ROWS = 20_000
#: The Dirichlet prior's size as a share of the sample's words, least toxic sample documents of a toxic word, least z.
PRIOR_SHARE, LEAST_DOCS, LEAST_Z = 0.05, 3, 3.5
#: Least places in the sample of a word that counts as clean, and the beginnings a word has, in bytes, cut between characters.
LEAST_CLEAN, STEMS = 20, range(4, 10)
#: What every word takes from a segment beside its log-odds, so that chance segments stay short.
DRIFT = 0.5
#: Expected number of chance segments below which a passage is significant.
LEAST_E = 0.05


def segments(scores: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first word, past-last word), after Ruzzo and Tompa, in linear time.

    scores: (place, weight) of the words that have a weight, in order; each other
    word scores -drift. A run of such words enters as one negative stretch.
    """
    out: list[list[float]] = []  # left sum, right sum, start, stop, the last piece before with a smaller left sum
    total, last = 0.0, 0
    for place, weight in scores:
        total -= drift * (place - last)
        last = place + 1
        left, total = total, total + weight
        if weight <= 0:
            continue
        piece = [left, total, place, place + 1, -1]
        j = len(out) - 1
        while True:
            while j >= 0 and out[j][0] >= piece[0]:
                j = out[j][4]  # all between have larger left sums still
            if j < 0 or out[j][1] >= piece[1]:
                piece[4] = j
                out.append(piece)
                break
            piece = [out[j][0], piece[1], out[j][2], piece[3], -1]
            j, gone = out[j][4], j
            del out[gone:]
    return [(r - l, int(a), int(b)) for l, r, a, b, _ in out]


def stems(word: bytes) -> list[bytes]:
    """The word's beginnings, with a * behind, that end between two characters."""
    return [word[:k] + b"*" for k in STEMS if k < len(word) and word[k] & 0xC0 != 0x80]


@dataclass
class ToxicityModel:
    """Word weights, Karlin-Altschul constants, and the logistic curve over the calibrated features."""

    weight: dict[bytes, float] = field(default_factory=dict)  # of words, and of stems with a * behind
    heads: frozenset[bytes] = frozenset()  # first bytes of the stems
    lam: float = 1.0
    k: float = 0.1
    curve: tuple[float, float, float] = (-3.0, 1.0, 1.0)

    def excess(self, score: float, n_words: int) -> float:
        """-ln of the number of segments at least as good that chance would give."""
        return self.lam * score - math.log(max(self.k * n_words, 1e-9))

    def hits(self, words: list[bytes]) -> list[tuple[int, float]]:
        """(place, weight) of the words that have one: by the whole word, else by its longest stem."""
        get, heads, short = self.weight.get, self.heads, STEMS[0]
        out = []
        for i, w in enumerate(words):
            s = get(w)
            if s is None and w[:short] in heads:
                s = next((x for t in reversed(stems(w)) if (x := get(t)) is not None), None)
            if s is not None:
                out.append((i, s))
        return out

    def passages(self, words: list[bytes]) -> list[tuple[float, int, int]]:
        return [x for x in segments(self.hits(words)) if self.excess(x[0], len(words)) >= -math.log(LEAST_E)]

    def features(self, words: list[bytes]) -> tuple[float, float, list[tuple[float, int, int]]]:
        found = self.passages(words)
        best = max((self.excess(s, len(words)) for s, _, _ in found), default=0.0)
        return math.log1p(best), math.log1p(len(found)), found

    def score(self, words: list[bytes]) -> tuple[float, list[tuple[float, int, int]]]:
        a, b, found = self.features(words)
        x = self.curve[0] + self.curve[1] * a + self.curve[2] * b
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, x)))), found


def log_odds(toxic: float, clean: float, n_toxic: float, n_clean: float, share: float) -> tuple[float, float]:
    """Log-odds ratio of a word of this share of the corpus, with an informative Dirichlet prior, and its z."""
    size = PRIOR_SHARE * (n_toxic + n_clean)
    t, c = toxic + max(size * share, 1e-3), clean + max(size * share, 1e-3)
    d = math.log(t / max(n_toxic + size - t, 1e-9)) - math.log(c / max(n_clean + size - c, 1e-9))
    return d, d / math.sqrt(1 / t + 1 / c)


def karlin_lambda(weights: np.ndarray, shares: np.ndarray, drift: float = DRIFT) -> float:
    """The positive root of E[exp(lambda * score)] = 1 over the background words."""
    rest = max(0.0, 1.0 - shares.sum())
    value = lambda x: (shares * np.exp(x * weights)).sum() + rest * math.exp(-x * drift) - 1.0
    if not len(weights) or (shares * weights).sum() - rest * drift >= 0:
        return 0.1
    low, high = 1e-6, 1.0
    while value(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return low


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Ridge logistic regression by Newton steps; x holds a column of ones first."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, train: Column, rows: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(text, label, part): labelled training rows, chosen by a hash of the id so that at most `rows` are expected.

    One label an id (the largest of several); part 0 or 1 is a second hash bit.
    """
    few = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label")).where("_id IS NOT NULL AND label IN (0, 1)")
    few = few.where(train).groupBy("_id").agg(F.max("label").alias("label"))
    share = min(1.0, rows / max(1, few.count()))
    few = few.where(F.pmod(F.xxhash64("_id", F.lit(label)), F.lit(1 << 20)) < int(share * (1 << 20)))
    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(few), "_id")  # bounded by `rows`
    return picked.select("text", "label", F.pmod(F.xxhash64("_id", F.lit("part")), F.lit(2)).cast("int").alias("part"))


def pieces(words: list[bytes], vocabulary: set[bytes] | None, heads: frozenset[bytes] | None) -> Counter:
    """How often each word and each stem of a word stands in a text; only those of the vocabulary if there is one.

    heads: the first bytes of the vocabulary's stems.
    """
    out: Counter[bytes] = Counter()
    for w, c in Counter(words).items():
        for piece in (w, *(stems(w) if heads is None or w[: STEMS[0]] in heads else ())):
            if vocabulary is None or piece in vocabulary:
                out[piece] += c
    return out


def _counts(texts: DataFrame, vocabulary: set[bytes] | None, by_label: bool) -> DataFrame:
    """(word, kind, n, docs): words by label (or kind 0), a row a batch and word before the sum; word null: all."""

    heads = None if vocabulary is None else frozenset(w[: STEMS[0]] for w in vocabulary if w.endswith(b"*"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, docs = Counter(), Counter()
            kinds = batch.column(1).to_pylist() if by_label else [0] * batch.num_rows
            for text, kind in zip(batch.column(0).cast(pa.large_binary()), kinds):
                words = words_alnum(text.as_py())
                n[None, kind] += len(words)
                for w, c in pieces(words, vocabulary, heads).items():
                    n[w, kind] += c
                    docs[w, kind] += 1
            word = [w for w, _ in n]
            yield pa.RecordBatch.from_arrays(
                [pa.array(word, pa.binary()), pa.array([k for _, k in n], pa.int32()), pa.array(n.values(), pa.int64()), pa.array([docs[x] for x in n], pa.int64())],
                names=["word", "kind", "n", "docs"],
            )

    rows = texts.mapInArrow(run, "word binary, kind int, n long, docs long")
    return rows.groupBy("word", "kind").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def fit(
    docs: DataFrame, labels: DataFrame, train: Column, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> ToxicityModel:
    """Learn from the labelled rows where `train` (on _id) holds; word frequencies come from all documents.

    Half of the sample gives the words' counts by label; the words (and stems) that are
    toxic beyond chance, and the words that stand often enough to be known as clean,
    are then counted in the whole corpus, which is the prior of their log-odds and the
    background of lambda. A toxic word scores its log-odds, a clean one its log-odds
    less DRIFT, and a word of which nothing is known -DRIFT. The other half calibrates: clean documents
    give K, and a logistic curve over the two features gives the probability.
    """
    sample = labelled_sample(docs, labels, "toxic", train, rows, id_col, text_col)
    table = _counts(sample.where("part = 0").select("text", "label"), None, True).groupBy("word").agg(
        *[F.sum(F.when(F.col("kind") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}") for k in (0, 1) for c in ("n", "docs")]
    )
    # a word in so few toxic documents is not toxic; the rest is bounded by the sample's size
    some = f"word IS NULL OR docs1 >= {LEAST_DOCS} AND docs1 > docs0 OR n0 + n1 >= {LEAST_CLEAN} AND substring(word, -1) <> X'2A'"
    found = [tuple(r) for r in table.where(some).select("word", "n0", "n1", "docs0", "docs1").collect()]
    n_clean, n_toxic = next(((c, t) for w, c, t, *_ in found if w is None), (0, 0))
    model = ToxicityModel()
    found = [(bytes(w), *x) for w, *x in found if w is not None]
    toxic = [x[:3] for x in found if x[4] >= LEAST_DOCS and x[4] > x[3] and x[2] * n_clean > 2 * x[1] * n_toxic]
    clean = [x[:3] for x in found if x[1] + x[2] >= LEAST_CLEAN and not x[0].endswith(b"*")]
    seen = {r["word"] and bytes(r["word"]): r["n"] for r in _counts(docs.select(text_col), {x[0] for x in (*toxic, *clean)}, False).collect()}
    total = max(1, seen.pop(None, 1))
    counts = {w: (c, t) for w, c, t in toxic}
    same = {s for w, x in counts.items() for k in STEMS if counts.get(s := w[:k] + b"*") == x and s != w}
    toxic = [x for x in toxic if x[0] not in same]  # of pieces that stand for the same words the longest counts
    for w, c, t in sorted(toxic, key=lambda x: (len(x[0]), x[0])):  # stems before what begins with them
        d, z = log_odds(t, c, n_toxic, n_clean, seen.get(w, 0) / total)
        below = [model.weight.get(w[:k] + b"*", -math.inf) for k in STEMS if k < len(w.rstrip(b"*"))]
        if z >= LEAST_Z and d > max(DRIFT, *(x + 0.5 for x in below), DRIFT):
            model.weight[w] = d
    toxic_stems = {w for w in model.weight if w.endswith(b"*")}
    for w, c, t in clean:
        if w not in model.weight and not any(x in toxic_stems for x in stems(w)):
            model.weight[w] = min(0.0, log_odds(t, c, n_toxic, n_clean, seen.get(w, 0) / total)[0]) - DRIFT
    model.heads = frozenset(w[: STEMS[0]] for w in model.weight if w.endswith(b"*"))
    # a word counts in the background for each of its pieces: lambda errs to the small side
    share = {w: seen.get(w, 0) / total for w in model.weight}
    model.lam = karlin_lambda(np.array(list(model.weight.values())), np.array(list(share.values())))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0).cast(pa.large_binary()):
                words = words_alnum(text.as_py())
                rows.append((len(words), sorted((s[0] for s in segments(model.hits(words))), reverse=True)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.float64())), batch.column(1)], names=["n", "s", "label"]
            )

    held = sample.where("part = 1").select("text", "label").mapInArrow(best, "n long, s array<double>, label int").collect()
    clean = [(r["n"], r["s"][0]) for r in held if not r["label"] and r["s"] and r["n"]]
    n_clean_docs = sum(1 for r in held if not r["label"] and r["n"])
    if clean:
        # clean documents without any segment count in the rate: K n exp(-lambda s) segments are expected above s
        least = min(s for _, s in clean)
        mass = sum(r["n"] for r in held if not r["label"]) * math.exp(-model.lam * least)
        model.k = max(len(clean) / max(mass, 1e-12), 1e-6)
    elif n_clean_docs:
        model.k = 1.0 / max(1.0, sum(r["n"] for r in held if not r["label"]))
    if len({r["label"] for r in held}) == 2:
        x, y = [], []
        for r in held:
            e = [v for v in (model.excess(s, r["n"]) for s in r["s"]) if v >= -math.log(LEAST_E)]
            x.append((1.0, math.log1p(max(e, default=0.0)), math.log1p(len(e))))
            y.append(r["label"])
        model.curve = tuple(float(v) for v in logistic(np.array(x), np.array(y, dtype=float)))
    return model


FOUND = "struct<score:double,passages:array<struct<start:bigint,stop:bigint,score:double>>>"
_FOUND = pa.struct([
    ("score", pa.float64()),
    ("passages", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))),
])


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """docs with a column `out`: probability, and every significant passage by word offsets. No shuffle.

    Null and empty texts have no passage and get the curve's lowest value. Other columns
    stay as they are; one called as `out` raises a ValueError.
    """
    wide = docs.select(*columns_of(docs), F.lit(None).cast(FOUND).alias(new_column(docs, out)))
    at, text_at = len(docs.columns), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(text_at).cast(pa.large_binary()):
                p, found = model.score(words_alnum(text.as_py()))
                rows.append({"score": p, "passages": [{"start": a, "stop": b, "score": s} for s, a, b in found]})
            yield batch.set_column(at, batch.schema.field(at).name, pa.array(rows, _FOUND))

    return wide.mapInArrow(run, wide.schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read(spark, sf_dir, "labels"), ~held_out("_id", 3, 1))
    out = score_toxicity(docs, model)
    return out.select(
        "doc_id",
        held_out("doc_id", 3, 1).alias("held_out"),
        F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= 0.7).cast("int").alias("predicted"),
        F.size("toxicity.passages").cast("long").alias("n_passages"),
    )

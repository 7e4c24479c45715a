"""A training corpus from `documents`: quality, lines, near-duplicates, benchmark passages, mixture.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns
of documents; the last returns them too, with a row as often as the mixture takes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filtra.llm import decontaminate, line_dedup, mixing, quality_classifier, simhash_dedup
from filtra.llm.common import held_out, read, release, release_since, settle, settled, unused


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine rejects go."""
    machine = quality_classifier.fit(docs, read(spark, sf_dir, "labels"), ~held_out("_id", 5, 0))
    score = unused("quality", docs)
    scored = quality_classifier.score_quality(docs, machine, out=score)
    return scored.where(F.col(score) >= quality_classifier.THRESHOLD).drop(score)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts; n_chars follows."""
    out = line_dedup.drop_repeated_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash_dedup.near_dedup(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 13 words of a benchmark item in a row go, however long they are."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for."""
    return mixing.mix(docs)


def _alone(stage):
    """The stage, which begins by deleting what earlier stages settled: their results have been written by then."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release_since(spark, _LEFT.pop() if _LEFT else settled())
        _LEFT.append(settled())
        return stage(spark, docs, sf_dir)

    return run_stage


#: How many settled tables stood when the last stage began.
_LEFT: list[int] = []

STAGES = [
    ("quality", _alone(quality)),
    ("lines", _alone(lines)),
    ("near_duplicates", _alone(near_duplicates)),
    ("benchmark", _alone(benchmark)),
    ("mixture", _alone(mixture)),
]

#: Neither the classifier nor the connected groups can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in (("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark)):
        mark, last = settled(), docs
        docs = settle(stage(spark, docs, sf_dir))
        release_since(spark, mark, but=docs)
        release(last)
    return mixture(spark, docs, sf_dir)

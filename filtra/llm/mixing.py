"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filtra.llm.common import read, settle

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0


def n_words(text: Column) -> Column:
    """Number of runs without ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from one row a source with its source_size.

    Sources in code-point order, null last, get the weights in turn. The total,
    share times all sizes, is split by weight; a target stops at most times its
    source's size and the excess goes to the others by weight. In the order of
    capacity by weight, the level that fills the sources from k on after those
    before k are full is (total - their capacities) / (weights from k on); it rises
    while sources fill up and falls afterwards, so its largest value is the level.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)
    s = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    full = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_ = F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(share)
    s = s.withColumn("level", (total - full) / open_)
    s = s.withColumn("level", F.max("level").over(Window.partitionBy()))
    return s.select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def systematic_copies(
    docs: DataFrame, size: Column, source_col: str = "source", id_col: str = "doc_id", seed: str = "mix"
) -> DataFrame:
    """(row, size, source_size, target, copies): each row of docs as a struct, whatever its columns are called.

    Within a source every document expects target / source_size copies. Documents
    stand in the order of size and id, the expected copies are summed along it, one
    offset a source (from its name and the seed, so that reruns agree) is added, and
    a document is emitted once for each whole number that its stretch passes.
    Neighbours in the order have like sizes, so the words taken come near the target.

    The order is a range partitioning, which deals a hot source to many tasks; each
    row's rank is its place in its partition plus the rows of its source in earlier
    partitions, known from one count a partition and source. Empty sources get no
    copies; null sources form one source; null texts have size 0.
    """
    rows = docs.select(
        F.struct("*").alias("row"),
        size.cast("long").alias("_mix_size"),
        F.col(source_col).alias("_mix_source"),
        F.col(id_col).alias("_mix_id"),
    )
    order = [F.col("_mix_source").asc_nulls_last(), F.col("_mix_size").asc(), F.col("_mix_id").asc_nulls_last()]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = settle(rows.withColumn("_mix_at", F.monotonically_increasing_id()))
    part = F.shiftright("_mix_at", 33)
    runs = rows.groupBy(part.alias("_mix_part"), "_mix_source").agg(
        F.min("_mix_at").alias("first"), F.count(F.lit(1)).alias("n"), F.sum("_mix_size").alias("words")
    )
    runs = settle(runs)  # one row a partition and source in it
    sums = runs.groupBy(F.col("_mix_source").alias("source")).agg(F.sum("words").alias("source_size"))
    goal = targets(sums)
    before = Window.partitionBy("_mix_source").orderBy("_mix_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "_mix_part", "_mix_source", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("_mix_shift")
    )
    runs = runs.join(goal, runs["_mix_source"].eqNullSafe(goal["source"])).drop("source")
    runs = runs.withColumnsRenamed({"source_size": "_mix_source_size", "target": "_mix_target", "_mix_source": "_mix_s", "_mix_part": "_mix_p"})
    rows = rows.join(
        runs, (F.shiftright("_mix_at", 33) == F.col("_mix_p")) & F.col("_mix_source").eqNullSafe(F.col("_mix_s"))
    )
    rank = (F.col("_mix_at") + F.col("_mix_shift")).cast("double")
    each = F.when(F.col("_mix_source_size") > 0, F.col("_mix_target") / F.col("_mix_source_size")).otherwise(F.lit(0.0))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), F.col("_mix_source")), F.lit("null")))
    start = F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    copies = F.floor((rank + 1) * each + start) - F.floor(rank * each + start)
    return rows.select(
        "row", F.col("_mix_size").alias("size"), F.col("_mix_source_size").alias("source_size"),
        F.col("_mix_target").alias("target"), copies.alias("copies"),
    )


def mix(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """Each row of docs as often as its copies, columns as they are."""
    out = systematic_copies(docs, n_words(F.col(text_col)), source_col, id_col).where("copies > 0")
    again = F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("one")
    return out.select("row", again).select("row.*")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    out = systematic_copies(docs, F.col("size"))
    return out.select(
        "row.doc_id",
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
        F.col("copies").cast("long").alias("copies"),
    )


SQL = """
WITH d AS (
  SELECT doc_id, source,
         CAST(COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3
              WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM d GROUP BY source),
l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - COALESCE(sum(source_size * 2.0::DOUBLE) OVER (
                 ORDER BY source_size * 2.0::DOUBLE / weight, source ASC NULLS LAST
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE))
            / sum(weight) OVER (
                 ORDER BY source_size * 2.0::DOUBLE / weight, source ASC NULLS LAST
                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s),
t AS (
  SELECT source, source_size, least(source_size * 2.0::DOUBLE, max(level) OVER () * weight) AS target,
         CAST('0x' || substr(md5('mix:' || COALESCE('=' || source, 'null')), 1, 8) AS BIGINT)
           / 4294967296.0::DOUBLE AS start
  FROM l),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.start,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS each_,
         CAST(row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) - 1 AS DOUBLE) AS rank_
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT *, CAST(floor((rank_ + 1) * each_ + start) - floor(rank_ * each_ + start) AS BIGINT) AS copies FROM r)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c
"""

"""Clouds, diagrams, graphs, grids and series derived from the TPC-H-like tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filtra.plans.tables import load


def half_away(c: Column, places: int) -> Column:
    """c to so many places as SQL engines on doubles do it: scaled, rounded half away from zero, scaled back.

    `round` takes the half from the decimal form instead: 1.005 has 1.01 there and 1.0 here.
    """
    scale = float(10**places)
    return F.when(F.abs(c) < 1e9, F.signum(c) * F.floor(F.abs(c) * scale + 0.5) / scale).otherwise(F.round(c, places))


def supplier_line(spark: SparkSession, sf: str) -> DataFrame:
    """One-dimensional clouds: account balances of each nation's suppliers, in thousands."""
    s = load(spark, sf, "supplier")
    return s.select(F.col("s_nationkey").cast("string").alias("cloud_id"), F.col("s_suppkey").alias("point_id"), F.array(F.col("s_acctbal") / 1000).alias("coords"))


SUPPLIER_LINE = "line AS (SELECT CAST(s_nationkey AS VARCHAR) AS cloud_id, s_suppkey AS point_id, s_acctbal / 1000 AS x FROM supplier)"


def part_plane(spark: SparkSession, sf: str) -> DataFrame:
    """Two-dimensional clouds: size and price (in hundreds) of each brand's parts."""
    p = load(spark, sf, "part")
    return p.select(F.col("p_brand").alias("cloud_id"), F.col("p_partkey").alias("point_id"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice") / 100).alias("coords"))


PART_PLANE = "plane AS (SELECT p_brand AS cloud_id, p_partkey AS point_id, CAST(p_size AS DOUBLE) AS x, p_retailprice / 100 AS y FROM part)"


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "embeddings")
    return e.select(F.col("label").cast("string").alias("cloud_id"), F.col("vec_id").alias("point_id"), F.col("embedding").cast("array<double>").alias("coords"))


VECTORS = "vec AS (SELECT CAST(label AS VARCHAR) AS cloud_id, vec_id AS point_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def shipping_diagram(spark: SparkSession, sf: str) -> DataFrame:
    """A pair a line item, by order priority: born on the order day, dead on the shipping day; returned ones never die."""
    o, l = load(spark, sf, "orders"), load(spark, sf, "lineitem")
    j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    birth = F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01")).cast("double")
    life = F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))
    death = F.when(F.col("l_returnflag") == "R", F.lit(float("inf"))).otherwise(birth + life)
    d = j.select(F.col("o_orderpriority").alias("diagram_id"), F.pmod("l_linenumber", F.lit(2)).cast("int").alias("dim"), birth.alias("birth"), death.alias("death"))
    return d.where("death >= birth")


SHIPPING = """d AS (SELECT * FROM (
  SELECT o_orderpriority AS diagram_id, CAST(l_linenumber % 2 AS INTEGER) AS dim,
         CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS birth,
         CASE WHEN l_returnflag = 'R' THEN 'infinity'::DOUBLE ELSE CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) END AS death
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE death >= birth),
f AS (SELECT *, death - birth AS p FROM d WHERE death < 'infinity'::DOUBLE)"""


def supplier_diagram(spark: SparkSession, sf: str) -> DataFrame:
    """Small diagrams: a pair a supplier, by region."""
    s = load(spark, sf, "supplier").join(load(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    birth = half_away(F.col("s_acctbal") / 1000, 2)
    return s.select(
        F.col("n_regionkey").cast("string").alias("diagram_id"), F.pmod("s_suppkey", F.lit(2)).cast("int").alias("dim"),
        birth.alias("birth"), (birth + (1 + F.pmod(F.col("s_suppkey") * 7, F.lit(13))) / 10.0).alias("death"),
    )


SUPPLIERS = """d AS (
  SELECT CAST(n_regionkey AS VARCHAR) AS diagram_id, CAST(s_suppkey % 2 AS INTEGER) AS dim, round(s_acctbal / 1000, 2) AS birth,
         round(s_acctbal / 1000, 2) + (1 + (s_suppkey * 7) % 13) / 10.0::DOUBLE AS death
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
f AS (SELECT *, death - birth AS p FROM d)"""


def order_grid(spark: SparkSession, sf: str) -> DataFrame:
    """A grid of months and years: thousands of orders' value."""
    o = load(spark, sf, "orders")
    g = o.groupBy((F.month("o_orderdate") - 1).alias("x"), (F.year("o_orderdate") - 1992).alias("y")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("s"))
    return g.select(F.lit("orders").alias("grid_id"), "x", "y", F.floor(F.col("s") / 1000).cast("double").alias("value"))


GRID = """g AS (SELECT 'orders' AS grid_id, month(o_orderdate) - 1 AS x, year(o_orderdate) - 1992 AS y,
  CAST(floor(sum(CAST(o_totalprice AS DECIMAL(18,2))) / 1000) AS DOUBLE) AS value FROM orders GROUP BY ALL)"""


def event_series(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    return e.select("event_id", "event_type", "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"), "ts", "value")


EVENTS = "e AS (SELECT event_id, event_type, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, ts, value FROM events)"


def part_edges(spark: SparkSession, sf: str, radius: float = 1.5) -> DataFrame:
    from filtra.operators.distance import range_edges

    return range_edges(part_plane(spark, sf), radius)


PART_EDGES = PART_PLANE + """,
ed AS (SELECT a.cloud_id, a.point_id AS src, b.point_id AS dst, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist
  FROM plane a JOIN plane b ON a.cloud_id = b.cloud_id AND a.point_id < b.point_id
  WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 1.5)"""


def supplier_line_diagram(spark: SparkSession, sf: str) -> DataFrame:
    """Diagrams small enough for exact assignment: component barcodes of each nation's suppliers."""
    from filtra.operators.persistence import persistence

    return persistence(supplier_line(spark, sf), 0)

"""Quality rules with adaptive thresholds from mergeable quantile sketches, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filtra.llm.common import read, settle

_WHITE = " \t\n\x0b\x0c\r"
_SYMBOLS = "[#*$%&|<>]"

#: Metrics in thousandths (word length in hundredths of a character), and which side is out.
METRICS = {"symbols": "high", "dup_lines": "high", "repeats": "high", "word_chars": "both"}
#: A fence lies this many spreads beyond the quartile; a spread counts as its floor at least.
FENCE = 4.0
SPREAD_FLOOR = {"symbols": 10, "dup_lines": 150, "repeats": 100, "word_chars": 60}
#: A sketch of fewer documents than this gives way to its language's, and that to the whole table's.
LEAST_DOCS = 200


def _repeat_words(windows: str) -> Column:
    """How many words lie in windows (hashes of three words) that occur more than once.

    Hash and place share one long, places in the low bits that their number needs, so
    that one sort of primitive longs brings equal windows together.
    """
    # transform(array(x), v -> ...)[0] names x, so that it is computed once
    return F.expr(f"""
        CASE WHEN size(array_distinct({windows})) = size({windows}) THEN 0L
        ELSE transform(array(length(bin(size({windows})))), b ->
          transform(array(sort_array(transform({windows}, (x, i) -> shiftleft(x, b) | cast(i AS bigint)))), s ->
            transform(array(sort_array(transform(
                filter(sequence(0, size(s) - 1), k ->
                  (k > 0 AND shiftrightunsigned(get(s, k), b) = shiftrightunsigned(get(s, k - 1), b))
                  OR (k < size(s) - 1 AND shiftrightunsigned(get(s, k), b) = shiftrightunsigned(get(s, k + 1), b))),
                k -> get(s, k) & (shiftleft(1L, b) - 1)))), p ->
              aggregate(sequence(0, size(p) - 1), 0L, (total, k) ->
                total + CASE WHEN k < size(p) - 1 THEN least(3L, get(p, k + 1) - get(p, k)) ELSE 3L END))[0])[0])[0]
        END""")


def document_stats(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns named in keep, and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Words are runs without ASCII white space; a null text has none. Everything is
    counted within the row: no shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.btrim(text, F.lit(_WHITE))
    words = F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    out = docs.select(
        *[F.col(f"`{c}`") for c in keep],
        words.alias("_words"),
        lines.alias("_lines"),
        F.regexp_count(text, F.lit(_SYMBOLS)).cast("long").alias("n_symbols"),
    )
    out = out.select(
        *[F.col(f"`{c}`") for c in keep],
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr("""CASE WHEN size(_words) < 3 THEN array() ELSE
            transform(sequence(0, size(_words) - 3), i -> xxhash64(get(_words, i), get(_words, i + 1), get(_words, i + 2)))
            END""").alias("_windows"),
    )
    return out.withColumn("n_repeat_words", _repeat_words("_windows")).drop("_windows")


def metrics() -> dict[str, Column]:
    return {
        "symbols": F.expr("n_symbols * 1000 div greatest(word_chars, 1)"),
        "dup_lines": F.expr("n_dup_lines * 1000 div greatest(n_lines, 1)"),
        "repeats": F.expr("n_repeat_words * 1000 div greatest(n_words, 1)"),
        "word_chars": F.expr("word_chars * 100 div greatest(n_words, 1)"),
    }


def sketch_bucket(v: Column) -> Column:
    """The lower edge of v's bucket: whole numbers to 63 exactly, above them the six leading bits.

    Buckets are fixed, so sketches merge by adding counts, in any order, with a
    relative error of a quantile below 1/32 whatever the number of rows.
    """
    low = F.greatest(F.length(F.bin(v)) - 6, F.lit(0)).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", v, low), low)


def quantile_sketches(stats: DataFrame, by: list[str]) -> DataFrame:
    """(by, metric, bucket, n): one mergeable sketch a group and metric."""
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("long").alias("v")) for k, v in metrics().items()])
    rows = stats.select(*by, F.explode(pairs).alias("x"))
    return rows.groupBy(*by, F.col("x.metric").alias("metric"), sketch_bucket(F.col("x.v")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n")
    )


def sketch_quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """(by, metric, docs, q1, q3): the smallest buckets that reach a quarter and three quarters."""
    group = Window.partitionBy(*by, "metric")
    run = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    s = sketch.withColumn("docs", F.sum("n").over(group)).withColumn("upto", F.sum("n").over(run))
    return s.groupBy(*by, "metric").agg(
        F.max("docs").alias("docs"),
        F.min(F.when(F.col("upto") * 4 >= F.col("docs"), F.col("bucket"))).alias("q1"),
        F.min(F.when(F.col("upto") * 4 >= F.col("docs") * 3, F.col("bucket"))).alias("q3"),
    )


def adaptive_fences(stats: DataFrame, by: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """(lang, source, lo_<metric>, hi_<metric>): a row a language and source.

    The fence of a metric lies FENCE spreads outside the quartiles of the finest
    sketch with LEAST_DOCS documents: language and source, language, or all. The
    coarser sketches are merged from the fine one.
    """
    a, b = by
    fine = settle(quantile_sketches(stats.where("n_words >= 50"), [a, b]))
    middle = fine.groupBy(a, "metric", "bucket").agg(F.sum("n").alias("n"))
    whole = middle.groupBy("metric", "bucket").agg(F.sum("n").alias("n"))
    groups = stats.select(a, b).distinct()
    metric = F.explode(F.array(*[F.lit(m) for m in METRICS])).alias("metric")
    out = groups.select(a, b, metric)
    for i, (sketch, keys) in enumerate(((fine, [a, b]), (middle, [a]), (whole, []))):
        q = sketch_quantiles(sketch, keys).withColumnsRenamed({c: f"{c}_{i}" for c in (*keys, "metric", "docs", "q1", "q3")})
        same = F.col("metric") == F.col(f"metric_{i}")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"{k}_{i}"))
        out = out.join(q, same, "left")
    pick = lambda c: (
        F.when(F.col("docs_0") >= LEAST_DOCS, F.col(f"{c}_0")).when(F.col("docs_1") >= LEAST_DOCS, F.col(f"{c}_1")).otherwise(F.col(f"{c}_2"))
    )
    floor = F.create_map(*[F.lit(x) for kv in SPREAD_FLOOR.items() for x in kv])
    out = out.select(a, b, "metric", pick("q1").alias("q1"), pick("q3").alias("q3"))
    reach = F.lit(FENCE) * F.greatest(F.col("q3") - F.col("q1"), F.element_at(floor, F.col("metric")))
    out = out.select(a, b, "metric", (F.col("q1") - reach).alias("lo"), (F.col("q3") + reach).alias("hi"))
    one = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{c}_{m}")
    return out.groupBy(a, b).agg(*[one(m, c) for m in METRICS for c in ("lo", "hi")])


def apply_rules(docs: DataFrame, keep: tuple[str, ...], by: tuple[str, str] = ("lang", "source"), text_col: str = "text") -> DataFrame:
    """The columns named in keep, each document's counts, base_failed, kept and the metrics that are out of bounds.

    Fixed rules: fewer than 50 words, or over half of them in repeated three-word
    windows. Otherwise a document goes if a metric lies outside its language's and
    source's fences. Null languages and sources are groups of their own; a null text
    fails the base; with no document of 50 words there are no fences and none is out.
    """
    a, b = by
    names = tuple(dict.fromkeys((*keep, a, b)))
    stats = settle(document_stats(docs, text_col, names))
    fences = adaptive_fences(stats, by).withColumnsRenamed({a: "_a", b: "_b"})
    rows = stats.join(fences, F.col(a).eqNullSafe(F.col("_a")) & F.col(b).eqNullSafe(F.col("_b")), "left").drop("_a", "_b")
    rows = rows.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))
    tests = []
    for m, v in metrics().items():
        out = v > F.col(f"hi_{m}")
        if METRICS[m] == "both":
            out = out | (v < F.col(f"lo_{m}"))
        tests.append(F.when(out, F.lit(m)))
    rows = rows.withColumn("outside", F.array_join(F.array_compact(F.array(*tests)), ","))
    rows = rows.withColumn("kept", ~F.col("base_failed") & (F.col("outside") == ""))
    return rows.select(
        *[F.col(f"`{c}`") for c in keep], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "outside",
    )


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    return apply_rules(read(spark, sf_dir, "documents"), ("doc_id",))


SQL = """
WITH d AS (
  SELECT doc_id, lang, source, COALESCE(text, '') AS t,
         regexp_extract_all(COALESCE(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         [x for x in string_split(COALESCE(text, ''), chr(10)) if regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS l
  FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM p),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g WHERE c > 1) GROUP BY doc_id),
s AS (
  SELECT d.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(COALESCE(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN r ON r.doc_id = d.doc_id),
m AS (
  SELECT *, n_symbols * 1000 // greatest(word_chars, 1) AS symbols, n_dup_lines * 1000 // greatest(n_lines, 1) AS dup_lines,
         n_repeat_words * 1000 // greatest(n_words, 1) AS repeats, word_chars * 100 // greatest(n_words, 1) AS chars FROM s),
x AS (
  SELECT lang, source, metric, (v >> low) << low AS bucket, count(*) AS n FROM (
    SELECT lang, source, metric, v, greatest(length(bin(v)) - 6, 0)::BIGINT AS low FROM (
      SELECT lang, source, unnest(['symbols', 'dup_lines', 'repeats', 'word_chars']) AS metric,
             unnest([symbols, dup_lines, repeats, chars]) AS v FROM m WHERE n_words >= 50))
  GROUP BY ALL),
lv AS (
  SELECT 0 AS level, lang, source, metric, bucket, n FROM x
  UNION ALL SELECT 1, lang, NULL, metric, bucket, sum(n) FROM x GROUP BY lang, metric, bucket
  UNION ALL SELECT 2, NULL, NULL, metric, bucket, sum(n) FROM x GROUP BY metric, bucket),
c AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric) AS docs,
         sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS upto FROM lv),
q AS (
  SELECT level, lang, source, metric, max(docs) AS docs, min(bucket) FILTER (upto * 4 >= docs) AS q1,
         min(bucket) FILTER (upto * 4 >= docs * 3) AS q3 FROM c GROUP BY level, lang, source, metric),
f AS (
  SELECT g.lang, g.source, g.metric,
         CASE WHEN a.docs >= 200 THEN a.q1 WHEN b.docs >= 200 THEN b.q1 ELSE e.q1 END AS q1,
         CASE WHEN a.docs >= 200 THEN a.q3 WHEN b.docs >= 200 THEN b.q3 ELSE e.q3 END AS q3,
         CASE g.metric WHEN 'symbols' THEN 10 WHEN 'dup_lines' THEN 150 WHEN 'repeats' THEN 100 ELSE 60 END AS least
  FROM (SELECT DISTINCT lang, source, unnest(['symbols', 'dup_lines', 'repeats', 'word_chars']) AS metric FROM m) g
  LEFT JOIN q a ON a.level = 0 AND a.metric = g.metric AND a.lang IS NOT DISTINCT FROM g.lang AND a.source IS NOT DISTINCT FROM g.source
  LEFT JOIN q b ON b.level = 1 AND b.metric = g.metric AND b.lang IS NOT DISTINCT FROM g.lang
  LEFT JOIN q e ON e.level = 2 AND e.metric = g.metric),
h AS (
  SELECT lang, source, max(q3 + 4.0 * greatest(q3 - q1, least)) FILTER (metric = 'symbols') AS hi_s,
         max(q3 + 4.0 * greatest(q3 - q1, least)) FILTER (metric = 'dup_lines') AS hi_d,
         max(q3 + 4.0 * greatest(q3 - q1, least)) FILTER (metric = 'repeats') AS hi_r,
         max(q3 + 4.0 * greatest(q3 - q1, least)) FILTER (metric = 'word_chars') AS hi_c,
         max(q1 - 4.0 * greatest(q3 - q1, least)) FILTER (metric = 'word_chars') AS lo_c
  FROM f GROUP BY lang, source),
k AS (
  SELECT m.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         concat_ws(',', CASE WHEN symbols > hi_s THEN 'symbols' END, CASE WHEN dup_lines > hi_d THEN 'dup_lines' END,
                   CASE WHEN repeats > hi_r THEN 'repeats' END, CASE WHEN chars > hi_c OR chars < lo_c THEN 'word_chars' END) AS outside
  FROM m JOIN h ON h.lang IS NOT DISTINCT FROM m.lang AND h.source IS NOT DISTINCT FROM m.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND outside = '' AS kept, outside FROM k
"""

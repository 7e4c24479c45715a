"""Reading and writing diagrams and clouds: CSV, JSON, OFF, PLY, NPY, and layouts of other packages."""

from __future__ import annotations

import io
import math
from collections.abc import Iterable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filtra.schema import CLOUD, DIAGRAM, INF, validate_diagram

JSON_FORMAT = "filtra_v1"


def load_csv(spark: SparkSession, path: str, columns: tuple[int, int, int] = (0, 1, 2)) -> DataFrame:
    """A diagram a file: birth, death, dimension by place; a header is told by its letters; no death: infinite."""
    raw = spark.read.text(path).withColumn("diagram_id", F.regexp_extract(F.input_file_name(), "([^/]+)$", 1))
    cell = F.split("value", ",")
    head = F.trim(F.get(cell, F.lit(columns[0]))).rlike("(?i)^[a-z_]*[a-z_]{3,}$") & ~F.trim(F.get(cell, F.lit(columns[0]))).rlike("(?i)^(nan|inf|infinity)$")
    rows = raw.where(F.length(F.trim("value")) > 0).where(~head)
    at = lambda i: F.nullif(F.trim(F.get(cell, F.lit(columns[i]))), F.lit(""))
    d = rows.select(
        "diagram_id", F.coalesce(at(2).cast("double").cast("int"), F.lit(0)).alias("dim"),
        at(0).cast("double").alias("birth"), F.coalesce(at(1).cast("double"), F.lit(INF)).alias("death"),
    )
    return validate_diagram(d)


def save_csv(diagram: DataFrame, path: str, header: bool = True) -> None:
    """birth, death, dimension; an infinite death is left blank."""
    death = F.when(F.col("death") < INF, F.col("death"))
    diagram.select("birth", death.alias("death"), F.col("dim").alias("dimension")).write.mode("overwrite").option("header", header).csv(path)


_OBJECT = "array<struct<birth:double,death:double,dimension:int>>"


def _from_objects(raw: DataFrame) -> DataFrame:
    o = raw.withColumn("o", F.from_json("value", f"struct<diagram:{_OBJECT},diagrams:array<{_OBJECT}>>"))
    d = o.select("diagram_id", F.posexplode(F.coalesce(F.col("o.diagrams"), F.array("o.diagram"))).alias("k", "pairs"))
    name = F.when(F.col("k") == 0, F.col("diagram_id")).otherwise(F.concat_ws("#", "diagram_id", F.col("k").cast("string")))
    d = d.select(name.alias("diagram_id"), F.explode("pairs").alias("p"))
    return validate_diagram(d.select("diagram_id", F.coalesce("p.dimension", F.lit(0)).alias("dim"), F.col("p.birth").alias("birth"), F.coalesce("p.death", F.lit(INF)).alias("death")))


def load_json(spark: SparkSession, path: str) -> DataFrame:
    """Files of one object with `diagram` or `diagrams`: entries with birth, death (null: infinite) and dimension."""
    return _from_objects(spark.read.text(path, wholetext=True).withColumn("diagram_id", F.regexp_extract(F.input_file_name(), "([^/]+)$", 1)))


def load_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Files of one such object a line, as save_json writes them."""
    return _from_objects(spark.read.text(path).withColumn("diagram_id", F.concat_ws(":", F.regexp_extract(F.input_file_name(), "([^/]+)$", 1), F.xxhash64("value").cast("string"))))


def to_json(diagram: DataFrame) -> DataFrame:
    """(diagram_id, value): one JSON object a diagram, pairs in canonical order, infinite deaths null."""
    p = F.struct("dim", "birth", "death")
    d = diagram.groupBy("diagram_id").agg(F.array_sort(F.collect_list(p)).alias("p"))
    pairs = F.transform("p", lambda x: F.struct(x["birth"].alias("birth"), F.when(x["death"] < INF, x["death"]).alias("death"), x["dim"].alias("dimension")))
    return d.select("diagram_id", F.to_json(F.struct(F.lit(JSON_FORMAT).alias("format"), pairs.alias("diagram")), {"ignoreNullFields": "false"}).alias("value"))


def save_json(diagram: DataFrame, path: str) -> None:
    to_json(diagram).select("value").write.mode("overwrite").text(path)


def _parse_off(text: str) -> list[list[float]]:
    lines = [x.split("#")[0].split() for x in text.splitlines()]
    cells = [x for x in lines if x]
    if not cells or not cells[0][0].upper().startswith("OFF"):
        raise ValueError("not an OFF file")
    first = cells[0][1:] if len(cells[0]) > 1 else cells[1]
    body = cells[1:] if len(cells[0]) > 1 else cells[2:]
    n = int(first[0])
    if len(body) < n or any(len(row) < 3 for row in body[:n]):
        raise ValueError(f"the OFF file ends before its {n} vertices do")
    return _checked([[float(v) for v in row[:3]] for row in body[:n]])


def _checked(rows: list[list[float]]) -> list[list[float]]:
    if not all(math.isfinite(v) for row in rows for v in row):
        raise ValueError("coordinates must be finite")
    return rows


def _parse_ply(raw: bytes) -> list[list[float]]:
    head, _, body = raw.partition(b"end_header\n")
    lines = [x.split() for x in head.decode("ascii", "replace").splitlines()]
    if not lines or lines[0] != ["ply"]:
        raise ValueError("not a PLY file")
    kind = next(x[1] for x in lines if x and x[0] == "format")
    names, n, inside = [], 0, False
    for x in lines:
        if x[:1] == ["element"]:
            inside = x[1] == "vertex"
            n = int(x[2]) if inside else n
        elif x[:1] == ["property"] and inside:
            names.append((x[2], x[1]))
    if kind == "ascii":
        rows = [x.split() for x in body.decode("ascii").splitlines()[:n]]
        at = [[k for k, _ in names].index(c) for c in "xyz"]
        if len(rows) < n or any(len(r) <= max(at) for r in rows):
            raise ValueError(f"the PLY file ends before its {n} vertices do")
        return _checked([[float(r[i]) for i in at] for r in rows])
    types = {"float": "f4", "float32": "f4", "double": "f8", "float64": "f8", "char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4"}
    order = "<" if "little" in kind else ">"
    table = np.frombuffer(body, np.dtype([(k, order + types[t]) for k, t in names]), n)
    return _checked([[float(table[c][i]) for c in "xyz"] for i in range(n)])


def _parse_npy(raw: bytes) -> list[list[float]]:
    a = np.load(io.BytesIO(raw), allow_pickle=False)
    if isinstance(a, np.lib.npyio.NpzFile):
        a = a["data" if "data" in a.files else a.files[0]]
    return np.atleast_2d(np.asarray(a, float)).tolist()


_PARSERS = {"off": lambda raw: _parse_off(raw.decode("utf-8", "replace")), "ply": _parse_ply, "npy": _parse_npy, "npz": _parse_npy, "txt": lambda raw: np.atleast_2d(np.loadtxt(io.BytesIO(raw), delimiter="," if b"," in raw else None)).tolist()}


def load_cloud(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Clouds from OFF, PLY, NPY, NPZ or text files (a glob or folder), one a file, parsed on the executors."""
    kind = kind or path.rsplit(".", 1)[-1].lower()
    if kind not in _PARSERS:
        raise ValueError(f"unknown format {kind!r}")
    parse = _PARSERS[kind]

    def run(batches: Iterable[pd.DataFrame]):
        for pdf in batches:
            for p, raw in zip(pdf["path"], pdf["content"]):
                rows = parse(bytes(raw))
                yield pd.DataFrame({"cloud_id": p.rsplit("/", 1)[-1], "point_id": range(len(rows)), "coords": rows})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, CLOUD)


def npy_bytes(points: DataFrame) -> DataFrame:
    """(cloud_id, value): an NPY file's bytes a cloud, points by point_id."""

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        np.save(out, np.array(pdf.sort_values("point_id")["coords"].tolist(), float))
        return pd.DataFrame({"cloud_id": [str(key[0])], "value": [out.getvalue()]})

    return points.select("cloud_id", "point_id", "coords").groupBy("cloud_id").applyInPandas(one, "cloud_id string, value binary")


def off_with_faces(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """(cloud_id, value): like off_text, with triangles (cloud_id, vertices of point_id) as faces by their points' places."""
    place = points.select("cloud_id", "point_id", (F.row_number().over(Window.partitionBy("cloud_id").orderBy("point_id")) - 1).alias("at"))
    corner = triangles.select("cloud_id", F.col("vertices").alias("face"), F.posexplode("vertices").alias("i", "point_id")).distinct()
    corner = corner.join(place, ["cloud_id", "point_id"]).groupBy("cloud_id", "face").agg(F.sort_array(F.collect_list(F.struct("i", "at"))).alias("c"))
    line = F.concat_ws(" ", F.size("c").cast("string"), F.array_join(F.transform("c", lambda x: x["at"].cast("string")), " "))
    faces = corner.select("cloud_id", line.alias("line")).groupBy("cloud_id").agg(F.sort_array(F.collect_list("line")).alias("faces"))
    v = off_text(points).select("cloud_id", F.split("value", "\n").alias("v")).join(faces, "cloud_id", "left")
    counts = F.concat_ws(" ", (F.size("v") - 2).cast("string"), F.greatest(F.size("faces"), F.lit(0)).cast("string"), F.lit("0"))
    body = F.concat(F.slice("v", 3, 1 << 30), F.coalesce("faces", F.array().cast("array<string>")))
    return v.select("cloud_id", F.concat_ws("\n", F.lit("OFF"), counts, F.array_join(body, "\n")).alias("value"))


def off_text(points: DataFrame) -> DataFrame:
    """(cloud_id, value): an OFF file's text a cloud, vertices by point_id, no faces."""
    line = F.transform(F.array_sort(F.collect_list(F.struct("point_id", "coords"))), lambda s: F.array_join(F.transform(F.slice(s["coords"], 1, 3), lambda x: x.cast("string")), " "))
    p = points.groupBy("cloud_id").agg(line.alias("lines"))
    return p.select("cloud_id", F.concat_ws("\n", F.lit("OFF"), F.concat_ws(" ", F.size("lines").cast("string"), F.lit("0 0")), F.array_join("lines", "\n")).alias("value"))


def ply_text(points: DataFrame) -> DataFrame:
    """(cloud_id, value): an ASCII PLY file's text a cloud."""
    o = off_text(points).select("cloud_id", F.split("value", "\n").alias("v"))
    head = F.concat_ws("\n", F.lit("ply\nformat ascii 1.0"), F.concat(F.lit("element vertex "), (F.size("v") - 2).cast("string")), F.lit("property double x\nproperty double y\nproperty double z\nend_header"))
    return o.select("cloud_id", F.concat(head, F.lit("\n"), F.array_join(F.slice("v", 3, 1 << 30), "\n"), F.lit("\n")).alias("value"))


def auto_load(spark: SparkSession, path: str, hint: str | None = None) -> DataFrame:
    """By extension or hint: csv and json give diagrams, off, ply, npy, npz and txt clouds, parquet what it holds."""
    kind = hint or path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return load_csv(spark, path)
    if kind == "json":
        return load_json(spark, path)
    return spark.read.parquet(path) if kind == "parquet" else load_cloud(spark, path, kind)


def auto_save(diagram: DataFrame, path: str, hint: str | None = None) -> None:
    kind = hint or path.rsplit(".", 1)[-1].lower()
    savers = {"csv": save_csv, "json": save_json, "parquet": lambda d, p: d.write.mode("overwrite").parquet(p)}
    if kind not in savers:
        raise ValueError(f"unknown format {kind!r}")
    savers[kind](diagram, path)


def from_pairs(spark: SparkSession, pairs: Iterable, diagram_id: str = "0") -> DataFrame:
    """Pairs as (dim, (birth, death)), (birth, death, dim), (birth, death), or objects with birth and death."""
    rows = []
    for p in pairs:
        if hasattr(p, "birth"):
            rows.append((diagram_id, int(getattr(p, "dimension", 0)), float(p.birth), float(p.death)))
        elif len(p) == 2 and isinstance(p[1], (tuple, list)):
            rows.append((diagram_id, int(p[0]), float(p[1][0]), float(p[1][1])))
        else:
            rows.append((diagram_id, int(p[2]) if len(p) > 2 else 0, float(p[0]), float(p[1])))
    return spark.createDataFrame(rows, DIAGRAM)


def from_lists(spark: SparkSession, lists: Iterable[Iterable] | Mapping, diagram_id: str = "0") -> DataFrame:
    """A list of (birth, death) a dimension, or a mapping with them under `dgms`; objects may have attributes."""
    lists = lists["dgms"] if isinstance(lists, Mapping) else getattr(lists, "dgms", lists)
    point = lambda p: (float(p.birth), float(p.death)) if hasattr(p, "birth") else (float(p[0]), float(p[1]))
    return spark.createDataFrame([(diagram_id, k, *point(p)) for k, part in enumerate(lists) for p in part], DIAGRAM)


def to_lists(diagram: DataFrame) -> DataFrame:
    """(diagram_id, dim, pairs): ordered arrays of (birth, death) a dimension."""
    return diagram.groupBy("diagram_id", "dim").agg(F.array_sort(F.collect_list(F.struct("birth", "death"))).alias("pairs"))


# sample clouds, each a deterministic function of the seed


def _cloud(spark: SparkSession, n: int, cloud_id: str, coords) -> DataFrame:
    return spark.range(n).select(F.lit(cloud_id).alias("cloud_id"), F.col("id").alias("point_id"), F.array(*coords).alias("coords"))


def _uniform(seed: int, draw: int):
    """In [0, 1) from a hash of id, seed and draw: the same whatever the partitioning."""
    return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(draw)), F.lit(1 << 52)) / float(1 << 52)


def _gauss(seed: int, draw: int):
    return F.sqrt(-2 * F.log(1 - _uniform(seed, draw))) * F.cos(2 * math.pi * _uniform(seed, draw + 1000))


def circle(spark: SparkSession, n: int = 100, radius: float = 1.0, noise: float = 0.0, seed: int = 0) -> DataFrame:
    a = 2 * math.pi * _uniform(seed, 0)
    return _cloud(spark, n, "circle", [radius * F.cos(a) + noise * _gauss(seed, 1), radius * F.sin(a) + noise * _gauss(seed, 2)])


def sphere(spark: SparkSession, n: int = 100, dim: int = 2, radius: float = 1.0, seed: int = 0) -> DataFrame:
    g = [_gauss(seed, i) for i in range(dim + 1)]
    size = F.sqrt(sum((x * x for x in g[1:]), g[0] * g[0]))
    return _cloud(spark, n, "sphere", [radius * x / size for x in g])


def torus(spark: SparkSession, n: int = 100, major: float = 2.0, minor: float = 1.0, seed: int = 0) -> DataFrame:
    a, b = 2 * math.pi * _uniform(seed, 0), 2 * math.pi * _uniform(seed, 1)
    ring = major + minor * F.cos(b)
    return _cloud(spark, n, "torus", [ring * F.cos(a), ring * F.sin(a), minor * F.sin(b)])


def swiss_roll(spark: SparkSession, n: int = 100, seed: int = 0) -> DataFrame:
    t = 1.5 * math.pi * (1 + 2 * _uniform(seed, 0))
    return _cloud(spark, n, "swiss_roll", [t * F.cos(t), 20 * _uniform(seed, 1), t * F.sin(t)])


def mobius_strip(spark: SparkSession, n: int = 100, seed: int = 0) -> DataFrame:
    u, v = 2 * math.pi * _uniform(seed, 0), _uniform(seed, 1) - 0.5
    ring = 1 + v * F.cos(u / 2)
    return _cloud(spark, n, "mobius_strip", [ring * F.cos(u), ring * F.sin(u), v * F.sin(u / 2)])


def klein_bottle(spark: SparkSession, n: int = 100, seed: int = 0) -> DataFrame:
    u, v = 2 * math.pi * _uniform(seed, 0), 2 * math.pi * _uniform(seed, 1)
    ring = 2.5 + 1.5 * F.cos(v)
    return _cloud(spark, n, "klein_bottle", [ring * F.cos(u), ring * F.sin(u), 1.5 * F.sin(v) * F.cos(u / 2), 1.5 * F.sin(v) * F.sin(u / 2)])

"""Helpers that the corpus operators share: reading tables, cutting lineage, walking Arrow batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Byte classes of the two tokenisers, as bytes.translate tables (invalid bytes become blanks).
_ALNUM = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20
    for c in range(256)
)
SPACE_CLASS = "[\\x20\\x09-\\x0D]+"


def words_alnum(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z only) runs of digits, a-z and bytes above 0x7F; null has none."""
    return text.translate(_ALNUM).split() if text else []


def words_space(text: bytes | None) -> list[bytes]:
    """Runs without ASCII white space, lower-cased (A-Z only); null has none."""
    return text.lower().split() if text else []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession) -> str:
    """A folder that the driver and all executors share.

    It is taken from spark.checkpoint.dir; only a local session without that
    setting (tests) gets a temporary folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="filtra-"))
        base = _LOCAL[0]
    return f"{base.rstrip('/')}/filtra-{uuid.uuid4().hex}"


_LOCAL: list[str] = []
#: Folders written by settle and not yet deleted.
_SETTLED: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@atexit.register
def _sweep() -> None:
    import shutil

    for path in _LOCAL:
        shutil.rmtree(path, ignore_errors=True)


def settle(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cut lineage that outlives executors.

    The shuffle files of the write go as soon as it is done; the table goes by release.
    """
    spark = df.sparkSession
    path = scratch(spark)
    schema = df.schema
    was = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, was)
    _SETTLED.append(path)
    table = spark.read.schema(schema).parquet(path)
    table._settled = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more; other DataFrames are left alone."""
    for table in tables:
        if path := getattr(table, "_settled", None):
            _delete(table.sparkSession, path)


def settled() -> int:
    """How many settled tables stand: a mark for release_since."""
    return len(_SETTLED)


def release_since(spark: SparkSession, mark: int, but: DataFrame | None = None) -> None:
    """Delete the tables settled after the mark was taken (but one), when what reads them has been written."""
    for path in _SETTLED[mark:]:
        if path != getattr(but, "_settled", None):
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    if path in _SETTLED:
        _SETTLED.remove(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def unused(name: str, *tables: DataFrame) -> str:
    """The name, with underscores before it until no table has such a column."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def new_column(df: DataFrame, name: str) -> str:
    """The name of a column to add; a ValueError if df has it."""
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the table has a column {name!r} already; pass another name for the result")
    return name


def columns_of(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]


def binary_column(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()).to_pylist()


def map_batches(
    df: DataFrame, columns: list[Column | str], fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str
) -> DataFrame:
    """Apply fn to each Arrow batch of the named columns only (the scan reads nothing else)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.select(*columns).mapInArrow(run, schema)


def stable_hash(*cols: Column | str) -> Column:
    return F.xxhash64(*[F.col(c) if isinstance(c, str) else c for c in cols])


def held_out(doc_id: Column | str, folds: int, fold: int) -> Column:
    """True where crc32 of the id's decimal text, modulo folds, is fold."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % folds == fold, F.lit(False))

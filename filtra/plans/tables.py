"""Reading tables, and cutting the lineage of iterative plans through a shared folder."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session without it gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="filtra-tables-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return _own[0]


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and return a read of it."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def memoize(spark: SparkSession, folder: str, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What build returns, written as Parquet under the hash of the key in a shared folder and read from there the next time."""
    path = f"{folder.rstrip('/')}/{hashlib.sha256(key.encode()).hexdigest()}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)

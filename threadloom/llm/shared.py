"""Tables in the folder that driver and executors share, and bits that several operators use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = r"\x20\x09-\x0D"
BROADCAST_BYTES = 32 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where it is unset (tests on one machine) a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not folder:
        folder = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: short lineage that a lost executor can't break."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a stored table that nothing reads any more."""
    jvm = df.sparkSession._jvm
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def small_side(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df marked for broadcast if its rows fit BROADCAST_BYTES; a larger one is left to a shuffle join."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def unused(name: str, *frames: DataFrame) -> str:
    """The name, with underscores behind it until no column is called so."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def in_fold(doc_id: Column, fold: int) -> Column:
    """crc32 of the id's decimal text modulo 5 is fold (null id: no)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == fold, F.lit(False))


def least_hashes(rows: DataFrame, order: str, n: int, *ties: str) -> DataFrame:
    """The n rows of least ``order``, a 64-bit hash. Beyond 4 * n rows a bound that about 2 * n hashes lie below cuts the
    rest first, so that tasks don't each send n rows to the one that sorts. Where many rows share a hash above the bound,
    fewer than n may come."""
    total = rows.count()
    if total > 4 * n:
        rows = rows.where(F.col(order) < (1 << 65) * n // total - (1 << 63))
    return rows.orderBy(order, *ties).limit(n)

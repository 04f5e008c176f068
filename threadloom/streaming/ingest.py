"""Incremental ingestion as a stream: arriving raw files are normalised and unseen threads appended.

Each batch owns a folder of the target, named by its number, and overwrites it: a batch that is run again after a failure
leaves the rows that it left before, none twice. What is seen already is asked of the ids of earlier batches only, in the
buckets that the batch's own ids fall into.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.classify import thread_id
from threadloom.operators.extract import normalize_raw
from threadloom.schema import THREAD
from threadloom.sources.files import ENDINGS, LARGEST, raw_columns

FILES = "path string, modificationTime timestamp, length long, content binary"
ROWS = "path string, content string, mtime_ms double, size long"


def _bucket(thread: Column) -> Column:
    return F.left(thread, F.lit(1))  # of a hexadecimal hash


def _table(spark: SparkSession, path: str, empty: DataFrame) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except Exception as e:  # not there before the first batch
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return empty


def read_target(spark: SparkSession, target: str) -> DataFrame:
    """The threads of all batches."""
    return _table(spark, f"{target}/threads", spark.createDataFrame([], THREAD)).select(*THREAD.names)


def append_unseen(files: DataFrame, batch: int, target: str) -> None:
    """Write the records of a batch of raw files that no earlier batch has, in the batch's own folder. Of records of one id
    in a batch the latest stays, by a fixed rule."""
    spark = files.sparkSession
    buckets = [r[0] for r in files.select(_bucket(thread_id(F.col("path"))).alias("b")).distinct().collect()]  # at most 16
    seen = _table(spark, f"{target}/ids", spark.createDataFrame([], "thread_id string, bucket string, batch long"))
    seen = seen.where((F.col("batch") < batch) & F.col("bucket").cast("string").isin(buckets)).select("thread_id")
    threads = normalize_raw(files).join(seen, "thread_id", "left_anti")
    order = F.struct("meta.updated_at", F.xxhash64(F.to_json("messages")))
    threads = threads.groupBy("thread_id").agg(F.max_by(F.struct(*[c for c in THREAD.names if c != "thread_id"]), order).alias("r"))
    threads = threads.select(*[F.col(c if c == "thread_id" else f"r.{c}").alias(c) for c in THREAD.names])
    threads.write.mode("overwrite").parquet(f"{target}/threads/batch={batch}")
    ids = spark.read.schema(THREAD).parquet(f"{target}/threads/batch={batch}").select("thread_id", _bucket(F.col("thread_id")).alias("bucket"))
    ids.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/ids/batch={batch}")


def _run(rows: DataFrame, target: str, checkpoint: str) -> DataFrame:
    query = rows.writeStream.foreachBatch(lambda b, n: append_unseen(b, n, target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return read_target(rows.sparkSession, target)


def stream_ingest(spark: SparkSession, source: str, target: str, checkpoint: str, files: int = 8) -> DataFrame:
    """Read what has arrived in the source folder (Parquet rows of raw files), at most so many files a batch, and return the
    target."""
    return _run(spark.readStream.schema(ROWS).option("maxFilesPerTrigger", files).parquet(source), target, checkpoint)


def stream_files(spark: SparkSession, root: str, target: str, checkpoint: str, files: int = 1000, most: int = LARGEST) -> DataFrame:
    """Read the log files that have arrived below the root, a path or pattern, and return the target. A path is read once;
    files over so many bytes are left to sources.read_lines."""
    found = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(ENDINGS) + "}").option("maxFilesPerTrigger", files).load(root)
    return _run(raw_columns(found, most), target, checkpoint)

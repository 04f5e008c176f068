"""Search over a stored backup with an index of byte trigrams.

The index says which trigrams occur in the lowered JSON of a file's records. A search reads only the files that have all
trigrams of the wanted text, and tests their records exactly; no file that holds the text is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators.stats import search_threads
from threadloom.schema import THREAD

N = 3  # bytes; a bitmap of all trigrams takes 16 MB in a task


def searched(threads: DataFrame) -> Column:
    """The text of a record that searches look into."""
    return F.lower(F.to_json(F.struct(*[c for c in THREAD.names if c != "schema_version"])))


def trigrams(data: np.ndarray) -> np.ndarray:
    """Each run of three bytes as a number."""
    d = data.astype(np.int32)
    return (d[:-2] << 16) | (d[1:-1] << 8) | d[2:]


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigrams of each file that a task reads; its records come one after another."""
    now, seen = None, np.zeros(1 << 24, bool)

    def batch() -> pa.RecordBatch:
        found = np.flatnonzero(seen).astype(np.int32)
        seen[found] = False
        return pa.record_batch([pa.array(found), pa.array([now] * len(found), pa.string())], ["trigram", "file"])

    for b in batches:
        for file, text in zip(b.column("file").to_pylist(), b.column("text").to_pylist()):
            if file != now:
                if now is not None:
                    yield batch()
                now = file
            if text is not None:
                seen[trigrams(np.frombuffer(text.encode(), np.uint8))] = True
    if now is not None:
        yield batch()


def write_index(spark: SparkSession, backup: str, index: str) -> None:
    """The trigrams of every file of a Parquet backup, sorted, so that a lookup reads few row groups."""
    rows = spark.read.schema(THREAD).parquet(backup).select(F.col("_metadata.file_path").alias("file"), "*")
    found = rows.select("file", searched(rows).alias("text")).mapInArrow(_collect, "trigram int, file string")
    found.repartitionByRange("trigram").sortWithinPartitions("trigram", "file").write.mode("overwrite").parquet(index)


def candidate_files(spark: SparkSession, index: str, text: str) -> list[str] | None:
    """Files that have all trigrams of the lowered text, of which there are no more than files in the backup; null if the
    text is too short to have any."""
    wanted = sorted(set(trigrams(np.frombuffer(text.lower().encode(), np.uint8)).tolist())) if len(text.lower().encode()) >= N else []
    if not wanted:
        return None
    hits = spark.read.parquet(index).where(F.col("trigram").isin(wanted)).groupBy("file").agg(F.count_distinct("trigram").alias("n")).where(F.col("n") == len(wanted))
    return sorted(r["file"] for r in hits.select("file").collect())


def search_backup(spark: SparkSession, backup: str, index: str, text: str) -> DataFrame:
    """The records of a backup whose JSON holds the text, in any case of letters. Files added after the index was written are
    not looked into; a text of under three bytes is looked for in all."""
    files = candidate_files(spark, index, text)
    if files is not None and not files:
        return spark.createDataFrame([], THREAD)
    rows = spark.read.schema(THREAD).parquet(*(files if files is not None else [backup]))
    return search_threads(rows, text)

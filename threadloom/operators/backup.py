"""Incremental backup: content hashes, manifest, anti-joins, dedupe, import and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions.classify import canonical_json, content_hash
from threadloom.functions.text import slug

RECORD = ("schema_version", "thread_id", "type", "messages", "context", "meta")


def hashed(threads: DataFrame) -> DataFrame:
    """Adds hash, sha256 and file, from the record's canonical JSON."""
    record = canonical_json(F.struct(*RECORD), T.StructType([threads.schema[c] for c in RECORD]))
    out = threads.withColumns({"hash": content_hash(record), "sha256": F.sha2(record, 256)})
    return out.withColumn("file", F.concat_ws("-", "meta.source", slug(F.coalesce("meta.prompt", "thread_id")), F.concat("hash", F.lit(".json"))))


def incremental_new(threads: DataFrame, manifest: DataFrame) -> DataFrame:
    return threads.join(manifest.select("hash").distinct(), "hash", "left_anti")


def incremental_skipped(threads: DataFrame, manifest: DataFrame) -> DataFrame:
    return threads.join(manifest.select("hash").distinct(), "hash", "left_semi")


def build_manifest(threads: DataFrame, manifest: DataFrame) -> DataFrame:
    """One item a record; only new ones carry sha256 and file."""
    known = manifest.select("hash", F.lit(True).alias("known")).distinct()
    rows = threads.join(known, "hash", "left")
    new = lambda c: F.when(F.col("known").isNull(), F.col(c)).alias(c)
    return rows.select("hash", F.col("meta.source").alias("source"), "thread_id", new("sha256"), new("file"), F.col("known").isNull().alias("is_new"))


def manifest_summary(items: DataFrame) -> DataFrame:
    return items.agg(F.count("*").alias("total_items"), F.count_if("is_new").alias("new_items"), F.count_if(~F.col("is_new")).alias("skipped_items"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources_seen"))


def _one_of_each(rows: DataFrame, pick, *keys: str) -> DataFrame:
    """The row of each key whose ord is picked (F.min or F.max). Only keys and ords are grouped, pre-aggregated in tasks; the
    records join back once. ord tells rows apart; a null key is a key."""
    known = [F.coalesce(F.col(k).cast("string"), F.lit("\0")).alias(f"{k}_key") for k in keys]
    chosen = rows.groupBy(*known).agg(pick("ord").alias("ord")).select("ord")
    return rows.join(chosen, "ord", "left_semi")


def dedupe_threads(threads: DataFrame) -> DataFrame:
    """The first record, by ord, of each thread_id."""
    return _one_of_each(threads, F.min, "thread_id")


def import_new(threads: DataFrame, stored: DataFrame) -> DataFrame:
    """Records not stored yet, each hash once."""
    return _one_of_each(threads.join(stored.select("hash").distinct(), "hash", "left_anti"), F.min, "hash")


def import_union(unified: DataFrame, normalised: DataFrame) -> DataFrame:
    ready = unified.where("schema_version is not null and thread_id is not null")
    ready = ready.withColumn("meta", F.col("meta").withField("source", F.coalesce("meta.source", F.lit("imported"))))
    return ready.unionByName(normalised, allowMissingColumns=True)


def union_sources(files: DataFrame, stores: DataFrame) -> DataFrame:
    return files.unionByName(stores, allowMissingColumns=True)


def save_by_source(threads: DataFrame) -> DataFrame:
    """Adds safe_id, the file name; of equal names in a source the last wins."""
    raw = F.coalesce(F.nullif("thread_id", F.lit("")), F.left(F.col("messages")[0]["content"], F.lit(20)))
    named = threads.withColumn("safe_id", F.left(F.regexp_replace(raw, "[^a-zA-Z0-9_-]", "_"), F.lit(50))).withColumn("source", F.col("meta.source"))
    return _one_of_each(named, F.max, "source", "safe_id")


def write_backup(threads: DataFrame, path: str, fmt: str = "parquet", run: str = "0") -> None:
    """Partitioned by source and run; a hash salt keeps a large source from being one task. A run replaces what it wrote
    before, source by source, and leaves other runs alone: the same records written twice are there once."""
    rows = threads.withColumns({"source": F.col("meta.source"), "run": F.lit(run)})
    rows = rows.repartition("source", F.pmod(F.xxhash64("thread_id"), F.lit(16)))
    rows.write.partitionBy("source", "run").option("maxRecordsPerFile", 1_000_000).option("partitionOverwriteMode", "dynamic").mode("overwrite").format(fmt).save(path)


def save_manifest(items: DataFrame, table: str, path: str, buckets: int = 64) -> None:
    """A manifest as a table with files in a folder, in buckets by hash: incremental_new and its like then send records to
    the manifest's buckets, and the manifest itself is not sent anywhere."""
    items.write.bucketBy(buckets, "hash").sortBy("hash").mode("overwrite").option("path", path).saveAsTable(table)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def write_lines(rows: DataFrame, path: str, by: str) -> None:
    """The column line of the rows as JSON lines in their order, in folders by a column."""
    rows.select(by, F.to_json("line").alias("value")).write.partitionBy(by).text(path)

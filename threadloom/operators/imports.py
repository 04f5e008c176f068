"""Records from elsewhere: unified ones as they are, others through the extractors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators.backup import hashed, import_new, import_union
from threadloom.operators.extract import filled, get, normalize_raw
from threadloom.schema import THREAD
from threadloom.sources.files import read_import


def unify(rows: DataFrame, path: str, ingest_ms: int, apart: bool = False) -> DataFrame:
    """Thread records of rows with a record as JSON. One that has a schema version and a thread id is taken as it is, with
    the source "imported" if it has none. Others are normalised as if each were a file of the path, and so share its thread
    id; with ``apart`` each path gets a hash of the record behind it, and each record an id of its own."""
    v = F.try_parse_json("json")
    ready = filled(get(v, "schema_version")).isNotNull() & filled(get(v, "thread_id")).isNotNull()
    rows = rows.select("json", F.inline(F.array(F.struct(F.coalesce(ready, F.lit(False)).alias("ready")))))
    unified = rows.where("ready").select(F.from_json("json", THREAD).alias("r")).select("r.*")
    name, dot, ending = path.rpartition(".")
    own = F.concat(F.lit(f"{name}-"), F.left(F.sha1("json"), F.lit(12)), F.lit(dot + ending)) if apart else F.lit(path)
    files = rows.where("not ready").select(own.alias("path"), F.col("json").alias("content"), F.lit(float(ingest_ms)).alias("mtime_ms"), F.lit(0).cast("long").alias("size"))
    return import_union(unified, normalize_raw(files))


def import_records(spark: SparkSession, path: str, stored: DataFrame, ingest_ms: int, name: str | None = None, apart: bool = False) -> DataFrame:
    """The records of a dump (.json or .jsonl) that are not stored yet, each once, with hash, sha256 and file; name: the
    path that records are known by, if not the dump's own."""
    records = unify(read_import(spark, path), name or path, ingest_ms, apart).withColumn("ord", F.monotonically_increasing_id())
    rows = import_new(hashed(records), stored).drop("ord")
    return rows.withColumn("file", F.concat(F.lit("imported-"), "hash", F.lit(".json")))

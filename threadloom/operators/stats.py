"""Aggregations, ranking, paging and search over threads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import role_tokens

DIMS = {"project": "meta.project", "source": "meta.source", "type": "type"}


def _dim(name: str) -> Column:
    if name == "month":
        return F.coalesce(F.date_format(F.try_to_timestamp(F.col("meta.created_at")), "yyyy-MM"), F.lit("unknown"))
    return F.coalesce(F.nullif(F.col(DIMS[name]), F.lit("")), F.lit("unknown")) if name in DIMS else F.lit("unknown")


def _measures() -> list[Column]:
    level = lambda v: F.count_if(F.coalesce("confidence", F.lit("unknown")) == v).alias(v)
    return [F.count("*").alias("threads"), F.sum("n").alias("messages"), F.sum("tokens").alias("tokens"), F.sum("user").alias("user_tokens"), F.sum("ai").alias("ai_tokens"), F.max("ai").alias("max_ai"), F.max("user").alias("max_user"), level("high"), level("low"), level("unknown")]


def _slim(threads: DataFrame, dims: list[str]) -> DataFrame:
    return threads.select(*[_dim(d).alias(d) for d in dims], F.size("messages").cast("long").alias("n"), F.coalesce("meta.tokens", F.lit(0)).alias("tokens"), role_tokens(F.col("messages"), "user").alias("user"), role_tokens(F.col("messages"), "assistant").alias("ai"), F.col("meta.recognition_confidence").alias("confidence"))


def thread_stats(threads: DataFrame, dims: list[str] = ["project", "source"]) -> DataFrame:  # noqa: B006
    return _slim(threads, dims).groupBy(*dims).agg(*_measures())


def thread_totals(threads: DataFrame) -> DataFrame:
    return _slim(threads, []).agg(*_measures()).withColumnRenamed("threads", "total_records")


def thread_report(threads: DataFrame, dims: list[str] = ["project", "source"]) -> DataFrame:  # noqa: B006
    """thread_stats and thread_totals in one pass: the groups, and a row with is_total and no dimensions for all threads.
    Without threads there are no rows."""
    rows = _slim(threads, dims)
    return rows.groupingSets([[F.col(c) for c in dims], []], *[F.col(c) for c in dims]).agg((F.grouping(F.col(dims[0])) == 1).alias("is_total"), *_measures())


def rank_groups(stats: DataFrame, dims: list[str]) -> DataFrame:
    return stats.orderBy(F.desc("threads"), *dims)


def confidence_dist(threads: DataFrame) -> DataFrame:
    return threads.groupBy(F.coalesce("meta.recognition_confidence", F.lit("unknown")).alias("confidence")).agg(F.count("*").alias("n"))


def sources_seen(threads: DataFrame) -> DataFrame:
    return threads.select(F.col("meta.source").alias("source")).distinct().orderBy("source")


def scan_report(files: DataFrame, threads: DataFrame, stores: DataFrame) -> DataFrame:
    """One row: raw files, threads of stores, and all threads (those of files and of stores) with their sources and warnings."""
    a = files.agg(F.count("*").alias("total_files")).crossJoin(stores.agg(F.count("*").alias("total_sqlite")))
    b = threads.select(F.col("meta.source").alias("source"), F.col("meta.warnings").alias("warnings")).union(stores.select("meta.source", "meta.warnings"))
    b = b.agg(F.count("*").alias("total_records"), F.count_if(F.size("warnings") > 0).alias("warning_count"), F.array_join(F.sort_array(F.collect_set(F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown")))), ",").alias("sources_seen"))
    return a.crossJoin(b)


def search_threads(threads: DataFrame, text: str) -> DataFrame:
    return threads.where(F.contains(F.lower(F.to_json(F.struct("thread_id", "type", "messages", "context", "meta"))), F.lit(text.lower())))


def list_threads(threads: DataFrame, page: int = 1, size: int = 50, source: str | None = None, search: str | None = None) -> DataFrame:
    """A page of the threads of a source that hold a text, without messages and context; total counts all of them."""
    size = max(1, min(size, 200))
    threads = filter_source(threads, source) if source else threads
    threads = search_threads(threads, search) if search else threads
    items = threads.drop("messages", "context").orderBy("meta.source", "thread_id").offset((page - 1) * size).limit(size)
    return items.crossJoin(F.broadcast(threads.agg(F.count("*").alias("total"))))  # one row


def list_after(threads: DataFrame, after: tuple[str, str] | None = None, size: int = 50, source: str | None = None, search: str | None = None) -> DataFrame:
    """The threads that come after (source, thread_id), without messages and context. Each page costs the same, however deep:
    the condition cuts rows in the scan, and tasks send on a page of rows at most."""
    size = max(1, min(size, 200))
    threads = filter_source(threads, source) if source else threads
    threads = search_threads(threads, search) if search else threads
    if after is not None:
        threads = threads.where((F.col("meta.source") > after[0]) | ((F.col("meta.source") == after[0]) & (F.col("thread_id") > after[1])))
    return threads.drop("messages", "context").orderBy("meta.source", "thread_id").limit(size)


def filter_source(threads: DataFrame, source: str) -> DataFrame:
    return threads.where(F.col("meta.source") == source)


def since(threads: DataFrame, cutoff: str | None) -> DataFrame:
    """created_at from the cutoff on; a missing date is 1970, a missing or bad cutoff filters nothing."""
    at = F.coalesce(F.try_to_timestamp(F.col("meta.created_at")), F.timestamp_seconds(F.lit(0)))
    limit = F.try_to_timestamp(F.lit(cutoff))
    return threads.where(limit.isNull() | (at >= limit))

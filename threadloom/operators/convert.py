"""Threads to training rows, Markdown and tool-native files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import filled, trimmed, utf16_length

LEAST = 20


def sft_pairs(threads: DataFrame, least: int = LEAST) -> DataFrame:
    """ord, pair_idx, instruction, input, output of each user message that an assistant's follows."""
    n = F.size("messages")
    following = F.when(n >= 2, F.slice("messages", F.lit(2), n - 1))
    both = F.zip_with(F.slice("messages", F.lit(1), F.greatest(n - 1, F.lit(0))), following, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    fit = F.filter(both, lambda p: (p["a"]["role"] == "user") & (p["b"]["role"] == "assistant") & (utf16_length(trimmed(p["a"]["content"])) >= least) & (utf16_length(trimmed(p["b"]["content"])) >= least))
    rows = threads.select("ord", F.posexplode(fit).alias("pair_idx", "p"))
    return rows.select("ord", "pair_idx", trimmed(F.col("p.a.content")).alias("instruction"), F.lit("").alias("input"), trimmed(F.col("p.b.content")).alias("output"))


def _first_of(rows: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row of each key. Only hashes and positions are grouped (pre-aggregated); the texts join back once."""
    keyed = rows.withColumn("h", F.sha2(key, 256))
    least = keyed.groupBy("h").agg(F.min(F.struct(*order)).alias("first")).select(*[F.col(f"first.{c}").alias(c) for c in order])
    return rows.join(least, list(order), "left_semi")


def sft_dedupe(pairs: DataFrame) -> DataFrame:
    return _first_of(pairs, F.to_json(F.array("instruction", "output")), "ord", "pair_idx")


def _long_enough(least: int) -> Column:
    return F.filter("messages", lambda m: utf16_length(trimmed(m["content"])) >= least)


def to_sharegpt(threads: DataFrame, least: int = LEAST) -> DataFrame:
    who = lambda r: F.when(r == "assistant", "gpt").when(r == "system", "system").otherwise("human")
    rows = threads.select("ord", F.col("thread_id").alias("id"), F.transform(_long_enough(least), lambda m: F.struct(who(m["role"]).alias("from"), trimmed(m["content"]).alias("value"))).alias("conversations"))
    return rows.where(F.size("conversations") >= 2)


def sharegpt_dedupe(rows: DataFrame) -> DataFrame:
    return _first_of(rows, F.to_json(F.col("conversations.value")), "ord")


def to_multiturn(threads: DataFrame, least: int = LEAST) -> DataFrame:
    rows = threads.select("thread_id", F.col("meta.source").alias("source"), F.transform(_long_enough(least), lambda m: F.struct(m["role"].alias("role"), trimmed(m["content"]).alias("content"))).alias("messages"))
    return rows.where(F.size("messages") >= 1)


def markdown(threads: DataFrame) -> DataFrame:
    """ord, thread_id, markdown."""
    title = F.coalesce(filled(F.col("meta.prompt")), F.col("thread_id"))
    head = F.array(F.concat(F.lit("# Thread: "), title), F.lit(""), F.concat(F.lit("> **Source:** "), F.col("meta.source"), F.lit(" | **Project:** "), F.col("meta.project"), F.lit(" | **Created:** "), F.col("meta.created_at")), F.lit(""))
    body = F.flatten(F.transform("messages", lambda m: F.array(F.concat(F.lit("## "), F.upper(F.left(m["role"], F.lit(1))), F.substring(m["role"], 2, 1 << 30)), F.lit(""), F.coalesce(filled(m["content"]), F.lit("*(empty)*")), F.lit(""))))
    files = F.coalesce(F.transform("context.files", lambda f: F.concat(F.lit("- `"), f["path"], F.lit("`"))), F.array().cast("array<string>"))
    tail = F.when(F.size(files) > 0, F.concat(F.array(F.lit("## Context Files"), F.lit("")), files, F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))
    return threads.select("ord", "thread_id", F.array_join(F.concat(head, body, tail), "\n").alias("markdown"))


def markdown_doc(threads: DataFrame) -> DataFrame:
    """One row a thread, in order; all but the first begin with the separator."""
    rows = markdown(threads)
    first = rows.agg(F.min("ord").alias("first"))
    return rows.crossJoin(F.broadcast(first)).select("ord", F.concat(F.when(F.col("ord") > F.col("first"), "\n---\n\n").otherwise(""), "markdown").alias("markdown")).orderBy("ord")


def write_markdown(threads: DataFrame, path: str) -> None:
    """The Markdown of all threads in order, as text files that make the document, and a line end, when read by name."""
    markdown_doc(threads).select(F.regexp_replace("markdown", r"\A\n", "")).write.mode("overwrite").text(path)


def _last_of(rows: DataFrame, *order: str) -> DataFrame:
    """file, content of the last row of each file. Only names and positions are grouped; the contents join back once."""
    last = rows.groupBy("file").agg(F.max(F.struct(*order)).alias("last")).select("file", *[F.col(f"last.{c}").alias(c) for c in order])
    return rows.join(last, ["file", *order], "left_semi").select("file", "content")


def to_native(threads: DataFrame, tool: str) -> DataFrame:
    """file, content: what the tool reads. Rows of array files are the array's elements; of equal names of other files the
    last wins, by ord and then by the message's place. Fields without a value are left out."""
    created = F.col("meta.created_at")
    short = lambda c: F.left(F.md5(F.coalesce(c, F.lit(""))), F.lit(8))
    if tool in ("codex", "claude_code"):
        m = threads.select("ord", created.alias("created"), F.posexplode("messages").alias("i", "m"))
        ai = F.col("m.role") == "assistant"
        payload = F.struct(F.lit("message").alias("type"), F.when(ai, "assistant").otherwise("user").alias("role"), F.col("m.content").alias("content"))
        line = F.to_json(F.struct(F.when(ai, "response_item").otherwise("input_text").alias("type"), F.coalesce(filled(F.col("m.timestamp")), "created").alias("timestamp"), payload.alias("payload")))
        name = F.concat(F.lit("session-"), short(F.col("m.content")), F.lit(".jsonl"))
        return _last_of(m.select(name.alias("file"), line.alias("content"), "ord", "i"), "ord", "i")
    if tool == "cursor":
        bubbles = F.transform("messages", lambda m: F.struct(F.when(m["role"] == "assistant", "ai").otherwise("human").alias("type"), m["content"].alias("rawText"), F.struct(m["timestamp"].alias("clientStartTime")).alias("timingInfo")))
        return threads.select(F.lit("sessions.json").alias("file"), F.to_json(F.struct(F.col("thread_id").alias("id"), created.alias("created"), bubbles.alias("messages"))).alias("content"))
    if tool == "windsurf":
        return threads.select(F.lit("conversations.json").alias("file"), F.to_json(F.struct(F.col("thread_id").alias("id"), F.col("meta.prompt").alias("title"), "messages")).alias("content"))
    if tool == "antigravity":
        front = F.array(F.lit("---"), F.concat(F.lit("name: "), F.coalesce(filled(F.col("meta.prompt")), "thread_id")), F.concat(F.lit("source: "), F.col("meta.source")), F.concat(F.lit("created: "), created), F.lit("---"), F.lit(""))
        body = F.transform("messages", lambda m: F.concat(F.lit("## "), m["role"], F.lit("\n\n"), m["content"]))
        name, content = F.concat(F.lit("session-"), short(F.col("thread_id")), F.lit(".md")), F.array_join(F.concat(front, body), "\n")
    elif tool == "cline":
        name, content = F.concat(F.lit("conversation-"), short(F.col("thread_id")), F.lit(".jsonl")), F.to_json(F.struct(F.col("thread_id").alias("id"), created.alias("timestamp"), "messages"))
    elif tool == "codebuddy":
        name, content = F.concat(F.lit("session-"), short(F.col("thread_id")), F.lit(".jsonl")), F.to_json(F.struct(F.col("thread_id").alias("session_id"), created.alias("created"), "messages"))
    else:
        return threads.select(F.lit("imported-sessions.json").alias("file"), F.to_json(F.struct("schema_version", "thread_id", "type", "messages", "context", "meta")).alias("content"))
    return _last_of(threads.select(name.alias("file"), content.alias("content"), "ord"), "ord")

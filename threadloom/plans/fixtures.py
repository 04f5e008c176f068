"""Inputs that the queries derive from the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.text import estimate_tokens
from threadloom.operators.backup import hashed
from threadloom.operators.extract import first_user_prompt
from threadloom.schema import CONTEXT_DDL, MESSAGES_DDL, SCHEMA_VERSION

SOURCES = ["cursor", "claude_code", "codex", "windsurf", "other"]


def _record(ord_: Column, messages: Column, created: Column) -> list[Column]:
    text = F.array_join(F.transform(messages, lambda m: m["content"]), "")
    meta = F.struct(
        F.element_at(F.array(*map(F.lit, SOURCES)), (ord_ % 5 + 1).cast("int")).alias("source"), F.concat(F.lit("proj"), (ord_ % 7).cast("string")).alias("project"), created.alias("created_at"), created.alias("updated_at"), F.lit(None).cast("string").alias("model"),
        F.concat(F.lit("/home/u/.cursor/history-"), ord_.cast("string"), F.lit(".json")).alias("file_path"), first_user_prompt(messages).alias("prompt"), estimate_tokens(text).alias("tokens"), F.lit("high").alias("recognition_confidence"), F.lit(None).cast("array<string>").alias("warnings"),
    )
    return [ord_.alias("ord"), F.lit(SCHEMA_VERSION).alias("schema_version"), ord_.cast("string").alias("thread_id"), F.lit("thread").alias("type"), messages.alias("messages"), F.from_json(F.lit('{"files":[],"diffs":[]}'), CONTEXT_DDL).alias("context"), meta.alias("meta")]


def _day(n: Column) -> Column:
    return F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (n % 5000).cast("int")).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One thread a conversation, messages by turn."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    rows = rows.select("conv_id", F.transform("t", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"), F.lit(None).cast("string").alias("timestamp"), F.lit(None).cast("string").alias("model"))).cast(MESSAGES_DDL).alias("messages"))
    return rows.select(*_record(F.col("conv_id"), F.col("messages"), _day(F.col("conv_id"))))


def doubled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threads, and a later copy of every third."""
    t = threads(spark, sf_dir)
    return t.union(t.where("ord % 3 = 0").withColumn("ord", F.col("ord") + 1_000_000_000))


def stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threads with a time and a model at every other message and no prompt in every fourth; of every third a first
    writing without messages, and the later one with a message more."""
    t = threads(spark, sf_dir)
    odd = lambda i, v: F.when(i % 2 == 0, v)
    messages = F.transform("messages", lambda m, i: m.withField("timestamp", odd(i, F.lit("2024-05-01T00:00:00.000Z"))).withField("model", odd(i, F.lit("model-x"))))
    again = F.array(F.struct(F.lit("user").alias("role"), F.lit("again").alias("content"), F.lit(None).cast("string").alias("timestamp"), F.lit(None).cast("string").alias("model"))).cast(MESSAGES_DDL)
    messages = F.when(F.col("ord") % 3 == 0, F.concat(messages, again)).otherwise(messages)
    prompt = F.when(F.col("ord") % 4 != 1, F.col("meta.prompt"))
    t = t.withColumns({"messages": messages, "meta": F.col("meta").withField("prompt", prompt)})
    early = t.where("ord % 3 = 0").withColumns({"messages": F.expr(f"cast(array() as {MESSAGES_DDL})"), "ord": F.col("ord") - (1 << 40)})
    return t.unionByName(early)


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashed(threads(spark, sf_dir).where("ord % 3 = 0")).select("hash", "sha256", F.col("meta.source").alias("source"), "thread_id", "file")


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as threads of one assistant message, with a phone, a card, an access key and an address planted."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id is not null")
    n = F.col("doc_id")
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" tel "), (F.lit(13800000000) + n).cast("string"), F.lit(" card "), (F.lit(6222000000000000) + n).cast("string"), F.lit(" ip 10.0.3."), (n % 200).cast("string"), F.lit(" key AKIA"), F.lpad(n.cast("string"), 16, "0"), F.lit(" end"))
    text = F.when(n % 4 == 0, F.concat(F.lit("Sure, I can help you with that. "), text)).otherwise(text)
    message = F.array(F.struct(F.lit("assistant").alias("role"), text.alias("content"), F.lit(None).cast("string").alias("timestamp"), F.lit(None).cast("string").alias("model"))).cast(MESSAGES_DDL)
    return d.select(*_record(n, message, _day(n)))


def riddled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planted documents with what every other masker and filler pattern looks for, and a prompt of its own."""
    t = planted(spark, sf_dir)
    n, key = F.col("ord"), F.lpad(F.col("ord").cast("string"), 36, "k")
    some = lambda k, text: F.when(n % k == 0, text).otherwise("")
    block = lambda kind: F.concat(F.lit(f"\n-----BEGIN {kind}-----\nab"), n.cast("string"), F.lit(f"\n-----END {kind}-----\n"))
    text = F.concat(
        F.col("messages")[0]["content"], some(2, F.concat(F.lit(" ghp_"), key, F.lit(" gho_"), key)), some(3, F.concat(F.lit(" sk-"), key, F.lit(" sk-ant-api03-x_"), n.cast("string"))), some(5, F.lit(" bce-v3/Ab/9 ALTAK-x9")), some(7, F.lit(" id 110101199003071234 mail a.b@c.org")),
        some(2, F.lit(" at mysql://u:p@db.example:3306/main and")), some(3, block("RSA PRIVATE KEY")), some(4, block("CERTIFICATE")), some(5, F.lit("\nIf you have any more questions, feel free to ask!")),
    )
    user = F.struct(F.lit("user").alias("role"), F.concat(F.lit("Sure, I can help you with that. mail u@v.org "), F.repeat(F.lit("long "), (n % 1000).cast("int"))).alias("content"), F.lit(None).cast("string").alias("timestamp"), F.lit(None).cast("string").alias("model"))
    messages = F.array(user, F.col("messages")[0].withField("content", text)).cast(MESSAGES_DDL)
    return t.withColumns({"messages": messages, "meta": F.col("meta").withField("prompt", F.concat(F.lit("ask 13912345678 AKIA"), F.lpad(n.cast("string"), 16, "0")))})


def raw_files(spark: SparkSession, sf_dir: str, dialect: int | None = None) -> DataFrame:
    """The threads as raw files in one of four dialects, or in all by ord % 4: JSON messages, JSONL lines, shared
    conversations, Markdown."""
    t = threads(spark, sf_dir)
    pairs = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    shared = F.transform("messages", lambda m: F.struct(F.when(m["role"] == "user", "human").when(m["role"] == "assistant", "gpt").otherwise(m["role"]).alias("from"), m["content"].alias("value")))
    lines = F.array_join(F.transform(pairs, lambda m: F.to_json(m)), "\n")
    md = F.array_join(F.transform("messages", lambda m: F.concat(F.lit("## "), F.initcap(m["role"]), F.lit("\n"), m["content"])), "\n")
    kind = F.col("ord") % 4 if dialect is None else F.lit(dialect)
    content = F.when(kind == 0, F.to_json(F.struct(pairs.alias("messages")))).when(kind == 1, lines).when(kind == 2, F.to_json(F.struct(shared.alias("conversations")))).otherwise(md)
    ending = F.when(kind.isin(0, 2), ".json").when(kind == 1, ".jsonl").otherwise(".md")
    path = F.concat(F.lit("/home/u/.cursor/chat-"), F.col("ord").cast("string"), ending)
    return t.select("ord", path.alias("path"), content.alias("content"), (F.lit(1704067200000) + F.col("ord") * 86400000).cast("double").alias("mtime_ms"), F.octet_length(content).cast("long").alias("size"))


def kv_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threads as key/value items, ten to a database, every fifth under a key of no interest."""
    t = threads(spark, sf_dir)
    pairs = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    key = F.when(F.col("ord") % 5 == 4, F.concat(F.lit("theme."), F.col("ord"))).otherwise(F.concat(F.lit("aiChat."), (F.lit(1704067200000) + F.col("ord")).cast("string")))
    return t.select("ord", F.concat(F.lit("/home/u/Windsurf/db"), F.floor(F.col("ord") / 10).cast("string"), F.lit("/state.vscdb")).alias("db_path"), key.alias("key"), F.to_json(F.struct(pairs.alias("messages"))).alias("value"))

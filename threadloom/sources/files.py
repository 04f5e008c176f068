"""Sources of raw logs and unified records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions.text import trimmed
from threadloom.schema import THREAD

# File endings, ignored folders and names, words of interesting paths and headers, store keys.
ENDINGS = ["json", "jsonl", "md", "txt", "log", "mdc", "cursorrules", "yaml", "yml"]
IGNORED = r"(?i)(^|/)(node_modules|dist|out|resources|static|extensions)/|(^|/)package\.json$|(^|/)tsconfig[^/]*\.json$|\.(tmlanguage|l10n\.json|nls\.json|png|jpg|svg|css|node|vsixmanifest|crx|asar|map)$"
DENIED = (".map", ".ts", ".js", ".html", ".css", ".node", ".vsixmanifest", ".tmlanguage")
PATH_WORDS = ["history", "conversation", "thread", "agent", "plan", "task", "walkthrough", "rules", ".cursorrules", ".mdc", "chat", "convo", "session", "run", "log", "settings", "config", "storage", "mcp", "bubbles", "aichat", "aiservice", "composer", ".jsonl"]
HEADER_WORDS = ["messages", "history", "threads", "conversation", "role", "assistant", "plan", "mcp", "convo", "chat", "session", "bubbles", "aiChat"]
DEEP = [".cursor", ".claude", ".antigravity", ".gemini", ".augment", ".kiro", ".codex", ".opencode", ".qoder", ".codebuddy", ".trae", ".windsurf", ".iflow", ".continue", ".deepseek", ".tongyi", ".devin", ".replit"]
STORE_KEYS = ["composer.composerData", "aiService.generations", "memento/webviewView.augment-chat"]
STORE_PATTERNS = ["%conversation%", "%aiChat%", "%chat%", "%composer%", "%aiService%", "%workbench.panel.aichat%", "%roo-cline%", "%github.copilot%", "%aichat%", "%memento%"]
LARGEST, HEADER, STORE_ROWS = 10 << 20, 512, 2000


def tool_folders(root: str) -> str:
    """A pattern for the tools' own folders in the root, itself a path or pattern ("/home/*"). Spark passes over folders
    whose names begin with a dot, unless a path or pattern names them."""
    return f"{root.rstrip('/')}/{{{','.join(DEEP)}}}"


def raw_columns(files: DataFrame, most: int = LARGEST) -> DataFrame:
    """path, content, mtime_ms, size of binary files of at most so many bytes."""
    return files.where(F.col("length") <= most).select("path", F.decode("content", "UTF-8").alias("content"), F.unix_millis("modificationTime").cast("double").alias("mtime_ms"), F.col("length").alias("size"))


def read_raw_files(spark: SparkSession, *roots: str) -> DataFrame:
    """path, content, mtime_ms, size of every log file below the roots, each a path or a pattern."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(ENDINGS) + "}").load(list(roots))
    return raw_columns(files)


def read_lines(spark: SparkSession, *roots: str, names: str = "*.jsonl") -> DataFrame:
    """path, block, at, line, mtime_ms, size of every line of the JSONL files below the roots, of any size: a file is cut
    into blocks that tasks read side by side, and its lines are in order by block (a byte offset) and at."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", names).option("lineSep", "\n").text(list(roots))
    at = F.col("_metadata")
    return rows.select(at["file_path"].alias("path"), at["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"), F.unix_millis(at["file_modification_time"]).cast("double").alias("mtime_ms"), at["file_size"].alias("size"))


def read_kv_items(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """db_path, key, value of a dump of stores in Spark's format of this name."""
    return spark.read.format(fmt).schema("db_path string, key string, value string").load(path)


def read_threads(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Unified records of a JSON backup, a file each or (lines) a line each; the manifest and unreadable ones are left out."""
    rows = spark.read.schema(THREAD).option("multiLine", not lines).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).json(path)
    return rows.where(F.col("_metadata.file_name") != "manifest.json")


def read_import(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a row: of a .jsonl file each line, of a .json file the array's elements or the object."""
    if path.endswith(".jsonl"):
        rows = spark.read.text(path).select(F.col("value").alias("json"))
        return rows.where(F.try_parse_json("json").isNotNull())
    v = F.try_parse_json("value")
    many = F.try_variant_get(v, "$", "array<variant>")
    rows = spark.read.option("wholetext", True).text(path).where(v.isNotNull())
    return rows.select(F.explode(F.coalesce(F.transform(many, lambda x: F.to_json(x)), F.array("value"))).alias("json"))


def candidate_files(files: DataFrame) -> DataFrame:
    return files.where(~F.col("path").rlike(IGNORED) & (F.col("size") <= LARGEST) & (F.length(trimmed(F.col("content"))) > 0))


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def is_interesting(path: Column, content: Column) -> Column:
    p, head = F.lower(path), F.lower(F.left(content, F.lit(HEADER)))
    denied = F.lit(False)
    for end in DENIED:
        denied = denied | F.endswith(p, F.lit(end))
    denied = denied | _any(p, ["package.json", "tsconfig.json", "node_modules"])
    header = ~F.endswith(p, F.lit(".json")) | (F.coalesce(head, F.lit("")) == "") | _any(head, HEADER_WORDS)
    return ~denied & _any(p, PATH_WORDS) & header


def within_scan_depth(files: DataFrame, rel: str = "rel") -> DataFrame:
    """Adds depth and phase (the first of 4, 6, 8, 10 that reaches the file); deep roots go to 10, others to 6."""
    depth = F.size(F.split(rel, "/"))
    most = F.when(F.col(rel).rlike("^(" + "|".join(d.replace(".", "\\.") for d in DEEP) + ")"), 10).otherwise(6)
    phase = F.when(depth <= 4, 4).when(depth <= 6, 6).when(depth <= 8, 8).otherwise(10)
    return files.withColumns({"depth": depth, "phase": phase}).where(depth <= most).dropDuplicates(["path"])


def kv_key_filter(items: DataFrame) -> DataFrame:
    """Rows of known keys, at most STORE_ROWS a database by key (a limit of the format), then of 10 characters or more."""
    known = F.col("key").isin(STORE_KEYS)
    for pattern in STORE_PATTERNS:
        known = known | F.col("key").ilike(pattern)
    nth = F.row_number().over(Window.partitionBy("db_path").orderBy("key"))
    return items.where(known).withColumn("nth_", nth).where((F.col("nth_") <= STORE_ROWS) & (F.length("value") >= 10)).drop("nth_")

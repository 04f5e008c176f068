"""Validation of unified records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.json_schema import faults

# Allowed types, sources and confidence levels.
TYPES = ["thread", "plan", "task", "walkthrough", "artifact", "mcp", "rule", "config"]
SOURCES = ["cursor", "antigravity", "codex", "augment", "claude_code", "iflow", "trae", "codebuddy", "qoder", "windsurf", "vscode_copilot", "imported", "api_capture", "unknown", "other"]
LEVELS = ["high", "low", "unknown"]

TEXT, OBJECT = {"type": "string"}, {"type": "object"}
_pairs = lambda a, b: {"type": "array", "items": OBJECT | {"properties": {a: TEXT, b: TEXT}}}
# The record's schema.
SCHEMA = OBJECT | {
    "required": ["schema_version", "thread_id", "messages", "meta"],
    "properties": {
        "schema_version": TEXT | {"pattern": r"^\d+\.\d+\.\d+$"},
        "thread_id": TEXT | {"minLength": 1},
        "type": TEXT | {"enum": TYPES},
        "messages": {"type": "array", "items": OBJECT | {"required": ["role", "content"], "properties": {"role": TEXT, "content": TEXT, "timestamp": TEXT, "model": TEXT, "meta": OBJECT}}},
        "context": OBJECT | {"properties": {"files": _pairs("path", "snippet"), "diffs": _pairs("path", "patch")}},
        "meta": OBJECT | {
            "required": ["source", "project", "created_at"],
            "properties": {
                "source": TEXT | {"enum": SOURCES}, "project": TEXT, "created_at": TEXT, "model": {"type": ["string", "null"]}, "file_path": TEXT, "tokens": {"type": "integer", "minimum": 0}, "prompt": TEXT,
                "recognition_confidence": TEXT | {"enum": LEVELS}, "source_detail": TEXT, "tool_version": TEXT, "warnings": {"type": "array", "items": TEXT}, "extra": OBJECT,
            },
        },
    },
}


def validate_json(rows: DataFrame, column: str = "json", schema: dict = SCHEMA) -> DataFrame:
    """Adds errors ("<path> <message>", in the schema's order) and valid to rows of records as JSON text, whatever their types.
    A text that is no JSON has one error, a null text too."""
    v = F.try_parse_json(column)
    errors = F.coalesce(faults(v, schema), F.array(F.lit("(root) must be JSON")))
    return rows.select("*", F.inline(F.array(F.struct(errors.alias("errors"))))).withColumn("valid", F.size("errors") == 0)


def validate_threads(threads: DataFrame, sources: list[str] = SOURCES) -> DataFrame:
    """ord, thread_id, valid, errors ("<path> <message>")."""
    ok = lambda test, text: F.when(~F.coalesce(test, F.lit(False)), F.lit(text))
    tests = [
        ok(F.col("schema_version").rlike(r"^\d+\.\d+\.\d+$"), "/schema_version must match pattern"),
        ok(F.length("thread_id") >= 1, "/thread_id must not have fewer than 1 characters"),
        ok(F.col("type").isNull() | F.col("type").isin(TYPES), "/type must be equal to one of the allowed values"),
        ok(F.col("messages").isNotNull(), "/messages must be array"),
        ok(~F.exists("messages", lambda m: m["role"].isNull() | m["content"].isNull()), "/messages must have role and content"),
        ok(F.col("meta.source").isin(sources), "/meta/source must be equal to one of the allowed values"),
        ok(F.col("meta.project").isNotNull(), "/meta must have required property 'project'"),
        ok(F.col("meta.created_at").isNotNull(), "/meta must have required property 'created_at'"),
        ok(F.col("meta.tokens").isNull() | (F.col("meta.tokens") >= 0), "/meta/tokens must be >= 0"),
        ok(F.col("meta.recognition_confidence").isNull() | F.col("meta.recognition_confidence").isin(LEVELS), "/meta/recognition_confidence must be equal to one of the allowed values"),
    ]
    return threads.select("ord", "thread_id", F.array_compact(F.array(*tests)).alias("errors")).withColumn("valid", F.size("errors") == 0)


def validation_summary(validated: DataFrame) -> DataFrame:
    return validated.agg(F.count("*").alias("total"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"))

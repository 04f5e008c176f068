"""The queries by name, their SQL, and what queries of several modules share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

# The threads of fixtures.py in SQL.
T = """WITH m AS (SELECT conv_id AS ord, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM conversations),
th AS (SELECT ord, CAST(ord AS VARCHAR) AS thread_id, ['cursor','claude_code','codex','windsurf','other'][CAST(ord % 5 + 1 AS INT)] AS source, 'proj' || (ord % 7) AS project,
 strftime(DATE '2024-01-01' + CAST(ord % 5000 AS INT), '%Y-%m-%dT00:00:00.000Z') AS created_at, count(*) AS n, CAST(ceil(sum(length(text)) / 4.0) AS BIGINT) AS tokens,
 coalesce(sum(CASE WHEN role='user' THEN length(text)//4 END),0) AS u, coalesce(sum(CASE WHEN role='assistant' THEN length(text)//4 END),0) AS a, left(arg_min(text, i) FILTER (WHERE role='user'), 120) AS prompt FROM m GROUP BY ord)"""
P = """, p AS (SELECT x.ord, x.i - 1 AS pos, trim(x.text) AS instruction, trim(y.text) AS output FROM m x JOIN m y ON x.ord = y.ord AND y.i = x.i + 1 WHERE x.role='user' AND y.role='assistant' AND length(trim(x.text))>=20 AND length(trim(y.text))>=20)"""
SUMS = "CAST(count(*) AS BIGINT) {0}, CAST(sum(n) AS BIGINT) messages, CAST(sum(tokens) AS BIGINT) tokens, CAST(sum(u) AS BIGINT) user_tokens, CAST(sum(a) AS BIGINT) ai_tokens, CAST(max(a) AS BIGINT) max_ai, CAST(max(u) AS BIGINT) max_user, CAST(count(*) AS BIGINT) high, CAST(0 AS BIGINT) low, CAST(0 AS BIGINT) unknown"
DOC = "WITH d AS (SELECT doc_id, (CASE WHEN doc_id % 4 = 0 THEN 'Sure, I can help you with that. ' ELSE '' END) || coalesce(text,'') || ' tel ' || (13800000000 + doc_id) || ' card ' || (6222000000000000 + doc_id) || ' ip 10.0.3.' || (doc_id % 200) || ' key AKIA' || lpad(CAST(doc_id AS VARCHAR),16,'0') || ' end' AS t FROM documents WHERE doc_id IS NOT NULL)"


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir; only where that is unset (tests on one machine) a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}" if base else tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp") + f"/{name}"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register

"""Queries over every line dialect, JSON shape and store shape.

A table lists, for each, how a message is written and what must come out of it: "@" stands for a message's text as JSON,
"#" for its role, {} for the text and {j} for the text as JSON in what comes out. All messages (or threads) of the
conversations are dealt to the dialects in turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import extract
from threadloom.plans import fixtures as fx
from threadloom.plans.registry import T, query

AT, AT_SQL = '"timestamp":"2024-05-01T00:00:00Z"', "2024-05-01T00:00:00Z"
# Line, (role, content) of its messages, and whether they keep the line's time.
LINES: list[tuple[str, list[tuple[str, str]], bool]] = [
    ('{"sessionId":"s","type":"x","message":{"role":"assistant","content":"@"},%}', [("assistant", "{}")], True),
    ('{"sessionId":"s","type":"x","message":{"role":"tool","content":["a",{"type":"text","text":"@"},{"type":"tool_result","content":"@"},{"type":"text"},{"k":"@"}]},%}', [("user", 'a\n{}\n{}\n{"type":"text"}\n{"k":{j}}')], True),
    ('{"role":"user","content":"@",%}', [("user", "{}")], False),
    ('{"role":"assistant","text":"@"}', [("assistant", "{}")], False),
    ('{"role":"user","content":null}', [("user", "")], False),
    ('{"messages":[{"role":"user","content":"@"},{"text":"@"},{"role":"assistant"}]}', [("user", "{}"), ("unknown", "{}"), ("assistant", "")], False),
    ('{"instruction":"@","input":"i","output":"@"}', [("user", "{}\ni"), ("assistant", "{}")], False),
    ('{"instruction":"","output":"@"}', [("assistant", "{}")], False),
    ('{"type":"response_item","payload":{"type":"message","role":"user","content":[{"text":"@"},{"text":"b"},{"k":1}]},%}', [("user", "{}b")], True),
    ('{"type":"response_item","payload":{"type":"message","role":"developer","content":"@"},%}', [("assistant", "{}")], True),
    ('{"type":"response_item","payload":{"type":"reasoning","content":"@"},%}', [], True),
    ('{"type":"function_call","name":"f","arguments":"@",%}', [("assistant", "[Function Call] f({})")], True),
    ('{"type":"function_call_output","output":"@",%}', [("user", "[Function Output] {}")], True),
    ('{"type":"function_call_output","output":null,%}', [("user", "[Function Output] null")], True),
    ('{"type":"custom_tool_call","name":"@",%}', [("assistant", "[Tool Call] {}")], True),
    ('{"type":"custom_tool_call_output","output":"@",%}', [("user", "[Tool Output] {}")], True),
    ('{"type":"reasoning","content":"@",%}', [("assistant", "[Reasoning] {}")], True),
    ('{"type":"agent_reasoning","reasoning":"@",%}', [("assistant", "[Reasoning] {}")], True),
    ('{"type":"reasoning","summary":"@",%}', [], True),
    ('{"type":"summary_text","content":"@",%}', [("assistant", "[Summary] {}")], True),
    ('{"type":"event_msg","payload":{"type":"tool_use","name":"@"},%}', [("assistant", "[Tool Use] {}")], True),
    ('{"type":"event_msg","payload":{"type":"token_count","name":"@"},%}', [], True),
    ('{"type":"session_meta","payload":{"name":"@"},%}', [], True),
    ('{"type":"input_text","text":"@",%}', [("user", "{}")], True),
    ('{"type":"canvas","content":"@",%}', [("assistant", "[Canvas] {}")], True),
    ('{"type":"canvas","canvas_data":{"code":"@","language":"py","html":"h","css":"c","description":"d"},%}', [("assistant", "[Canvas]\n\n```py\n{}\n```\n[HTML]\nh\n[CSS]\nc\n\nDescription: d")], True),
    ('{"type":"artifact","artifact":"@",%}', [("assistant", "[Artifact] {}")], True),
    ('{"type":"artifact","artifact":{"type":"t","title":"n","content":"@","code":"d","generated_file":"f"},%}', [("assistant", "[Artifact] Type: t\nTitle: n\n\n{}\n```\nd\n```\nGenerated: f")], True),
    ('{"type":"computer_call","name":"c","input":{"a":"@"},%}', [("assistant", '[Computer Action] c\n{\n  "a": {j}\n}')], True),
    ('{"type":"computer_call","action":"c","arguments":"@",%}', [("assistant", "[Computer Action] c\n{}")], True),
    ('{"type":"computer_call_output","output":{"a":"@"},%}', [("user", '[Computer Output] {\n  "a": {j}\n}')], True),
    ('{"type":"computer_call_output","output":"@",%}', [("user", "[Computer Output] {}")], True),
    ('{"type":"tool_use","name":"t","input":{"a":["@",1]},%}', [("assistant", '[Tool Use] t\n{\n  "a": [\n    {j},\n    1\n  ]\n}')], True),
    ('{"type":"tool_use","name":"t","input":"@",%}', [("assistant", "[Tool Use] t\n{j}")], True),
    ('{"type":"tool_use","name":"@",%}', [("assistant", "[Tool Use] {}\n")], True),
    ('{"type":"tool_result","content":"@",%}', [("user", "[Tool Result] {}")], True),
    ('{"type":"tool_result","output":"@","is_error":1,%}', [("user", "[Tool Error] {}")], True),
    ('{"type":"tool_result","content":"@","is_error":false,"error":"e",%}', [("user", "[Tool Error] {}")], True),
    ('{"type":"mcp_tool_call","tool":"m","arguments":{"a":"@"},%}', [("assistant", '[MCP Tool Call] m\n{\n  "a": {j}\n}')], True),
    ('{"type":"mcp_tool_call","name":"m","args":"@",%}', [("assistant", "[MCP Tool Call] m\n{}")], True),
    ('{"type":"mcp_tool_result","result":"@",%}', [("user", "[MCP Result] {}")], True),
    ('{"type":"attachment","name":"n","url":"@",%}', [("user", "[Attachment: attachment] {}")], True),
    ('{"type":"attachment","file":"@","url":"u",%}', [("user", "[Attachment: attachment] {}")], True),
    ('{"type":"attachment","name":"@",%}', [], True),
    ('{"type":"image_url","image_url":"@",%}', [("user", "[Image] {}")], True),
    ('{"type":"code_execution","language":"py","code":"@","output":"@",%}', [("assistant", "[Code Execution]\n```\n{}\n```"), ("user", "[Execution Output]\n{}")], True),
    ('{"type":"web_search","query":"@","results":"r",%}', [("assistant", "[Web Search] {}"), ("user", "[Web Results]\nr")], True),
    ('{"type":"web_fetch","url":"u","content":"@",%}', [("assistant", "[Web Fetch] u"), ("user", "[Web Results]\n{}")], True),
    ('{"type":"thinking","thinking":"@",%}', [("assistant", "[Thinking] {}")], True),
    ('{"type":"internal_thought","thought":"@",%}', [("assistant", "[Thinking] {}")], True),
    ('{"type":"thinking","signature":"@",%}', [], True),
    ('{"type":"system","content":"@",%}', [("system", "{}")], True),
    ('{"type":"message_create","message":{"role":"user","content":{"a":"@"}},%}', [("user", '{"a":{j}}')], True),
    ('{"type":"response","content":[{"type":"text","text":"@"},{"type":"tool_use","name":"t","input":{"a":"@"}},{"type":"tool_result","content":"@","is_error":1},{"type":"other","text":"@"}],%}', [("assistant", "{}"), ("assistant", '[Tool Use] t\n{\n  "a": {j}\n}'), ("user", "[Tool Error] {}")], True),
    ('{"type":"response","content":[{"type":"thinking","thinking":"@"},{"type":"reasoning","reasoning":"@"},{"type":"image","url":"u"},{"type":"resource","resource":"@"},{"type":"artifact","artifact":"@"},{"type":"canvas","canvas":{"content":"@"}}],%}', [("assistant", "[Thinking] {}"), ("assistant", "[Reasoning] {}"), ("user", "[Image] u"), ("system", "[Resource] {}"), ("assistant", "[Artifact] {}"), ("assistant", "[Canvas] {}")], True),
    ('{"type":"response","response":{"content":[{"type":"text","text":"@"}]},%}', [], True),
    ('{"type":"nobody","content":"@",%}', [], True),
]


def quoted(text: Column) -> Column:
    """A text as JSON."""
    return F.substring(F.to_json(F.array(text)), F.lit(2), F.length(F.to_json(F.array(text))) - 2)


def written(template: Column, text: Column, role: Column) -> Column:
    return F.replace(F.replace(template, F.lit('"@"'), quoted(text)), F.lit('"#"'), quoted(role))


def dealt(texts: list[str], turn: Column) -> Column:
    return F.get(F.array(*map(F.lit, texts)), F.pmod(turn, F.lit(len(texts))).cast("int"))


def sql_text(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def filled_sql(template: str, text: str = "text") -> str:
    return f"replace(replace({template}, '{{j}}', CAST(to_json({text}) AS VARCHAR)), '{{}}', {text})"


LINES_SQL = T + ", e(k, pos, role, tmpl, ts) AS (VALUES " + ", ".join(f"({k}, {at}, {sql_text(role)}, {sql_text(tmpl)}, {sql_text(AT_SQL if keeps else None)})" for k, (_, out, keeps) in enumerate(LINES) for at, (role, tmpl) in enumerate(out)) + ")"


@query(LINES_SQL + f" SELECT ord, CAST(i - 1 AS INT) AS line, CAST(pos AS INT) AS at, e.role, {filled_sql('tmpl')} AS content, ts AS \"timestamp\" FROM m JOIN e ON k = (ord * 7 + i - 1) % {len(LINES)} WHERE text <> ''")
def jsonl_dialects(spark: SparkSession, d: str) -> DataFrame:
    """Every message of the conversations as a line of one of the dialects, and the messages that come out."""
    rows = fx.threads(spark, d).select("ord", F.posexplode("messages").alias("i", "m")).where("m.content <> ''")
    line = written(dealt([x[0].replace("%", AT) for x in LINES], F.col("ord") * 7 + F.col("i")), F.col("m.content"), F.col("m.role"))
    got = extract.line_rows(rows.select("ord", F.col("i").alias("line_no"), line.alias("line")))
    return got.select("ord", F.col("line_no").alias("line"), F.posexplode("messages").alias("at", "m")).select("ord", "line", "at", "m.role", "m.content", "m.timestamp")


AI, KEEP = "CASE role WHEN 'assistant' THEN 'assistant' ELSE 'user' END", "role"
# "%" is ai for an assistant's message, else human; "~" the message's number. Opening, message, closing of a JSON file; role, content, time and model that come out in SQL; confidence.
SHAPES: list[tuple[str, str, str, str, str, str | None, str | None, str]] = [
    ('{"tabs":[{"bubbles":[', '{"type":"%","rawText":"@","timingInfo":{"clientStartTime":"2024"}}', "]},{}]}", AI, "text", "2024", None, "high"),
    ('{"tabs":[{"bubbles":[', '{"type":"%","text":"@"}', "]}]}", AI, "text", None, None, "high"),
    ('{"composerData":{"conversation":[', '{"type":"%","text":"@","timestamp":"2024"}', "]}}", AI, "text", "2024", None, "high"),
    ('{"composerData":{"conversation":[', '{"role":"#","content":["@"]}', "]}}", KEEP, "'[' || to_json(text) || ']'", None, None, "high"),
    ('{"messages":[', '{"role":"#","content":"@","timestamp":"2024","model":"m"}', '],"sessionId":"s"}', KEEP, "text", "2024", "m", "high"),
    ('{"messages":[', '{"role":"#","content":{"a":"@"}}', "]}", KEEP, "'{\"a\":' || to_json(text) || '}'", None, None, "high"),
    ('{"conversation":[', '{"role":"#","content":"@","timestamp":"2024","model":"m"}', "]}", KEEP, "text", None, None, "high"),
    ('{"history":[', '{"role":"#","content":"@","timestamp":"2024"}', "]}", KEEP, "text", None, None, "high"),
    ('{"conversations":[', '{"from":"#","value":"@"}', "]}", KEEP, "text", None, None, "high"),
    ("[", '{"role":"#","content":"@","text":"t"}', "]", KEEP, "text", None, None, "low"),
    ("[", '{"role":"#","content":{"a":1},"text":"@"}', "]", KEEP, "text", None, None, "low"),
    ('{"convo":[', '{"role":"#","text":"@"}', "]}", KEEP, "text", None, None, "low"),
    ('{"threads":[{"messages":[', '{"role":"#","content":["@"]}', "]}]}", KEEP, "'[' || to_json(text) || ']'", None, None, "low"),
    ('{"threads":[{"messages":[', '{"text":"@"}', "]}]}", "'unknown'", "text", None, None, "low"),
]


def _files(spark: SparkSession, d: str, shapes: list[tuple]) -> DataFrame:
    """Threads with the text of their file, in a shape by turn."""
    part = lambda at: dealt([s[at] for s in shapes], F.col("ord"))
    kind = lambda m: F.when(m["role"] == "assistant", "ai").otherwise("human")
    one = lambda m, i: F.replace(F.replace(part(1), F.lit('"%"'), F.concat(F.lit('"'), kind(m), F.lit('"'))), F.lit('"~"'), F.concat(F.lit('"'), i.cast("string"), F.lit('"')))
    middle = F.array_join(F.transform("messages", lambda m, i: written(one(m, i), m["content"], m["role"])), ",")
    return fx.threads(spark, d).select("ord", F.concat(part(0), middle, part(2)).alias("content"))


def _cases(shapes: list[tuple], at: int, literal: bool = False) -> str:
    return f"CASE ord % {len(shapes)} " + " ".join(f"WHEN {k} THEN {sql_text(s[at]) if literal else s[at]}" for k, s in enumerate(shapes)) + " END"


@query(T + f" SELECT ord, CAST(i - 1 AS INT) AS at, {_cases(SHAPES, 3)} AS role, {_cases(SHAPES, 4)} AS content, {_cases(SHAPES, 5, True)} AS \"timestamp\", {_cases(SHAPES, 6, True)} AS model, {_cases(SHAPES, 7, True)} AS confidence FROM m")
def json_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Every conversation as a JSON file of one of the shapes, and the messages that come out."""
    got = extract.extract_json(_files(spark, d, SHAPES))
    return got.select("ord", "confidence", F.posexplode("messages").alias("at", "m")).select("ord", "at", "m.role", "m.content", "m.timestamp", "m.model", "confidence")


MS, ISO = "1714521600000", "2024-05-01T00:00:00.000Z"
LATER_MS, LATER = "1714608000000", "2024-05-02T00:00:00.000Z"
TABS = 2  # which of the store shapes has a message of its own before and behind the thread's
# Opening, message, closing of a store's value; role, content and time that come out in SQL; key; created and updated.
STORES: list[tuple[str, str, str, str, str, str | None, str, str, str]] = [
    (f'{{"allComposers":[{{"name":"n"}},{{"createdAt":{MS},"lastUpdatedAt":1,"conversation":[', '{"type":"%","text":"@"}', f'],"k":1}},{{"createdAt":1,"lastUpdatedAt":{LATER_MS},"conversation":[]}}]}}', AI, "text", None, "composer.composerData", ISO, LATER),
    ('{"composerData":{"conversation":[', f'{{"role":"#","content":"","text":"@","timestamp":"{ISO}"}}', "]}}", KEEP, "text", ISO, "chat.x", ISO, ISO),
    ('{"tabs":[{"bubbles":[{"type":"ai","rawText":"first","timingInfo":{"clientStartTime":' + MS + '}}]},{"bubbles":[', '{"type":"%","text":"@"}', ']},{"bubbles":[{"type":"user","rawText":"last","timingInfo":{"clientStartTime":' + LATER_MS + "}}]}]}", AI, "text", None, "chat.y", ISO, LATER),
    ('{"messages":[', f'{{"role":"#","content":["@"],"timestamp":"{ISO}"}}', "]}", KEEP, "'[' || to_json(text) || ']'", ISO, "chat.z", ISO, ISO),
    ('{"conversation":[', '{"type":"%","rawText":"@"}', "]}", AI, "text", None, f"aiChat.{MS}", ISO, ISO),
    ('{"convo":[', '{"role":"#","text":"@"}', "]}", KEEP, "text", None, f"aiChat.{LATER_MS}", LATER, LATER),
    ('{"taskHistory":[', '{"role":"#","text":"@","task":"t","ts":1714521600}', "]}", KEEP, "text", ISO, f"roo-cline.{LATER_MS}", LATER, ISO),
    ("{", '"~":{"textDescription":"@","unixMs":' + MS + "}", "}", "CASE WHEN i = 1 THEN 'user' ELSE 'assistant' END", "text", ISO, "aiService.generations", ISO, ISO),
]
OTHERS = f" UNION ALL SELECT ord, CAST(0 AS INT), 'assistant', 'first', NULL, '{ISO}', '{LATER}' FROM th WHERE ord % {len(STORES)} = {TABS} UNION ALL SELECT ord, CAST(n + 1 AS INT), 'user', 'last', NULL, '{ISO}', '{LATER}' FROM th WHERE ord % {len(STORES)} = {TABS}"


@query(T + f" SELECT ord, CAST(i - 1 + (CASE WHEN ord % {len(STORES)} = {TABS} THEN 1 ELSE 0 END) AS INT) AS at, {_cases(STORES, 3)} AS role, {_cases(STORES, 4)} AS content, {_cases(STORES, 5, True)} AS \"timestamp\", {_cases(STORES, 7, True)} AS created_at, {_cases(STORES, 8, True)} AS updated_at FROM m" + OTHERS)
def kv_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Every conversation as a store's value of one of the shapes, and the messages and times of its record."""
    path = F.concat(F.lit("/home/u/Cursor/"), F.col("ord").cast("string"), F.lit("/state.vscdb"))
    rows = _files(spark, d, STORES).select(path.alias("db_path"), dealt([s[6] for s in STORES], F.col("ord")).alias("key"), F.col("content").alias("value"))
    got = extract.normalize_kv(rows).select(F.regexp_extract("meta.file_path", "([0-9]+)/state", 1).cast("long").alias("ord"), "meta.created_at", "meta.updated_at", F.posexplode("messages").alias("at", "m"))
    return got.select("ord", "at", "m.role", "m.content", "m.timestamp", "created_at", "updated_at")

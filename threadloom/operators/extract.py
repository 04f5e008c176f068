"""Dialects of logs to messages: JSONL lines, JSON objects, Markdown and key/value items.

Text is parsed once into VARIANT; each dialect is an ordered CASE over it. The one Python helper prints nested JSON
with indents, which VARIANT can't, and is called for the few line types that carry it.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions import classify
from threadloom.functions.text import BLANK_CLASS, estimate_tokens, filled, iso_time, trimmed
from threadloom.schema import CONTEXT_DDL, MESSAGES_DDL, SCHEMA_VERSION

NONE = f"cast(array() as {MESSAGES_DDL})"
TALK_TYPES = ("thread", "plan", "task", "walkthrough", "artifact")  # what is no record without messages


@F.pandas_udf(T.StringType())
def _pretty(values: pd.Series) -> pd.Series:
    def one(text):
        try:
            return json.dumps(json.loads(text), indent=2, ensure_ascii=False)
        except (TypeError, ValueError):
            return text

    return values.map(one)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _pretty_each(values: pd.Series) -> pd.Series:
    def one(texts):
        out = []
        for t in texts if texts is not None else ():
            try:
                out.append(json.dumps(json.loads(t), indent=2, ensure_ascii=False))
            except (TypeError, ValueError):
                out.append(t)
        return out

    return values.map(one)


def get(v: Column, path: str) -> Column:
    """A field as text: strings as they are, anything else as JSON; missing or null: null."""
    return F.try_variant_get(v, f"$.{path}", "string")


def items(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}" if path else "$", "array<variant>")


def _is_text(v: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{path}" if path else "$", "variant")) == "STRING", F.lit(False))


def _or(*values: Column) -> Column:
    return F.coalesce(*[filled(x) for x in values])


def defined(v: Column, path: str) -> Column:
    """Whether the field is there, be it null."""
    return F.try_variant_get(v, f"$.{path}", "variant").isNotNull()


def shown(v: Column, path: str) -> Column:
    """A field that is there as text; null as the word."""
    return F.coalesce(get(v, path), F.when(defined(v, path), "null"))


def is_true(v: Column, path: str) -> Column:
    """Whether the field counts as true: there, and not null, false, zero or an empty text."""
    return F.coalesce(~get(v, path).isin("", "false", "0") | (_is_text(v, path) & (get(v, path) != "")), F.lit(False))


def text_or_json(v: Column, path: str = "content", other: str = "text") -> Column:
    """A field if it is a text, else the other field, else the field as JSON, else nothing."""
    return F.when(_is_text(v, path), get(v, path)).otherwise(F.coalesce(_or(get(v, other), get(v, path)), F.lit("")))


def as_time(value: Column) -> Column:
    """Milliseconds or a date as an ISO time."""
    return F.when(value.rlike(r"^-?\d+(\.\d+)?$"), iso_time(value.try_cast("double"))).otherwise(F.date_format(F.try_to_timestamp(value), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def _text(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def message(role, content: Column, timestamp: Column | None = None, model: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(_text(role).alias("role"), content.alias("content"), (null if timestamp is None else timestamp).alias("timestamp"), (null if model is None else model).alias("model"))


def flatten_content(v: Column, path: str = "content") -> Column:
    """Text, or the text and tool result parts of an array joined by newlines, or JSON."""
    told = lambda p, kind, f: (get(p, "type") == kind) & _or(get(p, f)).isNotNull()
    part = lambda p: F.when(told(p, "text", "text"), get(p, "text")).when(told(p, "tool_result", "content"), get(p, "content")).otherwise(F.try_variant_get(p, "$", "string"))
    return F.coalesce(F.array_join(F.transform(items(v, path), part), "\n"), get(v, path))


def canvas_text(v: Column) -> Column:
    """A canvas item: its text, else what canvas_data holds, else JSON."""
    part = lambda before, field, after="": F.coalesce(F.concat(F.lit(before), _or(get(v, f"canvas_data.{field}")), F.lit(after)), F.lit(""))
    language = F.coalesce(_or(get(v, "canvas_data.language")), F.lit("text"))
    code = F.coalesce(F.concat(F.lit("\n```"), language, F.lit("\n"), _or(get(v, "canvas_data.code")), F.lit("\n```")), F.lit(""))
    data = trimmed(F.concat(F.lit("[Canvas]\n"), code, part("\n[HTML]\n", "html"), part("\n[CSS]\n", "css"), part("\n\nDescription: ", "description")))
    return F.when(_is_text(v, "content"), F.concat(F.lit("[Canvas] "), get(v, "content"))).when(_or(get(v, "canvas_data")).isNotNull(), data).otherwise(F.try_variant_get(v, "$", "string"))


def artifact_text(v: Column) -> Column:
    """The artifact of an item: a text, or type, title, content, code and file."""
    part = lambda before, field, after="": F.coalesce(F.concat(F.lit(before), _or(get(v, f"artifact.{field}")), F.lit(after)), F.lit(""))
    whole = F.concat(F.lit("[Artifact] "), part("Type: ", "type", "\n"), part("Title: ", "title", "\n"), part("\n", "content"), part("\n```\n", "code", "\n```"), part("\nGenerated: ", "generated_file"))
    return F.when(_is_text(v, "artifact"), F.concat(F.lit("[Artifact] "), get(v, "artifact"))).otherwise(trimmed(whole))


def response_items(v: Column, inputs: Column) -> Column:
    """Messages of a response line's content[]; inputs: the items' inputs as indented JSON. Items of other kinds give none."""
    def one(p: Column, i: Column) -> Column:
        kind, yes = get(p, "type"), lambda f: _or(get(p, f)).isNotNull()
        tagged = lambda tag, f: F.concat(F.lit(f"[{tag}] "), get(p, f))
        text = (
            F.when((kind == "text") & yes("text"), get(p, "text")).when((kind == "tool_use") & yes("name"), F.concat(F.lit("[Tool Use] "), get(p, "name"), F.lit("\n"), F.coalesce(F.get(inputs, i), F.lit(""))))
            .when((kind == "tool_result") & defined(p, "content"), F.concat(F.when(is_true(p, "is_error"), "[Tool Error] ").otherwise("[Tool Result] "), shown(p, "content")))
            .when((kind == "thinking") & yes("thinking"), tagged("Thinking", "thinking")).when((kind == "reasoning") & yes("reasoning"), tagged("Reasoning", "reasoning"))
            .when(kind.isin("image", "image_url"), F.concat(F.lit("[Image] "), F.coalesce(_or(get(p, "url"), get(p, "image_url")), F.lit("undefined")))).when((kind == "resource") & yes("resource"), tagged("Resource", "resource"))
            .when((kind == "artifact") & yes("artifact"), artifact_text(p)).when((kind == "canvas") & yes("canvas"), canvas_text(F.try_variant_get(p, "$.canvas", "variant")))
        )
        role = F.when(kind.isin("tool_result", "image", "image_url"), "user").when(kind == "resource", "system").otherwise("assistant")
        return message(role, text)

    return F.filter(F.transform(items(v, "content"), one), lambda m: F.coalesce(m["content"], F.lit("")) != "")


def line_messages(v: Column, pretty: dict[str, Column]) -> Column:
    """Messages of one parsed JSONL line: the first dialect that fits."""
    t, ts = get(v, "type"), _or(get(v, "timestamp"))
    yes = lambda f: _or(get(v, f)).isNotNull()
    has = lambda f: defined(v, f)
    nested = lambda f: F.coalesce(pretty[f], F.lit(""))
    say = lambda role, *parts: F.array(message(role, F.concat(*map(_text, parts)), ts))
    bare = lambda role, content: F.array(message(role, content))
    user = lambda f: F.when(f == "user", "user").otherwise("assistant")
    ask = F.concat(get(v, "instruction"), F.coalesce(F.concat(F.lit("\n"), _or(get(v, "input"))), F.lit("")))
    pair = lambda a, b: F.array_compact(F.array(a, b))
    parts = F.coalesce(F.array_join(F.transform(items(v, "payload.content"), lambda p: F.coalesce(get(p, "text"), F.lit(""))), ""), get(v, "payload.content"))
    query = _or(get(v, "query"), get(v, "url"))
    found = _or(get(v, "results"), get(v, "content"))
    dialects = [
        (yes("sessionId") & yes("type") & yes("message.role"), F.array(message(F.when(get(v, "message.role") == "assistant", "assistant").otherwise("user"), flatten_content(v, "message.content"), ts))),
        (yes("role") & (has("content") | has("text")), bare(get(v, "role"), F.coalesce(get(v, "content"), get(v, "text"), F.lit("")))),
        (items(v, "messages").isNotNull(), F.transform(items(v, "messages"), lambda m: message(F.coalesce(_or(get(m, "role")), F.lit("unknown")), F.coalesce(get(m, "content"), get(m, "text"), F.lit(""))))),
        (has("instruction"), pair(F.when(yes("instruction"), message("user", ask)), F.when(yes("output"), message("assistant", get(v, "output"))))),
        ((t == "response_item") & yes("payload.content"), F.filter(F.array(message(user(get(v, "payload.role")), F.when(get(v, "payload.type") == "message", parts), ts)), lambda m: F.coalesce(m["content"], F.lit("")) != "")),
        ((t == "function_call") & yes("name") & yes("arguments"), say("assistant", "[Function Call] ", get(v, "name"), "(", get(v, "arguments"), ")")),
        ((t == "function_call_output") & has("output"), say("user", "[Function Output] ", shown(v, "output"))),
        ((t == "custom_tool_call") & yes("name"), say("assistant", "[Tool Call] ", get(v, "name"))),
        ((t == "custom_tool_call_output") & yes("output"), say("user", "[Tool Output] ", get(v, "output"))),
        (t.isin("reasoning", "agent_reasoning") & (yes("content") | yes("reasoning")), say("assistant", "[Reasoning] ", _or(get(v, "content"), get(v, "reasoning")))),
        ((t == "summary_text") & yes("content"), say("assistant", "[Summary] ", get(v, "content"))),
        ((t == "event_msg") & yes("payload"), F.when((get(v, "payload.type") == "tool_use") & yes("payload.name"), say("assistant", "[Tool Use] ", get(v, "payload.name"))).otherwise(F.expr(NONE))),
        ((t == "session_meta") & yes("payload"), F.expr(NONE)),
        ((t == "input_text") & yes("text"), say("user", get(v, "text"))),
        ((t == "canvas") & (yes("content") | yes("canvas_data")), say("assistant", canvas_text(v))),
        ((t == "artifact") & yes("artifact"), say("assistant", artifact_text(v))),
        ((t == "computer_call") & (yes("name") | yes("action")), say("assistant", "[Computer Action] ", _or(get(v, "name"), get(v, "action")), "\n", F.coalesce(_or(pretty["input"], get(v, "arguments")), F.lit("")))),
        ((t == "computer_call_output") & has("output"), say("user", "[Computer Output] ", nested("output"))),
        ((t == "tool_use") & yes("name"), say("assistant", "[Tool Use] ", get(v, "name"), "\n", nested("input"))),
        ((t == "tool_result") & (has("content") | has("output")), say("user", F.when(is_true(v, "is_error") | is_true(v, "error"), "[Tool Error] ").otherwise("[Tool Result] "), F.coalesce(_or(get(v, "content"), get(v, "output")), F.lit("")))),
        ((t == "mcp_tool_call") & (yes("tool") | yes("name")), say("assistant", "[MCP Tool Call] ", _or(get(v, "tool"), get(v, "name")), "\n", F.coalesce(_or(pretty["arguments"], get(v, "args")), F.lit("")))),
        ((t == "mcp_tool_result") & has("result"), say("user", "[MCP Result] ", nested("result"))),
        ((t == "attachment") & (yes("file") | yes("image_url") | yes("url")), say("user", "[Attachment: attachment] ", _or(get(v, "file"), get(v, "image_url"), get(v, "url")))),
        (t.isin("image", "image_url") & (yes("url") | yes("image_url")), say("user", "[Image] ", _or(get(v, "url"), get(v, "image_url.url"), get(v, "image_url")))),
        ((t == "code_execution") & has("code"), pair(message("assistant", F.concat(F.lit("[Code Execution]\n```\n"), shown(v, "code"), F.lit("\n```")), ts), F.when(has("output"), message("user", F.concat(F.lit("[Execution Output]\n"), shown(v, "output")), ts)))),
        (t.isin("web_search", "web_fetch") & query.isNotNull(), pair(message("assistant", F.concat(F.when(t == "web_search", "[Web Search] ").otherwise("[Web Fetch] "), query), ts), F.when(found.isNotNull(), message("user", F.concat(F.lit("[Web Results]\n"), found), ts)))),
        (t.isin("thinking", "internal_thought") & (yes("thinking") | yes("thought") | yes("content")), say("assistant", "[Thinking] ", _or(get(v, "thinking"), get(v, "thought"), get(v, "content")))),
        ((t == "system") & yes("content"), say("system", get(v, "content"))),
        ((t == "message_create") & yes("message.role") & yes("message.content"), F.array(message(get(v, "message.role"), get(v, "message.content"), ts))),
        ((t == "response") & items(v, "content").isNotNull(), F.transform(response_items(v, pretty["inputs"]), lambda m: m.withField("timestamp", ts))),
    ]
    out = F.expr(NONE)
    for test, value in reversed(dialects):
        out = F.when(F.coalesce(test, F.lit(False)), value.cast(MESSAGES_DDL)).otherwise(out)
    return out


def line_rows(lines: DataFrame) -> DataFrame:
    """Adds messages and bad (doesn't parse) to rows with a line; blank lines go. No shuffle."""
    v = F.col("v_")
    lines = lines.where(F.length(trimmed(F.col("line"))) > 0).withColumn("v_", F.try_parse_json("line"))
    typed = get(v, "type").isin("computer_call", "computer_call_output", "tool_use", "mcp_tool_call", "mcp_tool_result")
    as_json = lambda f: F.to_json(F.try_variant_get(v, f"$.{f}", "variant"))
    nested = {f: F.when(typed & is_true(v, f), as_json(f)) for f in ("input", "arguments")}
    nested |= {f: F.when(typed, F.when(_is_text(v, f), get(v, f)).otherwise(as_json(f))) for f in ("output", "result")}
    lines = lines.withColumns({f"p_{f}": F.when(F.startswith(c, F.lit("{")) | F.startswith(c, F.lit("[")), _pretty(c)).otherwise(c) for f, c in nested.items()})
    uses = F.when(get(v, "type") == "response", F.transform(items(v, "content"), lambda p: F.when((get(p, "type") == "tool_use") & is_true(p, "input"), F.to_json(F.try_variant_get(p, "$.input", "variant")))))
    lines = lines.withColumn("p_inputs", _pretty_each(uses))
    names = [f"p_{f}" for f in (*nested, "inputs")]
    pretty = {n[2:]: F.col(n) for n in names}
    messages = F.get(F.transform(F.array(v), lambda x: line_messages(x, pretty)), F.lit(0))  # in a lambda, as its code would take long to compile
    return lines.withColumns({"messages": messages, "bad": v.isNull()}).drop("v_", *names)


def _in_order(rows: DataFrame, *keys: str) -> DataFrame:
    got = rows.groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct("at", "messages", "bad"))).alias("m"))
    return got.select(*keys, F.flatten("m.messages").alias("messages"), F.size(F.filter("m", lambda x: x["bad"])).cast("long").alias("bad"))


def extract_jsonl(files: DataFrame) -> DataFrame:
    """path, text (a hash of the content), messages and bad (lines that don't parse) of each file with a line. Lines go
    through the extractor as rows and come back in order by path and text; files of one path and text are one. For files
    that are too large for one string see extract_lines."""
    lines = files.select("path", F.xxhash64("content").alias("text"), F.posexplode(F.split("content", "\n")).alias("at", "line"))
    return _in_order(line_rows(lines), "path", "text")


def extract_lines(lines: DataFrame) -> DataFrame:
    """path, messages and bad of each file of sources.read_lines: as extract_jsonl gives them, though a file is read by many
    tasks and never is one string. Lines of a block of a file come together first, so a file's group holds an array a block."""
    blocks = _in_order(line_rows(lines.select("path", "block", "at", "line")), "path", "block")
    got = blocks.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("block", "messages"))).alias("m"), F.sum("bad").alias("bad"))
    return got.select("path", F.flatten("m.messages").alias("messages"), "bad")


def line_message_rows(lines: DataFrame) -> DataFrame:
    """path, block, at, pos and the message's fields, a row a message: for files too large for one record. They are in
    order by path, block, at and pos; nothing is shuffled."""
    rows = line_rows(lines.select("path", "block", "at", "line"))
    return rows.select("path", "block", "at", F.posexplode("messages").alias("pos", "m")).select("path", "block", "at", "pos", "m.*")


def json_shapes(v: Column) -> list[tuple[Column, Column, str]]:
    """Test, messages and confidence of each shape of a JSON file's value, in order."""
    there = lambda p: F.try_variant_get(v, f"$.{p}", "variant").isNotNull()
    yes = lambda p: _or(get(v, p)).isNotNull()
    role = lambda m: F.coalesce(_or(get(m, "role")), F.lit("unknown"))
    ts = lambda m: _or(get(m, "timestamp"))
    full = lambda m: message(role(m), F.coalesce(get(m, "content"), F.lit("")), ts(m), _or(get(m, "model")))
    plain = lambda m: message(role(m), F.coalesce(get(m, "content"), F.lit("")))
    loose = lambda m: message(role(m), text_or_json(m))
    ai = lambda m: F.when(get(m, "type") == "ai", "assistant").otherwise("user")
    bubble = lambda b: message(ai(b), F.coalesce(_or(get(b, "rawText"), get(b, "text"), get(b, "content")), F.lit("")), _or(get(b, "timingInfo.clientStartTime")))
    composer = lambda m: message(F.coalesce(_or(get(m, "role")), ai(m)), text_or_json(m), ts(m))
    share = lambda m: message(F.when(get(m, "from") == "human", "user").when(get(m, "from") == "gpt", "assistant").otherwise(F.coalesce(_or(get(m, "from")), F.lit("unknown"))), F.coalesce(get(m, "value"), F.lit("")))
    none = F.expr("cast(array() as array<variant>)")
    loop = lambda name: F.flatten(F.transform(items(v, name), lambda t: F.transform(F.coalesce(items(t, "messages"), F.array(t)), loose)))
    return [
        (yes("sessionId") & yes("type") & yes("message.role"), F.array(message(F.when(get(v, "message.role") == "assistant", "assistant").otherwise("user"), flatten_content(v, "message.content"), ts(v))), "low"),
        (yes("tabs[0].bubbles"), F.flatten(F.transform(items(v, "tabs"), lambda t: F.transform(F.coalesce(items(t, "bubbles"), none), bubble))), "high"),
        (items(v, "composerData.conversation").isNotNull(), F.transform(items(v, "composerData.conversation"), composer), "high"),
        (there("messages[0].role"), F.transform(items(v, "messages"), full), "high"),
        (there("conversation[0].role"), F.transform(items(v, "conversation"), plain), "high"),
        (~yes("conversation") & there("history[0].role"), F.transform(items(v, "history"), plain), "high"),
        (there("conversations[0].from"), F.transform(items(v, "conversations"), share), "high"),
        (_or(F.try_variant_get(v, "$[0].role", "string")).isNotNull(), F.transform(items(v, ""), loose), "low"),
        (there("convo[0]"), loop("convo"), "low"), (~yes("convo") & there("threads[0]"), loop("threads"), "low"),
    ]


def json_messages(v: Column) -> Column:
    """Messages and level of a JSON file's value: the first shape that fits; null when none does."""
    out = F.lit(None).cast(f"struct<messages:{MESSAGES_DDL},level:string>")
    for test, value, level in reversed(json_shapes(v)):
        out = F.when(F.coalesce(test, F.lit(False)), F.struct(value.cast(MESSAGES_DDL).alias("messages"), F.lit(level).alias("level"))).otherwise(out)
    return out


def once(rows: DataFrame, *names: str) -> DataFrame:
    """The same rows. Columns of these names are worked out once a row: what stands below a generator is copied neither
    into later filters nor into the branches of a union."""
    return rows.select(*[c for c in rows.columns if c not in names], F.inline(F.array(F.struct(*names))))


def extract_json(files: DataFrame, content: Column | None = None) -> DataFrame:
    """Adds messages, confidence and bad. Other objects or arrays of two members or more are one system message."""
    content = F.col("content") if content is None else content
    v = files.withColumn("v", F.try_parse_json(content))
    v = v.withColumn("m", json_messages(F.col("v")))
    many = F.coalesce(F.size(F.try_variant_get("v", "$", "map<string,variant>")), F.size(items(F.col("v"), "")), F.lit(0)) >= 2
    whole = F.array(message("system", _pretty(F.when(F.col("m").isNull() & many, content)))).cast(MESSAGES_DDL)
    level = F.coalesce("m.level", F.when(many, "low"), F.lit("unknown"))
    return v.withColumns({"messages": F.coalesce("m.messages", F.when(many, whole), F.expr(NONE)), "confidence": level, "bad": F.col("v").isNull().cast("long")}).drop("v", "m")


def markdown_columns() -> dict[str, Column]:
    """messages, prompt and confidence of a Markdown content: front matter, then role sections, then the whole text."""
    front = rf"\A---{BLANK_CLASS}*\n([\s\S]*?)\n---{BLANK_CLASS}*\n"
    head = F.regexp_extract("content", front, 1)
    section = rf"(?im)^#{{1,3}}{BLANK_CLASS}*(User|Assistant|System|Human|AI|Bot){BLANK_CLASS}*$"
    names = F.regexp_extract_all("content", F.lit(section), F.lit(1))
    bodies = F.split("content", section, -1)
    role = lambda n: F.when(F.lower(n) == "human", "user").when(F.lower(n).isin("ai", "bot"), "assistant").otherwise(F.lower(n))
    sections = F.zip_with(names, F.slice(bodies, F.lit(2), F.size(names)), lambda n, b: message(role(n), trimmed(b)))
    sections = F.filter(sections, lambda m: m["content"] != "")
    body = trimmed(F.regexp_replace("content", front, ""))
    user = F.filter(sections, lambda m: m["role"] == "user")
    is_front, is_sections, some = F.col("content").rlike(front), F.size(names) >= 1, F.length(trimmed(F.col("content"))) > 0
    line = F.element_at(F.filter(F.split("content", "\n"), lambda x: F.length(trimmed(x)) > 0), 1)
    messages = F.when(is_front, F.filter(F.array(message("assistant", body)), lambda m: m["content"] != "")).when(is_sections, sections).when(some, F.array(message("assistant", F.col("content")))).otherwise(F.expr(NONE))
    named = F.when(head.rlike("name:"), trimmed(F.regexp_extract(head, r"name:\s*(.*)", 1)))
    prompt = F.when(is_front, named).when(is_sections, F.left(F.get(user, F.lit(0))["content"], F.lit(120))).when(some, trimmed(F.regexp_replace(line, r"^#+\s*", "")))
    level = F.when(~is_front & is_sections & (F.size(sections) > 1), "high").otherwise("low")
    return {"messages": messages.cast(MESSAGES_DDL), "prompt": prompt, "confidence": level}


def extract_markdown(files: DataFrame) -> DataFrame:
    """Adds messages, prompt and confidence."""
    return files.withColumns(markdown_columns())


def kv_shapes(v: Column, key: Column) -> list[tuple[Column, Column, Column]]:
    """Messages, created and updated of each shape of a store's value, in order; messages are null or empty elsewhere."""
    none, never = F.expr("cast(array() as array<variant>)"), F.lit(None).cast("string")
    ai = lambda m: F.coalesce(_or(get(m, "role")), F.when(get(m, "type") == "ai", "assistant").otherwise("user"))
    content = lambda m, *names: F.coalesce(_or(*[get(m, n) for n in names]), F.lit(""))
    ts = lambda m: _or(get(m, "timestamp"))
    talk = lambda m: message(ai(m), content(m, "content", "text"), ts(m))
    first, last = lambda a: F.get(a, F.lit(0)), lambda a: F.try_element_at(a, F.lit(-1))
    ends = lambda a: (ts(first(a)), ts(last(a)))
    of = lambda a, f: F.filter(F.transform(a, f), lambda x: x.isNotNull())

    composers = F.filter(F.coalesce(items(v, "allComposers"), none), lambda x: items(x, "conversation").isNotNull())
    composed = F.when(key == "composer.composerData", F.flatten(F.transform(composers, lambda x: F.transform(items(x, "conversation"), talk))))
    starts, stops = of(composers, lambda x: as_time(_or(get(x, "createdAt")))), of(composers, lambda x: as_time(_or(get(x, "lastUpdatedAt"))))

    fields = F.when(key == "aiService.generations", F.try_variant_get(v, "$", "map<string,variant>"))
    names = F.transform(F.array_sort(F.transform(F.map_keys(fields), lambda k: F.struct(F.coalesce(F.when(k.rlike(r"^(0|[1-9]\d{0,8})$"), k.try_cast("long")), F.lit(1 << 40)).alias("n"), k.alias("k")))), lambda x: x["k"])
    made = F.filter(F.transform(names, lambda k: F.try_element_at(fields, k)), lambda e: _or(get(e, "textDescription")).isNotNull())
    generated = F.transform(made, lambda e, i: message(F.when(i == 0, "user").otherwise("assistant"), get(e, "textDescription"), as_time(_or(get(e, "unixMs")))))

    conversation = items(v, "composerData.conversation")
    tabs = F.when(_or(get(v, "tabs[0].bubbles")).isNotNull(), items(v, "tabs"))
    bubbles = lambda t: F.coalesce(items(t, "bubbles"), none)
    told = F.flatten(F.transform(tabs, lambda t: F.transform(bubbles(t), lambda b: message(F.when(get(b, "type") == "ai", "assistant").otherwise("user"), content(b, "rawText", "text", "content")))))
    began = lambda b: as_time(_or(get(b, "timingInfo.clientStartTime")))
    messages = F.when(_or(get(v, "messages[0].role")).isNotNull(), items(v, "messages"))
    said = F.transform(messages, lambda m: message(F.coalesce(_or(get(m, "role")), F.lit("unknown")), F.coalesce(get(m, "content"), F.lit("")), ts(m)))
    tasks = items(v, "taskHistory")
    seconds = lambda m: as_time((_or(get(m, "ts")).try_cast("double") * 1000).cast("decimal(20,0)").cast("string"))
    done = F.transform(tasks, lambda m: message(F.coalesce(_or(get(m, "role")), F.lit("user")), content(m, "content", "text"), seconds(m)))
    shapes = [(composed, first(starts), last(stops)), (generated, as_time(_or(get(first(made), "unixMs"))), as_time(_or(get(last(made), "unixMs"))))]
    shapes += [(F.transform(conversation, talk), *ends(conversation)), (told, first(of(tabs, lambda t: began(first(bubbles(t))))), last(of(tabs, lambda t: began(last(bubbles(t)))))), (said, *ends(messages))]
    for name in ("conversation", "history", "convo"):
        a = F.when(_or(get(v, f"{name}[0].role"), get(v, f"{name}[0].type")).isNotNull(), items(v, name))
        shapes.append((F.transform(a, lambda m: message(ai(m), content(m, "content", "text", "rawText"), ts(m))), *ends(a)))
    return [*shapes, (done, never, seconds(last(tasks)))]


def extract_kv(rows: DataFrame) -> DataFrame:
    """Adds messages, created and updated of key/value items: the first shape of the key or value that has messages."""
    kind = f"struct<messages:{MESSAGES_DDL},created:string,updated:string>"
    found = [F.when(F.size(m) > 0, F.struct(m.cast(MESSAGES_DDL).alias("messages"), a.alias("created"), b.alias("updated"))).cast(kind) for m, a, b in kv_shapes(F.col("v_"), F.col("key"))]
    rows = rows.withColumn("v_", F.try_parse_json("value")).withColumn("found_", F.coalesce(*found))
    rows = once(rows, "found_")
    return rows.withColumns({"messages": F.coalesce("found_.messages", F.expr(NONE)), "created": F.col("found_.created"), "updated": F.col("found_.updated")}).drop("v_", "found_")


def first_user_prompt(messages: Column) -> Column:
    return F.left(F.get(F.filter(messages, lambda m: m["role"] == "user"), F.lit(0))["content"], F.lit(120))


def health_warnings(messages: Column, size: Column) -> Column:
    missing = F.size(F.filter(messages, lambda m: F.coalesce(F.nullif(m["role"], F.lit("")), F.lit("unknown")) == "unknown"))
    blank = F.size(F.filter(messages, lambda m: F.length(trimmed(F.coalesce(m["content"], F.lit("")))) == 0))
    return F.array_compact(F.array(
        F.when(missing > 0, F.concat(missing.cast("string"), F.lit(" message(s) have missing/unknown role"))), F.when(blank > 0, F.concat(blank.cast("string"), F.lit(" message(s) have empty content"))),
        F.when(size > (1 << 20), F.format_string("Large file: %.1fMB", size / (1 << 20))),
    ))


def unified(rows: DataFrame) -> DataFrame:
    """Rows with path, content, mtime_ms, size, messages, prompt, confidence, bad to thread records; rows that hold
    neither messages nor a prompt go, but rules and settings keep their text as one system message."""
    kind = classify.identify_type(F.col("path"))
    empty = F.size("messages") == 0
    keep = empty & ~kind.isin(*TALK_TYPES)
    name = F.substring_index("path", "/", -1)
    messages = F.when(keep, F.array(message("system", F.col("content"))).cast(MESSAGES_DDL)).otherwise(F.col("messages"))
    prompt = F.when(keep, name).otherwise(_or(F.col("prompt"), first_user_prompt(F.col("messages"))))
    rows = rows.withColumns({"type": kind, "was_empty": empty & ~keep, "new_messages": messages, "new_prompt": prompt, "level": F.when(keep, "low").otherwise(F.col("confidence"))})
    rows = rows.where(~F.col("was_empty") | F.col("new_prompt").isNotNull())
    text = F.array_join(F.transform("new_messages", lambda m: F.coalesce(m["content"], F.lit(""))), "")
    warnings = F.concat(F.when(F.lower("path").endswith(".jsonl"), F.array_repeat(F.lit("Skipped invalid JSONL line"), F.col("bad").cast("int"))).when(F.col("bad") > 0, F.array(F.lit("JSON parse error"))).otherwise(F.array().cast("array<string>")), health_warnings(F.col("new_messages"), F.col("size")))
    meta = F.struct(
        classify.normalize_source(classify.detect_tool(F.col("path"))).alias("source"), classify.infer_project(F.col("path")).alias("project"), iso_time(F.col("mtime_ms")).alias("created_at"), iso_time(F.col("mtime_ms")).alias("updated_at"), F.lit(None).cast("string").alias("model"),
        F.col("path").alias("file_path"), F.coalesce(filled(F.col("new_prompt")), F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")).alias("prompt"), estimate_tokens(text).alias("tokens"), F.col("level").alias("recognition_confidence"), F.when(F.size(warnings) > 0, warnings).alias("warnings"),
    )
    of = lambda name, ddl: F.coalesce(F.from_json(F.when(F.col("confidence") == "high", F.coalesce(F.get_json_object("content", f"$.{name}"), F.get_json_object("content", f"$.context.{name}"))), ddl), F.array().cast(ddl))
    files, diffs = of("files", "array<struct<path:string,snippet:string>>"), of("diffs", "array<struct<path:string,patch:string>>")
    held = F.contains("content", F.lit('"files"')) | F.contains("content", F.lit('"diffs"'))
    context = F.when(F.lower("path").endswith(".json") & held & F.get_json_object("content", "$.messages[0].role").isNotNull(), F.struct(files.alias("files"), diffs.alias("diffs"))).otherwise(F.from_json(F.lit('{"files":[],"diffs":[]}'), CONTEXT_DDL))
    return rows.select(F.lit(SCHEMA_VERSION).alias("schema_version"), classify.thread_id(F.col("path")).alias("thread_id"), "type", F.col("new_messages").alias("messages"), context.alias("context"), meta.alias("meta"))


def normalize_raw(files: DataFrame) -> DataFrame:
    """Raw files to thread records by the file's ending."""
    name = F.substring_index("path", "/", -1)
    ending = F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))
    files = files.withColumn("ending", ending)
    lines = files.where("ending = 'jsonl'").withColumn("text", F.xxhash64("content"))
    lines = lines.join(extract_jsonl(lines), ["path", "text"], "left").withColumns({"messages": F.coalesce("messages", F.expr(NONE)), "bad": F.coalesce("bad", F.lit(0).cast("long")), "prompt": F.lit(None).cast("string")})
    lines = lines.withColumn("confidence", F.when(F.size("messages") > 0, "high").otherwise("unknown"))
    is_md, strict = F.col("ending").isin("md", "mdc", "cursorrules"), F.col("ending").isin("json", "db", "", "log")
    rest = once(extract_json(files.where("ending <> 'jsonl'"), F.when(~is_md, F.col("content"))), "messages", "confidence", "bad")
    as_md = is_md | (~strict & (F.size("messages") == 0))
    rest = rest.withColumn("prompt", F.lit(None).cast("string"))
    rest = rest.withColumns({name: F.when(as_md, c).otherwise(F.col(name)) for name, c in markdown_columns().items()} | {"bad": F.when(is_md, 0).otherwise(F.col("bad"))})
    columns = ["path", "content", "mtime_ms", "size", "messages", "prompt", "confidence", "bad"]
    return unified(once(lines.select(columns).union(rest.select(columns)), "messages", "prompt", "confidence", "bad"))


def normalize_lines(lines: DataFrame) -> DataFrame:
    """Lines of JSONL files (sources.read_lines) to thread records, as normalize_raw gives them for the whole files. Text is
    put together only of files that have no message, for rules and settings that keep it."""
    files = lines.groupBy("path").agg(F.max("mtime_ms").alias("mtime_ms"), F.max("size").alias("size"))
    rows = once(files.join(extract_lines(lines), "path", "left").withColumns({"messages": F.coalesce("messages", F.expr(NONE)), "bad": F.coalesce("bad", F.lit(0).cast("long"))}), "messages", "bad")
    kind = classify.identify_type(F.col("path"))
    bare = rows.where((F.size("messages") == 0) & ~kind.isin(*TALK_TYPES)).select("path")
    texts = lines.join(bare, "path", "left_semi").groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "at", "line"))), lambda x: x["line"]), "\n").alias("text"), F.max("size").alias("bytes"))
    texts = texts.select("path", F.when(F.octet_length("text") < F.col("bytes"), F.concat("text", F.lit("\n"))).otherwise(F.col("text")).alias("content"))  # a last line end is no line
    rows = rows.join(texts, "path", "left").withColumns({"confidence": F.when(F.size("messages") > 0, "high").otherwise("unknown"), "prompt": F.lit(None).cast("string")})
    return unified(rows)


def normalize_kv(rows: DataFrame, ingest_ms: int = 0) -> DataFrame:
    """Key/value items to thread records; items without messages go."""
    got = extract_kv(rows).where(F.size("messages") > 0)
    text = F.array_join(F.transform("messages", lambda m: F.coalesce(m["content"], F.lit(""))), "")
    stamp = lambda c: F.when(c.rlike(r"^\d+(\.\d+)?$"), iso_time(c.cast("double"))).otherwise(c)
    in_key = F.when(F.col("key").rlike(r"\d{13}"), iso_time(F.regexp_extract("key", r"(\d{13})", 1)))
    created = F.coalesce(stamp(F.col("created")), in_key, iso_time(F.lit(ingest_ms)))
    meta = F.struct(
        classify.infer_source_kv(F.col("db_path")).alias("source"), classify.infer_project_kv(F.col("db_path")).alias("project"), created.alias("created_at"), F.coalesce(stamp(F.col("updated")), created).alias("updated_at"), F.lit(None).cast("string").alias("model"),
        F.col("db_path").alias("file_path"), F.coalesce(filled(first_user_prompt(F.col("messages"))), "key").alias("prompt"), estimate_tokens(text).alias("tokens"), F.lit("high").alias("recognition_confidence"), F.lit(None).cast("array<string>").alias("warnings"), F.col("key").alias("sqlite_key"),
    )
    return got.select(F.lit(SCHEMA_VERSION).alias("schema_version"), classify.thread_id(F.col("db_path"), F.col("key")).alias("thread_id"), F.lit("thread").alias("type"), "messages", F.from_json(F.lit('{"files":[],"diffs":[]}'), CONTEXT_DDL).alias("context"), meta.alias("meta"))

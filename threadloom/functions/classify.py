"""Path and source rules: ordered tests, the first that holds decides."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words in a lowered path and the tool they name, in the order of the tests.
TOOLS = {
    "roo-cline": "cline", "cline": "cline", "cursor": "cursor", "composer": "cursor", "claudecode": "claude_code", "claude": "claude_code", "openai": "codex", "codex": "codex", "opencode": "codex", "augment": "augment", "antigravity": "antigravity", "iflow": "iflow",
    "trae": "trae", "codebuddy": "codebuddy", "qoder": "qoder", "qcoder": "qoder", "qualcoder": "qoder", "kiro": "kiro", "windsurf": "windsurf", "vscode_copilot": "vscode_copilot", "code/user": "vscode_copilot", ".vscode": "vscode_copilot", "zed": "zed", "jetbrains": "unknown", "aider": "unknown",
}
# Folders of key/value databases.
STORES = {
    "antigravity": "antigravity", "windsurf": "windsurf", "vscodium": "vscode_copilot", "trae": "trae", "codebuddy": "codebuddy", "qoder": "qoder", "augment": "augment", "claude": "claude", "cursor": "cursor", "code - insiders": "vscode_copilot", "code": "vscode_copilot",
}
# Source names that are allowed, and other names for them.
ALLOWED = ["cursor", "antigravity", "codex", "augment", "claude_code", "iflow", "trae", "codebuddy", "qoder", "windsurf", "vscode_copilot", "imported", "api_capture", "unknown", "other", "cline", "zed", "kiro"]
ALIASES = {"claude": "claude_code", "openai": "codex", "opencode": "codex", "qcoder": "qoder", "qualcoder": "qoder", "vscode": "vscode_copilot", "mcp": "other", "jetbrains": "unknown", "aider": "unknown", "roo-cline": "cline"}
ROOTS = ["work", "projects", "workspace", "repos", "dev", "src", "home"]


def _first(tests: list[tuple[Column, str]], default: str) -> Column:
    out = F.lit(default)
    for test, value in reversed(tests):
        out = F.when(test, value).otherwise(out)
    return out


def slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def detect_tool(path: Column) -> Column:
    p = slashed(F.lower(path))
    return _first([(F.contains(p, F.lit(word)), tool) for word, tool in TOOLS.items()], "unknown")


def infer_source_kv(path: Column) -> Column:
    p = slashed(F.lower(path))
    return _first([(F.contains(p, F.lit(f"/{word}/")), tool) for word, tool in STORES.items()], "cursor")


def identify_type(path: Column) -> Column:
    p = F.lower(path)
    name = F.substring_index(p, "/", -1)
    has = lambda word: F.contains(name, F.lit(word))
    tests = [(has(w) | F.contains(p, F.lit(f"/{w}")), w) for w in ("plan", "task", "walkthrough", "artifact", "mcp")]
    tests.append((has("rule") | F.contains(p, F.lit("/rules")) | p.rlike("(\\.mdc|\\.cursorrules)$"), "rule"))
    tests.append((has("settings") | has("config") | has("storage"), "config"))
    return _first(tests, "thread")


def normalize_source(source: Column) -> Column:
    s = F.trim(F.lower(F.coalesce(F.nullif(source, F.lit("")), F.lit("unknown"))))
    s = F.coalesce(F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])[s], s)
    return F.when(s.isin(ALLOWED), s).otherwise("other")


def infer_project(path: Column) -> Column:
    """The segment after the first folder that usually holds projects, else the parent folder."""
    parts = F.filter(F.split(slashed(path), "/"), lambda s: s != "")
    hits = [F.nullif(F.array_position(F.transform(parts, F.lower), root), F.lit(0)) for root in ROOTS]
    first = F.least(*hits)
    after = F.when(first < F.size(parts), F.try_element_at(parts, (first + 1).cast("int")))
    return F.coalesce(after, F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(-2))), F.lit("unknown"))


# Folders that hold projects, for key/value stores.
STORE_ROOTS = ["work", "projects", "workspace", "repos", "dev"]


def infer_project_kv(path: Column) -> Column:
    """The segment after the first folder that holds projects, else the store's parent folder."""
    parts = F.split(slashed(path), "/")
    first = F.least(*[F.nullif(F.array_position(parts, root), F.lit(0)) for root in STORE_ROOTS])
    after = F.nullif(F.get(parts, first.cast("int")), F.lit(""))
    return F.coalesce(after, F.nullif(F.get(parts, F.greatest(F.size(parts) - 2, F.lit(0))), F.lit("")), F.lit("cursor"))


def thread_id(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat(*parts)), 1, 16)


def _sorted_fields(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*[_sorted_fields(value[f.name], f.dataType).alias(f.name) for f in fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _sorted_fields(x, kind.elementType))
    return value


def canonical_json(value: Column, kind: T.DataType) -> Column:
    """JSON with the fields of every object by name and without nulls, so that neither the order of columns nor a new column
    without values changes it."""
    return F.to_json(_sorted_fields(value, kind))


def content_hash(record: Column) -> Column:
    return F.substring(F.sha1(record), 1, 12)

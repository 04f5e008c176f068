"""A JSON Schema compiled to one expression over a VARIANT: the faults of a value with their paths.

Known words: type (one or several), required, properties, items, enum (of texts), pattern, minLength, minimum.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NONE = "cast(array() as array<string>)"


def _with(value: Column, use) -> Column:
    """use(value) with the value worked out once; use gives an array."""
    return F.flatten(F.transform(F.array(value), use))


def _kind(v: Column, fields: Column, elements: Column) -> Column:
    """null, object, array, string, boolean, integer or number."""
    name, size = F.schema_of_variant(v), F.try_variant_get(v, "$", "double")
    leaf = F.when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(size == F.floor(size).cast("double"), "integer").otherwise("number")
    return F.when(F.is_variant_null(v), "null").when(fields.isNotNull(), "object").when(elements.isNotNull(), "array").otherwise(leaf)


def _fault(test: Column, path: Column, text: str) -> Column:
    return F.when(test, F.array(F.concat(F.when(path == "", "(root)").otherwise(path), F.lit(f" {text}")))).otherwise(F.expr(NONE))


def faults(v: Column, schema: dict, path: Column | None = None) -> Column:
    """"<path> <what>" of every fault of the value, in the schema's order; null if the value is."""
    path = F.lit("") if path is None else path
    allowed = schema.get("type", [])
    allowed = [allowed] if isinstance(allowed, str) else list(allowed)

    def of(s: Column) -> Column:
        v, kind, fields, elements = s["v"], s["kind"], s["fields"], s["elements"]
        text = F.when(kind == "string", F.try_variant_get(v, "$", "string"))
        out = []
        if allowed:
            fits = allowed + ["integer"] * ("number" in allowed)
            out.append(_fault(~kind.isin(fits), path, f"must be {','.join(allowed)}"))
        if "enum" in schema:
            out.append(_fault(~F.coalesce(text.isin(schema["enum"]), F.lit(False)), path, "must be equal to one of the allowed values"))
        if "pattern" in schema:
            out.append(_fault(F.coalesce(~text.rlike(schema["pattern"]), F.lit(False)), path, f'must match pattern "{schema["pattern"]}"'))
        if "minLength" in schema:
            out.append(_fault(F.coalesce(F.length(text) < schema["minLength"], F.lit(False)), path, f"must not have fewer than {schema['minLength']} characters"))
        if "minimum" in schema:
            out.append(_fault(F.coalesce(kind.isin("integer", "number") & (F.try_variant_get(v, "$", "double") < schema["minimum"]), F.lit(False)), path, f"must be >= {schema['minimum']}"))
        for name in schema.get("required", []):
            out.append(_fault((kind == "object") & F.try_element_at(fields, F.lit(name)).isNull(), path, f"must have required property '{name}'"))
        for name, inner in schema.get("properties", {}).items():
            out.append(F.coalesce(faults(F.try_element_at(fields, F.lit(name)), inner, F.concat(path, F.lit(f"/{name}"))), F.expr(NONE)))
        if "items" in schema:
            each = F.transform(elements, lambda x, i: F.coalesce(faults(x, schema["items"], F.concat(path, F.lit("/"), i.cast("string"))), F.expr(NONE)))
            out.append(F.coalesce(F.flatten(each), F.expr(NONE)))
        return F.concat(*out) if out else F.expr(NONE)

    deep, long = bool(schema.get("required") or schema.get("properties")), "items" in schema
    fields, elements = F.try_variant_get(v, "$", "map<string,variant>"), F.try_variant_get(v, "$", "array<variant>")
    parts = F.struct(v.alias("v"), (fields if deep else F.when(F.lit(False), fields)).alias("fields"), (elements if long else F.when(F.lit(False), elements)).alias("elements"), _kind(v, fields, elements).alias("kind"))
    return F.when(v.isNotNull(), _with(parts, of))

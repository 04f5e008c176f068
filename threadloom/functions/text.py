"""Text rules shared by all operators, as Column functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that the logs' own trimming removes.
BLANKS = "".join(map(chr, [9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
BLANK_CLASS = "[\\t\\n\\x0B\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: code points, and one more for each beyond the basic plane."""
    return F.length(text) + F.regexp_count(text, F.lit("[\\x{10000}-\\x{10FFFF}]"))


def estimate_tokens(text: Column) -> Column:
    wide = F.regexp_count(text, F.lit("[\\u4E00-\\u9FFF\\u3040-\\u30FF]"))
    return F.ceil(wide + (utf16_length(text) - wide) / 4).cast("long")


def role_tokens(messages: Column, role: str) -> Column:
    """Whole quarters of the lengths of a role's messages."""
    own = F.filter(messages, lambda m: m["role"] == role)
    return F.aggregate(own, F.lit(0).cast("long"), lambda a, m: a + F.floor(F.coalesce(utf16_length(m["content"]), F.lit(0)) / 4))


def filled(text: Column) -> Column:
    """The text, or null where it is empty."""
    return F.nullif(text, F.lit(""))


def slug(text: Column) -> Column:
    """Safe file name part of at most 50 characters."""
    s = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[\\x00-\\x1f\\x7f]", "")
    s = F.regexp_replace(F.regexp_replace(s, '[\\\\/?%*:|"<>]', "-"), f"{BLANK_CLASS}+", "_")
    s = F.btrim(F.left(s, F.lit(50)), F.lit("_"))
    return F.when(s == "", F.lit("untitled")).otherwise(s)


def magic(content: Column) -> Column:
    """Kind of a file without a telling name."""
    t = F.ltrim(content, F.lit(BLANKS))
    kinds = (("{", "json"), ("[", "json-array"), ("---", "yaml-or-markdown"), ("#", "markdown"))
    out = F.when(F.coalesce(content, F.lit("")) == "", "unknown")
    for head, kind in kinds:
        out = out.when(F.startswith(t, F.lit(head)), kind)
    return out.when(F.startswith(content, F.lit(chr(0xFEFF))), "text-bom").otherwise("text")


def iso_time(millis: Column) -> Column:
    return F.date_format(F.timestamp_millis(millis.cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")

"""Secret scans with a combined deterministic automaton (see automaton.py).

A place where a rule accepts leads to the span: the mirrored rule's automaton finds the leftmost start, the anchored
one the longest end, the scan resumes after it. For these rules the match that ends first is also the leftmost, as
none can begin inside another's opening part, so spans are those of a leftmost, non-overlapping search.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.automaton import Dfa, compile_rules, longest, search
from threadloom.llm.shared import documents
from threadloom.llm.wordgrid import slices, text_bytes

# The rules, in the order of kinds. The first three are the base; the rest are public token formats.
RULES = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{24}[0-9a-f]*",
    "github": r"gh[opsur]_[A-Za-z0-9]+",
    "slack": r"xox[abprs]-[A-Za-z0-9-]+",
    "google": r"AIza[A-Za-z0-9_-]+",
    "stripe": r"sk_live_[A-Za-z0-9]+",
    "pem": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "jwt": r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
}
OPENING = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
LEAST = {"assign": 6, "access": 20, "github": 40, "slack": 16, "google": 39, "stripe": 32}  # characters, of assign's value
BASE = ("assign", "access", "hex")


@lru_cache(maxsize=1)
def automata() -> tuple[Dfa, list[Dfa], list[Dfa], Dfa]:
    """The combined automaton, each rule's anchored and mirrored ones, and the opening of assign."""
    rules = list(RULES.values())
    return compile_rules(rules, floating=True), [compile_rules([r], False) for r in rules], [compile_rules([r], False, back=True) for r in rules], compile_rules([OPENING], False)


def spans_of(text: bytes, ends: dict[int, list[int]]) -> list[tuple[int, int, int]]:
    """(start, rule, end) in bytes, sorted, from the rules' accepting places in the text."""
    _, forward, backward, opening = automata()
    out = []
    for k, stops in ends.items():
        kind, past = list(RULES)[k], 0
        for stop in stops:
            if stop <= past:
                continue
            start = longest(backward[k], text, stop, past, -1)
            if start < 0:
                continue
            past = longest(forward[k], text, start, len(text), 1)
            begin = longest(opening, text, start, past, 1) if kind == "assign" else start
            if past - begin >= LEAST.get(kind, 1):
                out.append((start, k, past))
    return sorted(out)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    combined, kinds = automata()[0], list(RULES)
    for b in slices(batches):
        data, begin = text_bytes(b.column("text"))
        text, stop, bits = search(combined, data, begin)
        found: list[list] = [[] for _ in range(b.num_rows)]
        at = np.searchsorted(text, np.arange(b.num_rows + 1))
        for i in np.unique(text).tolist():
            raw = data[begin[i] : begin[i + 1]].tobytes()
            ends: dict[int, list[int]] = {}
            for e, m in zip((stop[at[i] : at[i + 1]] - begin[i]).tolist(), bits[at[i] : at[i + 1]].tolist()):
                while m:
                    k = (m & -m).bit_length() - 1
                    ends.setdefault(k, []).append(e)
                    m &= m - 1
            points = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
            code = lambda x: int(points[x - 1]) if x else 0  # noqa: B023, E731
            found[i] = [{"kind": kinds[k], "start": code(s), "end": code(e)} for s, k, e in spans_of(raw, ends)]
        yield pa.record_batch([b.column("doc_id"), pa.array(found, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], ["doc_id", "found"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, found: array of (kind, start, end), code points, end exclusive, by start and kind, for every row.

    Null and empty texts have none; ids may be null or repeat; other columns are ignored; an empty table gives no rows."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scan, "doc_id long, found array<struct<kind:string,start:long,end:long>>")


def _is(kind: str):
    return lambda span: span["kind"] == kind


def op3_secret_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, counted for the base kinds and listed for all; see find_secrets for nulls and repeats."""
    found = find_secrets(documents(spark, sf_dir))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    counts = [F.size(F.filter("found", _is(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


"""Quality rules as a short-circuit cascade.

Each task takes the first ``SAMPLE`` rows that it reads as its sample: all rules judge all of them, the seconds of each
rule and what it rejects are noted, and rules are ordered by rejection per cost, each time among the rows that the rules
before leave. Later rows meet the rules in that order, and a row that one rejects costs the next ones nothing. A row is
kept if no rule rejects it, so the order, which may differ between tasks and runs, decides only about time. Costs and
selectivities of rules are those of a task's own part of the table; nothing is read twice for them.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.shared import documents, unused
from threadloom.llm.wordgrid import Words, _word_hashes, combine, mix, run_hashes, slices, words

SAMPLE = 256
WINDOW, FEWEST_WORDS, MOST_REPEATED = 3, 50, 50
DENSE = 0.75  # rows are packed anew when fewer than this share of them are left


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_SYMBOL, _SPACE, _SHOUT = _table("#*$%&|<>"), _table(" \t\n\x0b\x0c\r"), _table("!?")
_UPPER, _LOWER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("abcdefghijklmnopqrstuvwxyz")
_LETTER = _UPPER | _LOWER | (np.arange(256) >= 0x80)  # bytes of other alphabets' letters count as letters
_POINT = ~_SPACE & ((np.arange(256) & 0xC0) != 0x80)


@dataclass
class Texts:
    """Words of some texts, and what rules have worked out of them."""

    w: Words
    known: dict[str, np.ndarray] = field(default_factory=dict)

    def __len__(self) -> int:
        return len(self.w.begin) - 1

    @property
    def n_words(self) -> np.ndarray:
        return self.w.counts

    def of(self, name: str, work: Callable[[Words], np.ndarray]) -> np.ndarray:
        if name not in self.known:
            self.known[name] = work(self.w)
        return self.known[name]

    @property
    def hashes(self) -> np.ndarray:
        return self.of("hashes", lambda w: w.hashes(lower=False))

    @property
    def owner(self) -> np.ndarray:
        return self.of("owner", lambda w: np.repeat(np.arange(len(w.counts)), w.counts))

    def bytes_in(self, kind: np.ndarray) -> np.ndarray:
        """Bytes of a kind in each text."""
        return _sums(kind[self.w.data], self.w.begin)

    def words_with(self, kind: np.ndarray) -> np.ndarray:
        """For each word, its bytes of a kind."""
        total = np.concatenate([[0], np.cumsum(kind[self.w.data], dtype=np.int64)])
        return total[self.w.end] - total[self.w.start]

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, weights=flags, minlength=len(self)).astype(np.int64)

    def only(self, keep: np.ndarray) -> Texts:
        """The texts of a mask, packed; what is known of them stays."""
        w, size = self.w, np.diff(self.w.begin)
        begin = np.concatenate([[0], np.cumsum(size[keep])])
        taken = np.repeat(keep, w.counts)
        shift = np.repeat((w.begin[:-1][keep] - begin[:-1]), w.counts[keep])
        first = np.concatenate([[0], np.cumsum(w.counts[keep])])
        known = {"hashes": self.known["hashes"][taken]} if "hashes" in self.known else {}
        return Texts(Words(w.data[np.repeat(keep, size)], begin, w.start[taken] - shift, w.end[taken] - shift, first), known)


def _sums(flags: np.ndarray, begin: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[begin[1:]] - total[begin[:-1]]


def _repeated(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in an order that brings equal entries of an owner together, and the number of each run's first place."""
    key = combine(mix(owner.astype(np.uint64)), hashes)
    order = np.argsort(key, kind="stable")
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[order][1:] != key[order][:-1]
    return order, np.cumsum(fresh) - 1


def lines(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, its lines that hold a word, and those of them equal to an earlier one."""
    w = t.w
    cuts = np.flatnonzero(w.data == 10)
    start = np.unique(np.concatenate([w.begin[:-1], cuts + 1]))
    start = start[start < len(w.data)]
    end = np.append(start[1:], len(w.data))
    end = np.where(w.data[end - 1] == 10, end - 1, end) if len(end) else end
    at = np.searchsorted(w.start, start)
    held = (at < np.searchsorted(w.start, end)) if len(start) else np.zeros(0, bool)
    start, end = start[held], end[held]
    owner = np.searchsorted(w.begin, start, side="right") - 1
    n = np.bincount(owner, minlength=len(t))
    order, run = _repeated(owner, _word_hashes(w.data, start, end))
    again = np.concatenate([[False], run[1:] == run[:-1]]) if len(run) else np.zeros(0, bool)
    return n, np.bincount(owner[order][again], minlength=len(t))


def repeat_words(t: Texts) -> np.ndarray:
    """Words of each text that lie in a window of WINDOW words found twice or more in it."""
    h, owner = t.hashes, t.owner
    n = len(h) - WINDOW + 1
    if n < 1:
        return np.zeros(len(t), np.int64)
    whole = np.flatnonzero(owner[:n] == owner[WINDOW - 1 :])
    order, run = _repeated(owner[whole], run_hashes(h, WINDOW)[whole])
    twice = whole[order[np.bincount(run)[run] > 1]] if len(run) else whole
    covered = np.zeros(len(h), bool)
    for k in range(WINDOW):
        covered[twice + k] = True
    return t.per_text(covered)


def base(t: Texts) -> dict[str, np.ndarray]:
    n_lines, dup_lines = lines(t)
    t.known["n_lines"], t.known["n_dup_lines"] = n_lines, dup_lines
    return {"n_words": t.n_words, "word_chars": t.bytes_in(_POINT), "n_symbols": t.bytes_in(_SYMBOL), "n_dup_lines": dup_lines, "n_repeat_words": repeat_words(t)}


def base_failed(b: dict[str, np.ndarray]) -> np.ndarray:
    return (b["n_words"] < FEWEST_WORDS) | (100 * b["n_repeat_words"] > MOST_REPEATED * b["n_words"])


def _top_word(t: Texts) -> np.ndarray:
    order, run = _repeated(t.owner, t.hashes)
    count = np.bincount(run, minlength=1)
    top = np.zeros(len(t), np.int64)
    if len(run):
        np.maximum.at(top, t.owner[order], count[run])
    return top


def _next_same(t: Texts) -> np.ndarray:
    same = np.zeros(len(t.hashes), bool)
    same[1:] = (t.hashes[1:] == t.hashes[:-1]) & (t.owner[1:] == t.owner[:-1])
    return t.per_text(same)


def _shouted(t: Texts) -> np.ndarray:
    return t.per_text((t.words_with(_UPPER) >= 2) & (t.words_with(_LOWER) == 0))


def _exclaimed(t: Texts) -> np.ndarray:
    last = t.w.data[t.w.end - 1] if len(t.w.end) else np.zeros(0, np.uint8)
    return t.per_text(_SHOUT[last])


Rule = Callable[[Texts], np.ndarray]
# Whether a rule rejects each text, by its words or lines.
RULES: dict[str, Rule] = {
    "word_length": lambda t: (lambda c: (c < 2 * t.n_words) | (c > 12 * t.n_words))(t.bytes_in(_POINT)),
    "symbols": lambda t: 10 * t.bytes_in(_SYMBOL) > t.n_words,
    "no_letters": lambda t: 10 * t.per_text(t.words_with(_LETTER) > 0) < 8 * t.n_words,
    "shouting": lambda t: 10 * _shouted(t) > 3 * t.n_words,
    "exclaiming": lambda t: 10 * _exclaimed(t) > 3 * t.n_words,
    "same_lines": lambda t: (lambda n: 2 * n[1] > n[0])(lines(t)),
    "stuttering": lambda t: 10 * _next_same(t) > t.n_words,
    "one_word": lambda t: 10 * _top_word(t) > 3 * t.n_words,
}


@dataclass
class Estimate:
    """What the rules cost and reject on a sample: seconds of each, and a row of verdicts for each sampled text."""

    names: list[str]
    seconds: np.ndarray = None
    verdicts: np.ndarray = None

    def __post_init__(self) -> None:
        self.seconds = np.zeros(len(self.names)) if self.seconds is None else self.seconds
        self.verdicts = np.zeros((0, len(self.names)), bool) if self.verdicts is None else self.verdicts

    def add(self, t: Texts, rules: dict[str, Rule]) -> np.ndarray:
        """Let every rule judge all texts, each from scratch; returns the verdicts."""
        out = np.zeros((len(t), len(self.names)), bool)
        for k, name in enumerate(self.names):
            began = time.thread_time()
            out[:, k] = rules[name](Texts(t.w))
            self.seconds[k] += time.thread_time() - began
        self.verdicts = np.concatenate([self.verdicts, out])
        return out

    def order(self) -> list[str]:
        """Names by rejection per cost, each among the texts that those before it leave; ties as listed."""
        left, rest, out = np.ones(len(self.verdicts), bool), list(range(len(self.names))), []
        while rest:
            gain = [self.verdicts[left, k].sum() / max(self.seconds[k], 1e-9) for k in rest]
            if not any(gain):  # what rejects nothing more: the cheap ones first
                return out + [self.names[k] for k in sorted(rest, key=lambda k: self.seconds[k])]
            k = rest.pop(int(np.argmax(gain)))
            left &= ~self.verdicts[:, k]
            out.append(self.names[k])
        return out


def cascade(t: Texts, order: list[str], rules: dict[str, Rule], done: dict[str, list] | None = None) -> np.ndarray:
    """Whether each text passes all rules; one that a rule rejects is not shown to the next. done: adds up the texts that
    each rule has judged and rejected, and its seconds."""
    passed, at = np.ones(len(t), bool), np.arange(len(t))
    alive = np.ones(len(t), bool)  # of the texts in t
    for name in order:
        if not alive.any():
            break
        if alive.mean() < DENSE:
            t, at, alive = t.only(alive), at[alive], np.ones(int(alive.sum()), bool)
        began = time.thread_time()
        bad = rules[name](t) & alive
        if done is not None:
            counts = done.setdefault(name, [0, 0, 0.0])
            counts[0], counts[1], counts[2] = counts[0] + int(alive.sum()), counts[1] + int(bad.sum()), counts[2] + time.thread_time() - began
        passed[at[bad]] = False
        alive &= ~bad
    return passed


class _Judge:
    """A task's cascade: its first ``sample`` texts settle the order."""

    def __init__(self, rules: dict[str, Rule], sample: int) -> None:
        self.rules, self.sample, self.order, self.done = rules, sample, None, {}
        self.estimate = Estimate(list(rules))

    def __call__(self, t: Texts, keep: np.ndarray) -> np.ndarray:
        """Whether each text passes; those that keep leaves out are not looked at, and don't pass."""
        out, at = np.zeros(len(t), bool), np.flatnonzero(keep)
        if self.order is None:
            first = at[: self.sample - len(self.estimate.verdicts)]
            mask = np.zeros(len(t), bool)
            mask[first] = True
            verdicts = self.estimate.add(t.only(mask), self.rules) if len(first) else np.zeros((0, len(self.rules)), bool)
            out[first] = ~verdicts.any(axis=1)
            for k, name in enumerate(self.estimate.names):
                counts = self.done.setdefault(name, [0, 0, 0.0])
                counts[0], counts[1] = counts[0] + len(verdicts), counts[1] + int(verdicts[:, k].sum())
            if len(self.estimate.verdicts) >= self.sample:
                self.order = self.estimate.order()
            at = at[len(first) :]
        if len(at):
            mask = np.zeros(len(t), bool)
            mask[at] = True
            out[at] = cascade(t if mask.all() else t.only(mask), self.order, self.rules, self.done)
        return out


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _judged(rules: dict[str, Rule], sample: int, names: list[str]):
    """The columns of a batch, then BASE, base_failed and kept under the given names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _Judge(rules, sample)
        for b in slices(batches):
            t = Texts(words(b.column("text").cast(pa.large_string())))
            stats = base(t)
            failed = base_failed(stats)
            kept = judge(t, ~failed)
            yield pa.record_batch([*b.columns, *(pa.array(stats[n].astype(np.int64)) for n in BASE), pa.array(failed), pa.array(kept)], [*b.schema.names, *names])

    return run


def judge_documents(docs: DataFrame, rules: dict[str, Rule] = RULES, sample: int = SAMPLE) -> DataFrame:
    """All columns of docs, then BASE, base_failed (too few words, or too many in repeated windows) and kept: neither that
    nor rejected by a rule. A column of one of these names keeps it, and the new one gets an underscore.

    Null and empty texts have no words and fail; ids may be null or repeat and play no part; equal texts are judged alike;
    an empty table stays empty. Windows and lines are compared by 64-bit hashes within a text."""
    taken, names = docs, []
    for n in (*BASE, "base_failed", "kept"):
        names.append(unused(n, taken))
    kinds = [T.LongType()] * len(BASE) + [T.BooleanType()] * 2
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds))])
    return docs.mapInArrow(_judged(rules, sample, names), schema)


def rule_report(docs: DataFrame, rules: dict[str, Rule] = RULES, sample: int = SAMPLE) -> DataFrame:
    """rule, judged, rejected, seconds: how many texts that don't fail the base each rule has seen and rejected in all
    tasks. Sampled texts are judged by every rule (their seconds aren't counted), others until the first that rejects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _Judge(rules, sample)
        for b in slices(batches):
            t = Texts(words(b.column("text").cast(pa.large_string())))
            judge(t, ~base_failed(base(t)))
        rows = [(k, *v) for k, v in judge.done.items()]
        if rows:
            yield pa.record_batch([pa.array(c) for c in zip(*rows)], ["rule", "judged", "rejected", "seconds"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "rule string, judged long, rejected long, seconds double")
    return rows.groupBy("rule").agg(*[F.sum(c).alias(c) for c in ("judged", "rejected", "seconds")])


def op12_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the rules' verdict of every document."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return judge_documents(docs).select("doc_id", *BASE, "base_failed", "kept")

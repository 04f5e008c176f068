"""Grouping of spelling variants by composing the vocabulary acceptor, a one-edit transducer and the acceptor again.

The composed machine accepts the pairs of words with one edit between them. A pair's edit lies where the two words
first differ; a tile [lo, hi) of such places, with what the words share before and behind it, fixes the state in which
the acceptor starts (after the shared prefix) and the one in which its mirror image starts (before the shared suffix).
Words that share both form a partition of the machine: the tiles of a length cover all places once, so every pair
is enumerated in one partition. A partition over ``MOST`` words is cut into two tiles of half the width, again and again; one of a
single place holds one word for each letter, and one with two letters in place of one, at most, so all end up small
whatever the vocabulary. In a partition the minimal acceptor of the words' middles is built, and composed as it is walked.
"""

from __future__ import annotations

import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.shared import discard, documents, small_side, stored
from threadloom.llm.wordgrid import slices

LETTERS = bytes(ord(chr(c).lower()) if chr(c).isascii() and chr(c).isalpha() else c if c >= 0xC0 else 32 for c in range(256))  # lower-cases A to Z
HELD = 400_000  # words that a task adds up before it sends them on
SHORTEST, LEAST_COUNT, MARGIN, EVERY = 5, 3, 2, 97
MOST = 4096  # words of a partition, unless its tile is a single place: then letters and pairs of letters bound it
KEY_BYTES = 200


def damaged(run: bytes, opening: int) -> bytes | None:
    """The Latin-1 run without one code point if the hash of document and run says so; opening: the hash of "<doc_id>:"."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), opening)
    return None if h % EVERY else run[: h % len(run)] + run[h % len(run) + 1 :]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and their counts, added up by tasks as far as memory allows. All letters are Latin-1 code points, others
    become spaces."""
    held: Counter = Counter()

    def batch() -> pa.RecordBatch:
        words = [w for w, n in held.items() if n and len(w) >= SHORTEST]
        return pa.record_batch([pa.array([w.decode("latin-1") for w in words], pa.string()), pa.array([held[w] for w in words], pa.int64())], ["word", "n"])

    for b in slices(batches):
        for doc_id, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
            runs = (text or "").encode("latin-1", "replace").translate(LETTERS).split()
            held.update(runs)
            if doc_id is None:
                continue
            opening = zlib.crc32(f"{doc_id}:".encode())
            for run in set(runs):
                other = damaged(run, opening)
                if other is not None:
                    n = runs.count(run)
                    held[run] -= n
                    held[other] += n
        if len(held) >= HELD:
            yield batch()
            held.clear()
    yield batch()


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: the words of all texts (null: none; a null id damages no run) of SHORTEST code points and LEAST_COUNT occurrences or more."""
    words = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(_counted, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds key: length, tile, and what a word has before the tile and behind it. A word of the length has its middle in
    [lo, hi), one that is longer by one in [lo, hi]."""
    last = F.col("hi") + F.when(F.length("word") > F.col("length"), 2).otherwise(1)
    return rows.withColumn("key", F.concat_ws("|", "length", "lo", "hi", F.substring("word", F.lit(1), F.col("lo")), F.substring("word", last, F.length("word"))))


def _halves(lo: Column, hi: Column) -> Column:
    mid = ((lo + hi) / 2).cast("int")
    return F.array(F.struct(lo.alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), hi.alias("hi")))


def tiles(words: DataFrame, most: int = MOST) -> DataFrame:
    """word, n, length, lo, hi, key: each word in the partitions of its own length and of the length below, of at most
    ``most`` words, but for those of a single place."""
    lengths = F.explode(F.filter(F.array(F.length("word"), F.length("word") - 1), lambda x: x >= SHORTEST)).alias("length")
    rows = words.select("word", "n", lengths)
    rows = rows.select("*", F.inline(_halves(F.lit(0), F.col("length") + 1)))
    parts = []
    while True:
        rows = _keyed(rows)
        large = rows.groupBy("key").agg(F.count("*").alias("k"), F.max(F.col("hi") - F.col("lo")).alias("width")).where((F.col("k") > most) & (F.col("width") > 1)).select("key")
        large = stored(large, "large-partitions")
        n = large.count()
        if not n:
            discard(large)
            parts.append(rows)
            out = parts[0]
            for p in parts[1:]:
                out = out.union(p)
            return out
        large = small_side(large, n, KEY_BYTES)
        parts.append(rows.join(large, "key", "left_anti").select(rows.columns))
        again = rows.join(large, "key", "left_semi")
        rows = again.select("word", "n", "length", F.inline(_halves(F.col("lo"), F.col("hi"))))


class Acceptor:
    """The minimal deterministic acceptor of some words: next state by letter, and whether a word may end there."""

    def __init__(self, words: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[bool] = [False]
        known: dict[tuple, int] = {}
        path: list[int] = [0]  # states along the last word, not yet merged
        last = ""

        def merge(down_to: int) -> None:
            while len(path) - 1 > down_to:
                state = path.pop()
                kind = (self.ends[state], *self.next[state].items())
                same = known.setdefault(kind, state)
                self.next[path[-1]][last[len(path) - 1]] = same

        for w in sorted(words):
            shared = 0
            while shared < min(len(w), len(last)) and w[shared] == last[shared]:
                shared += 1
            merge(shared)
            for c in w[shared:]:
                self.next.append({})
                self.ends.append(False)
                self.next[path[-1]][c] = len(self.next) - 1
                path.append(len(self.next) - 1)
            self.ends[path[-1]] = True
            last = w
        merge(0)

    def both(self, a: int, b: int, memo: dict) -> list[str]:
        """What can be read to an end from both states: the part of the composition after the edit."""
        key = (a, b) if a < b else (b, a)
        if key not in memo:
            out = [""] if self.ends[a] and self.ends[b] else []
            x, y = self.next[a], self.next[b]
            for c in x if len(x) <= len(y) else y:
                if c in x and c in y:
                    out += [c + rest for rest in self.both(x[c], y[c], memo)]
            memo[key] = out
        return memo[key]

    def one_edit(self) -> Iterator[tuple[int, str, str]]:
        """Accepted pairs of the composition, each once, and where they first differ, which is where the edit is made:
        (a word, the word with a greater letter in one place) or (a word, the word with a letter more)."""
        memo: dict[tuple[int, int], list[str]] = {}
        todo = [("", 0)]
        while todo:
            read, state = todo.pop()
            ways = sorted(self.next[state].items())
            for k, (c, to) in enumerate(ways):
                todo.append((read + c, to))
                for d, other in ways[k + 1 :]:
                    for rest in self.both(to, other, memo):
                        yield len(read), read + c + rest, read + d + rest
                for rest in self.both(state, to, memo):
                    if rest[:1] != c:
                        yield len(read), read + rest, read + c + rest


def near_words(group: dict[str, tuple[str, int]], length: int, places: int) -> dict[str, list]:
    """By word: the number of near words in a partition, and the one of largest n, ties by code points. group: word and
    n by middle; length: of the middles of the partition's shorter words; places: of the tile. Pairs of longer words,
    and those whose edit lies behind the tile, belong elsewhere."""
    out: dict[str, list] = {}
    for at, a, b in Acceptor(list(group)).one_edit():
        if len(a) == length and at < places:
            for (w, _), (v, n) in ((group[a], group[b]), (group[b], group[a])):
                had = out.setdefault(w, [0, 0, ""])
                had[0] += 1
                if (-n, v) < (-had[1], had[2]):
                    had[1:] = n, v
    return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of one key after another; rows come sorted by key."""
    now, held = None, []
    for row in chain.from_iterable(zip(*(b.column(c).to_pylist() for c in ("key", "word", "n", "length", "lo", "hi"))) for b in batches):
        if row[0] != now:
            if len(held) > 1:
                yield held
            now, held = row[0], []
        held.append(row)
    if len(held) > 1:
        yield held


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    schema = pa.schema([("word", pa.string()), ("near", pa.int64()), ("most", pa.int64()), ("best", pa.string())])
    batch = lambda: pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
    for held in _groups(batches):
        _, _, _, length, lo, hi = held[0]
        group = {w[lo : hi + (len(w) > length)]: (w, n) for _, w, n, *_ in held}
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 2 * length + 1000))
        rows += [(w, *x) for w, x in near_words(group, min(hi, length) - lo, hi - lo).items()]
        if len(rows) >= 20_000:
            yield batch()
            rows.clear()
    if rows:
        yield batch()


def near(words: DataFrame, most: int = MOST) -> DataFrame:
    """word, n_near, best, best_n of the words that have near words: one inserted, deleted or replaced code point."""
    rows = tiles(words, most).select("key", "word", "n", "length", "lo", "hi").repartition("key").sortWithinPartitions("key")
    found = rows.mapInArrow(_compose, "word string, near long, most long, best string")
    first = F.min(F.struct((-F.col("most")).alias("m"), "best")).alias("f")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), first).select("word", "n_near", F.col("f.best").alias("best"), (-F.col("f.m")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of the rows (word, form) of a stored table: forms followed to the last, two steps, four, eight at a
    time. Counts at least double with each step, so there are at most 62 steps and seven rounds."""
    ahead = forms.select("word", F.col("form").alias("root"))
    while True:
        nxt = ahead.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stored(ahead.join(nxt, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if not moved.where("moved").limit(1).count():
            return moved.select("word", "root")
        ahead = moved.select("word", "root")


def variant_groups(docs: DataFrame, most: int = MOST) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of the vocabulary.

    Null texts have no words; a null id leaves its runs as they are; repeated rows count each; an empty table or one of
    rare words gives no rows; other columns are ignored. Of near words of equal n the first in code-point order is the form."""
    words = stored(vocabulary(docs), "vocabulary")
    found = near(words, most)
    is_form = F.col("best_n") >= MARGIN * F.col("n")
    rows = stored(words.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")), "variants")
    discard(words)
    last = roots(rows.where("form is not null"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_composed_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of the words of all documents."""
    return variant_groups(documents(spark, sf_dir))

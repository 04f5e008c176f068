"""Substring dedup: repeated word sequences by seed and extend.

Seeds are winnowed anchors: of the SEED-word grams in a window of ``span`` words the one with the least hash. Windows
with equal words have equal anchors, so joining the anchors of all texts on their hash finds every place where a
repeat of ``span`` words can lie. A shared anchor is extended both ways to all windows it is the anchor of, and these
are compared by the hash of all their words; runs of windows that occur again merge into maximal repeats.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.llm.shared import documents
from threadloom.llm.wordgrid import Words, combine, run_hashes, slices, words

SPAN = 35


def windows(w: Words, span: int) -> tuple[np.ndarray, ...]:
    """For every window of span words inside one text: text, first word, hash of its words, hash of its anchor, and
    whether some gram in it occurs again close by."""
    seed = (span + 1) // 2
    hashes = w.hashes(lower=False)
    counts = w.counts
    number = np.maximum(counts - span + 1, 0)
    owner = np.repeat(np.arange(len(counts)), number)
    start = np.arange(len(owner)) - (np.cumsum(number) - number)[owner] + w.first[:-1][owner]
    if not len(start):
        return owner, start, np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
    grams = run_hashes(hashes, seed)
    width, low, have = span - seed + 1, grams, 1
    while have < width:  # least of ``have`` grams, doubled
        step = min(have, width - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    near = np.zeros(len(grams) + 1, dtype=np.int64)  # grams that occur again within a window's reach, summed
    for d in range(1, width):
        near[1 : len(grams) - d + 1] |= grams[d:] == grams[:-d]
    near = np.cumsum(near)
    return owner, start, run_hashes(hashes, span)[start], low[start], near[start + width] > near[start]


@dataclass
class Anchors:
    """Distinct (text, anchor) pairs in order; runs of neighbouring windows with one anchor: first window, windows, pair."""

    text: np.ndarray
    value: np.ndarray
    begin: np.ndarray
    length: np.ndarray
    pair: np.ndarray

    @classmethod
    def of(cls, owner: np.ndarray, anchor: np.ndarray) -> Anchors:
        new = np.ones(len(owner), dtype=bool)
        new[1:] = (owner[1:] != owner[:-1]) | (anchor[1:] != anchor[:-1])
        begin = np.flatnonzero(new)
        length = np.diff(np.append(begin, len(owner)))
        owner, anchor = owner[begin], anchor[begin]
        order = np.lexsort((anchor, owner))
        owner, anchor = owner[order], anchor[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (owner[1:] != owner[:-1]) | (anchor[1:] != anchor[:-1])
        pair = np.empty(len(order), dtype=np.int64)
        pair[order] = np.cumsum(new) - 1
        return cls(owner[new], anchor[new], begin, length, pair)


def _lists(of: np.ndarray, values: pa.Array, rows: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(rows + 1)).astype(np.int32)), values)


def _told(of: np.ndarray, key: np.ndarray, place: np.ndarray, salt: np.ndarray) -> list[pa.Array]:
    """Lists of keys, places and known places of each row; ``of``, the row of each entry, is in order.

    Of a key that a slice has three times or more, two entries go on and tell the other slices that it recurs. The rest
    are known to recur, so they need not meet there: a row's come as one list, at the entry with its salt and no place."""
    order = np.argsort(key, kind="stable")
    known = np.zeros(len(key), dtype=bool)
    known[order[2:]] = key[order[2:]] == key[order[:-2]]
    some = np.unique(of[known])
    row = np.concatenate([of[~known], some])
    order = np.argsort(row, kind="stable")
    keys = np.concatenate([key[~known], salt[some]])[order]
    places = np.concatenate([place[~known], np.full(len(some), -1)])[order].astype(np.int32)
    return [_lists(row[order], pa.array(keys), len(salt)), _lists(row[order], pa.array(places, mask=places < 0), len(salt)), _lists(of[known], pa.array(place[known].astype(np.int32)), len(salt))]


def _recurring(rows: DataFrame, key: str, place: str, *ids: str) -> DataFrame:
    """ids and the places (a set) of keys that occur twice or more, from the lists of ``_told``."""
    entry = F.explode(F.arrays_zip(key, place)).alias("e")
    rows = rows.select(*ids, "known", entry).select(*ids, F.col("e")[key].alias(key), F.col("e")[place].alias(place), F.when(F.col("e")[place].isNull(), F.col("known")).alias("known"))
    rows = rows.withColumn("n", F.count(place).over(Window.partitionBy(key))).where("n >= 2 or known is not null")
    return rows.select(*ids, F.explode(F.coalesce("known", F.array(place))).alias(place)).groupBy(*ids).agg(F.collect_set(place).alias(place))


def _seeds(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A text's anchors; ``at`` numbers them. One whose words may occur twice in the text comes twice."""
        for b in slices(batches):
            owner, start, _, anchor, near = windows(words(b.column("text")), span)
            k1 = b.column("k1").to_numpy(zero_copy_only=False)
            lists = [np.zeros(0, np.int64)] * 3
            if len(owner):
                found = Anchors.of(owner, anchor)
                n = len(found.text)
                twice = (np.bincount(found.pair, minlength=n) > 1) | (np.bincount(found.pair, weights=np.logical_or.reduceat(near, found.begin), minlength=n) > 0)
                nth = np.arange(n) - np.searchsorted(found.text, found.text)
                lists = [np.repeat(x, 1 + twice) for x in (found.text, found.value.view(np.int64), nth)]
            salt = combine(k1.view(np.uint64), np.arange(len(k1), dtype=np.uint64)).view(np.int64)  # copies have one k1
            yield pa.record_batch([b.column("k1"), *_told(*lists, salt)], ["k1", "anchor", "at", "known"])

    return run


def _extended(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows of the shared anchors."""
        for b in slices(batches):
            owner, start, whole, anchor, _ = windows(w := words(b.column("text")), span)
            found = Anchors.of(owner, anchor)
            shared = np.zeros(len(found.text), dtype=bool)
            bound = np.searchsorted(found.text, np.arange(b.num_rows + 1))
            at = b.column("at")
            flat, cut = at.flatten().to_numpy(zero_copy_only=False), at.value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(b.num_rows), cut)
            spot = bound[:-1][row] + flat
            shared[spot[spot < bound[1:][row]]] = True
            keep = np.flatnonzero(np.repeat(shared[found.pair], found.length))
            of = owner[keep]
            lists = _told(of, whole[keep].view(np.int64), start[keep] - w.first[:-1][of], b.column("k1").to_numpy(zero_copy_only=False))
            yield pa.record_batch([b.column("k1"), b.column("k2"), *lists], ["k1", "k2", "window", "place", "known"])

    return run


def _removed(span: int, n: int, places: np.ndarray) -> np.ndarray:
    """Which of n words lie in a repeated window."""
    step = np.zeros(n + 1, dtype=np.int32)
    step[places] += 1
    ends = np.minimum(places + span, n)
    np.add.at(step, ends, -1)
    return np.cumsum(step)[:n] > 0


def _cut(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text without the words of repeated windows."""
        for b in slices(batches):
            w, kept, gone = words(b.column("text")), [], []
            copies, place = b.column("copies").to_numpy(zero_copy_only=False), b.column("place")
            raw = w.data.tobytes()
            for i in range(b.num_rows):
                a, z = w.first[i], w.first[i + 1]
                n = int(z - a)
                if copies[i] >= 2 and n >= span:
                    drop = np.ones(n, dtype=bool)
                elif place[i].is_valid:
                    drop = _removed(span, n, np.unique(place[i].values.to_numpy()))
                else:
                    drop = np.zeros(n, dtype=bool)
                gone.append(int(drop.sum()))
                stay = np.flatnonzero(~drop) + a
                kept.append(b" ".join([raw[s:e] for s, e in zip(w.start[stay].tolist(), w.end[stay].tolist())]))
            names = [c for c in b.schema.names if c not in ("k1", "k2", "text", "copies", "place")]
            yield pa.record_batch([*(b.column(c) for c in names), pa.array(w.counts), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], [*names, "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, n_words, n_removed, kept (remaining words joined by one space) for every row.

    Null and empty texts have no words; texts shorter than span lose none; equal texts of span words or more lose all,
    as each of their windows starts in the other; rows are told apart by their text (64-bit hash and checksum), so ids
    may be null or repeat. Other columns are ignored; an empty table gives no rows.

    docs should be a scan or a stored table: the slices that a task cuts follow the order of its rows, which must be the
    same when it runs again."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumns({"k1": F.xxhash64("text"), "k2": F.crc32("text")})
    copies = keyed.select("k1", "k2", "doc_id").groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"))
    seeds = keyed.select("k1", "text").mapInArrow(_seeds(span), "k1 long, anchor array<long>, at array<int>, known array<int>")
    info = copies.join(_recurring(seeds, "anchor", "at", "k1"), "k1")
    spread = keyed.join(info, ["k1", "k2"]).where(F.col("doc_id").eqNullSafe(F.col("least"))).select("k1", "k2", "text", "at")
    spread = spread.sortWithinPartitions("k1", "k2")  # a task that runs again cuts the same slices
    found = spread.mapInArrow(_extended(span), "k1 long, k2 long, window array<long>, place array<int>, known array<int>")
    again = _recurring(found, "window", "place", "k1", "k2")
    whole = keyed.join(copies.select("k1", "k2", "copies"), ["k1", "k2"], "left").join(again, ["k1", "k2"], "left")
    return whole.select("k1", "k2", "text", "doc_id", "copies", "place").mapInArrow(_cut(span), "doc_id long, n_words long, n_removed long, kept string")


def op7_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in windows of 35 that start elsewhere too, removed; see remove_repeats for nulls, copies and repeated ids."""
    out = remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

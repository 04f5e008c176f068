"""Hard-negative mining by a secondary-sort shuffle.

Anchors meet all rows in blocks: a bounded group of anchors travels to the tasks, which multiply it with their rows.
A task keeps, of each anchor, its best rows of the same label (first pass) or the best rows of each positive's window
(second pass), as more of one task can't be among the answers. Each kept score is packed into one key of 33 bytes that
sorts by anchor, falling score, positives before negatives, and id. ``repartitionAndSortWithinPartitions`` brings an
anchor's keys together in that order, and an iterator reads them as a stream: a positive opens its window, a negative is
emitted for each open window that holds it, and a window closes when it is full. No anchor's rows are ever gathered.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.shared import discard, shared_folder, stored

N_POSITIVES, N_NEGATIVES = 5, 10
EVERY, RELABELLED, N_LABELS = 100, 7, 10
LOW, HIGH, SCALE = 30, 90, 256  # percent of the positive's score; steps of a component
GROUP_BYTES = 8 << 20  # of anchor vectors that travel to the tasks at a time
ANCHORS, ROWS = 512, 4096  # of one product
MOST = (1 << 63) - 1
BIAS = 1 << 63
KEY = np.dtype([("anchor", ">u8"), ("row", ">u8"), ("score", ">u8"), ("kind", "u1"), ("other", ">u8")])
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def numbered(vectors: DataFrame) -> DataFrame:
    """row (a number of its own), vec_id, label, vector of the rows that take part, stored: those with an id, a label and
    a vector of finite components. Repeated rows all take part, each by itself; other columns are left out."""
    d = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    d = d.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()).where(finite)
    return stored(d.select(F.monotonically_increasing_id().alias("row"), "*"), "vectors")


def _matrices(b: pa.RecordBatch, most: int) -> Iterator[tuple]:
    """Numbers, ids, labels and matrix (floor of SCALE times each component) of rows of one vector length, at most ``most``."""
    number, ids, labels = (b.column(c).to_numpy(zero_copy_only=False) for c in ("row", "vec_id", "label"))
    begin, flat = np.asarray(b.column("vector").offsets), np.asarray(b.column("vector").values)
    size = np.diff(begin)
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        for i in range(0, len(at), most):
            k = at[i : i + most]
            m = flat[begin[k][:, None] + np.arange(n)] if n else np.zeros((len(k), 0))
            yield number[k], ids[k], labels[k], np.floor(np.clip(m, -1e300, 1e300) * SCALE)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of a and b, exact; those beyond 64 bits end at the largest or least value."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m.tolist()], dtype=object).reshape(m.shape)
    return np.clip(whole(a) @ whole(b).T, -MOST, MOST).astype(np.int64)


def pack(anchor: np.ndarray, row: np.ndarray, score: np.ndarray, kind: int, other: np.ndarray) -> list[bytes]:
    """Keys that sort, as bytes, by anchor, its row, falling score, kind and id."""
    out = np.empty(len(score), KEY)
    up = lambda x: x.astype(np.int64).view(np.uint64) ^ np.uint64(BIAS)
    out["anchor"], out["row"], out["score"], out["kind"], out["other"] = up(anchor), up(row), ~up(score), kind, up(other)
    raw = out.tobytes()
    return [raw[i : i + KEY.itemsize] for i in range(0, len(raw), KEY.itemsize)]


def unpack(key: bytes) -> tuple[int, int, int, int, int]:
    """Anchor, its row, score, kind and id."""
    number = lambda i: int.from_bytes(key[i : i + 8], "big")
    return number(0) - BIAS, number(8) - BIAS, BIAS - 1 - number(16), key[24], number(25) - BIAS


def _best(found: np.ndarray, n: int) -> np.ndarray:
    """Of columns (score, id, row) the n with the highest scores, ties by smaller id and row."""
    if found.shape[1] > 8 * n:
        at = found.shape[1] - n
        found = found[:, found[0] >= np.partition(found[0], at)[at]]
    return found[:, np.lexsort((found[2], found[1], -found[0]))[:n]]


class _Kept:
    """The best n rows of each slot (an anchor, or an anchor's window) that a task has seen."""

    def __init__(self, n: int) -> None:
        self.n, self.held = n, {}

    def add(self, slot: tuple, found: np.ndarray) -> None:
        old = self.held.get(slot)
        if old is not None:
            found = found[:, found[0] >= old[0, -1]] if old.shape[1] == self.n else found
            found = np.concatenate([old, found], axis=1) if found.shape[1] else old
        if found is not old and found.shape[1]:
            self.held[slot] = _best(found, self.n)


def window(score: int) -> tuple[int, int]:
    """Least and most score of the negatives of a positive: LOW * score <= 100 * negative <= HIGH * score."""
    return -(-LOW * score // 100), HIGH * score // 100


def _keys(group: Broadcast, second: bool):
    """Packed keys of the rows of a task that an anchor of the group can need: positives, or (second) negatives.
    The group is a list of (rows, ids, labels, matrix) and of the positives' windows of each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, windows = group.value
        kept = _Kept(N_NEGATIVES if second else N_POSITIVES)
        for b in batches:
            for rows, ids, labels, m in _matrices(b, ROWS):
                for k, (a_rows, _, a_labels, a_matrix) in enumerate(anchors):
                    if a_matrix.shape[1] != m.shape[1]:
                        continue
                    for i, s in enumerate(products(a_matrix, m)):
                        found = np.stack([s, ids, rows])
                        if second:
                            found = found[:, labels != a_labels[i]]
                            for j, (low, high) in enumerate(windows[k][i]):
                                kept.add((k, i, j), found[:, (found[0] >= low) & (found[0] <= high)])
                        else:
                            kept.add((k, i), found[:, (labels == a_labels[i]) & (rows != a_rows[i])])
        of: dict[tuple, list] = {}
        for slot, found in kept.held.items():
            of.setdefault(slot[:2], []).append(found)
        for (k, i), parts in of.items():
            found = np.concatenate(parts, axis=1)
            found = found[:, np.unique(found[2], return_index=True)[1]]  # a row in two windows is one key
            n = found.shape[1]
            keys = pack(np.full(n, anchors[k][1][i]), np.full(n, anchors[k][0][i]), found[0], int(second), found[1])
            yield pa.record_batch([pa.array(keys, pa.binary())], ["key"])

    return run


def _sorted(keys: DataFrame):
    """An RDD of the keys: those of an anchor in one partition, in order."""
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keys.rdd.map(lambda r: (bytes(r[0]), None)).repartitionAndSortWithinPartitions(n, lambda k: zlib.crc32(k[:16]) % n).map(lambda kv: kv[0])


def first_positives(keys: Iterable[bytes]) -> Iterator[bytes]:
    """The first N_POSITIVES keys of each anchor, from sorted keys."""
    now, n = None, 0
    for key in keys:
        now, n = (now, n + 1) if key[:16] == now else (key[:16], 1)
        if n <= N_POSITIVES:
            yield key


def stream(keys: Iterable[bytes]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Rows of RESULT from sorted keys of positives (kind 0) and negatives (1). At most N_POSITIVES windows are open."""
    now, positives, open_ = None, 0, []
    for key in keys:
        if key[:16] != now:
            now, positives, open_ = key[:16], 0, []
        anchor, _, score, kind, other = unpack(key)
        if kind == 0:
            positives += 1
            if positives <= N_POSITIVES:
                open_.append([score, other, *window(score), 0])
            continue
        for w in open_:
            if w[2] <= score <= w[3]:
                w[4] += 1
                yield anchor, w[1], w[4], other, w[0], score
        open_ = [w for w in open_ if w[4] < N_NEGATIVES and score >= w[2]]


def _groups(anchors: DataFrame) -> int:
    """So many groups by hash that none has over twice GROUP_BYTES, unless in one row."""
    size = 64 + 8 * F.size("vector")
    n = max(1, -(-(anchors.agg(F.sum(size).alias("n")).first()["n"] or 0) // GROUP_BYTES))
    while True:
        worst = anchors.groupBy(_group(n)).agg(F.sum(size).alias("bytes"), F.count("*").alias("rows")).where(F.col("rows") > 1).agg(F.max("bytes").alias("n")).first()["n"]
        if (worst or 0) <= 2 * GROUP_BYTES:
            return n
        n *= 2


def _group(n: int):
    return F.pmod(F.xxhash64("row"), F.lit(n))


def hard_negatives(vectors: DataFrame) -> DataFrame:
    """Columns of RESULT, from columns vec_id, label and embedding of the table.

    Anchors are the rows whose vec_id is divisible by EVERY. Rows with a null or non-finite value, or without an id, take
    no part; vectors of different lengths are never compared; repeated rows all take part. Equal scores come by smaller
    id. A positive of a negative score has no negatives; one of zero has those of score zero. An empty table gives none."""
    spark = vectors.sparkSession
    rows = numbered(vectors)
    anchors = stored(rows.where(F.col("vec_id") % EVERY == 0), "anchors")
    n, path = _groups(anchors), f"{shared_folder(spark)}/negatives-{uuid.uuid4().hex}"
    spark.createDataFrame([], RESULT).write.parquet(path)
    for g in range(n):
        batch = anchors.where(_group(n) == g).toArrow().combine_chunks()  # of bounded size, see _groups
        blocks = [x for b in batch.to_batches() for x in _matrices(b, ANCHORS)]
        if not blocks:
            continue
        first = spark.sparkContext.broadcast((blocks, None))
        positives = sorted(first_positives_of(rows, first))
        of: dict[int, list] = {}
        for key in positives:
            _, row, score, _, _ = unpack(key)
            of.setdefault(row, []).append(window(score))
        both = spark.sparkContext.broadcast((blocks, [[[w for w in of.get(r, []) if w[0] <= w[1]] for r in block[0].tolist()] for block in blocks]))
        keys = rows.mapInArrow(_keys(both, True), "key binary").union(spark.createDataFrame([(k,) for k in positives], "key binary"))
        spark.createDataFrame(_sorted(keys).mapPartitions(stream), RESULT).write.mode("append").parquet(path)
        first.unpersist()
        both.unpersist()
    discard(rows)
    discard(anchors)
    return spark.read.schema(RESULT).parquet(path)


def first_positives_of(rows: DataFrame, group: Broadcast) -> list[bytes]:
    """Keys of the positives of a group's anchors, at most N_POSITIVES each."""
    return _sorted(rows.mapInArrow(_keys(group, False), "key binary")).mapPartitions(first_positives).collect()


def op11_secondary_sort_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the embeddings; where vec_id is divisible by RELABELLED, the label is the next one."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % RELABELLED == 0, (F.col("label") + 1) % N_LABELS).otherwise(F.col("label"))
    return hard_negatives(vectors.select("vec_id", "embedding", label.alias("label")))

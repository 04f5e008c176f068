"""Shards of near equal bytes by histogram sort.

Rows are ordered by (hash of the text, hash of id and text), so equal texts lie together. Splitters are found by
counting: each round adds up the exact bytes below equally spaced probes inside every open bracket (a pre-aggregated
groupBy of at most PROBES rows a bracket), keeps the probe interval that holds the target, and stops once the bracket
holds less than the tolerance. A group of copies heavier than that is cut by the second hash. Only then are the rows
exchanged, once, by (shard, slot cell).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.llm.shared import documents, stored

BITS = 8  # a round's probes cut a bracket into 2**BITS parts
ROUNDS = 16  # both 64-bit keys to the last bit
TOLERANCE = 0.001  # of a shard's mean bytes


@dataclass
class Bracket:
    """A splitter's target, and the key prefix (of ``depth`` rounds) known to hold it, with the bytes below it."""

    target: int
    prefix: int = 0
    depth: int = 0
    below: int = 0
    done: bool = False


def _digits(depth: int) -> Column:
    """The next BITS bits of the key after ``depth`` rounds."""
    per = 64 // BITS
    key = F.col("key_hi") if depth < per else F.col("key_lo")
    return F.shiftrightunsigned(key, 64 - BITS * (depth % per + 1)).bitwiseAND((1 << BITS) - 1)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _within(bracket: Bracket) -> Column:
    """The row's key begins with the bracket's prefix."""
    used = BITS * bracket.depth
    hi_bits, lo_bits = min(used, 64), max(used - 64, 0)
    hi = bracket.prefix >> lo_bits
    test = F.lit(True)
    if hi_bits:
        test = F.shiftrightunsigned("key_hi", 64 - hi_bits) == F.lit(_signed(hi)) if hi_bits < 64 else F.col("key_hi") == F.lit(_signed(hi))
    if lo_bits:
        test = test & (F.shiftrightunsigned("key_lo", 64 - lo_bits) == F.lit(bracket.prefix & ((1 << lo_bits) - 1)))
    return test


def splitters(rows: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """shards - 1 unsigned keys (hi, lo); a row belongs to the shard that counts the splitters not above its key.
    rows: key_hi, key_lo, size."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    brackets = [Bracket(total * k // shards) for k in range(1, shards)]
    slack = max(1, int(total / shards * tolerance))
    for depth in range(ROUNDS):
        open_ = {b.prefix: None for b in brackets if not b.done}
        if not open_:
            break
        place = F.lit(None).cast("int")
        for i, prefix in enumerate(open_):
            place = F.when(_within(Bracket(0, prefix, depth)), i).otherwise(place)
        counts = rows.select(place.alias("place"), _digits(depth).cast("int").alias("digit"), "size").where("place is not null").groupBy("place", "digit").agg(F.sum("size").alias("bytes"))
        found: dict[int, list[tuple[int, int]]] = {}
        for r in counts.collect():  # at most (shards - 1) * 2**BITS rows
            found.setdefault(r["place"], []).append((r["digit"], r["bytes"]))
        for i, prefix in enumerate(open_):
            cells = sorted(found.get(i, []))
            for b in (b for b in brackets if not b.done and b.prefix == prefix):
                below = b.below
                digit, size = cells[-1] if cells else (0, 0)
                for digit, size in cells:
                    if below + size > b.target:
                        break
                    below += size
                else:
                    below -= size
                b.prefix, b.depth, b.below = (prefix << BITS) | digit, depth + 1, below
                if min(b.target - below, below + size - b.target) <= slack or depth == ROUNDS - 1:
                    b.done = True
                    if below + size - b.target < b.target - below:
                        b.prefix += 1
    out = []
    for b in brackets:
        key = b.prefix << (128 - BITS * b.depth)
        key = min(key, (1 << 128) - 1)
        out.append((key >> 64, key & ((1 << 64) - 1)))
    return sorted(out)


def _below(hi: int, lo: int) -> Column:
    """The splitter isn't above the row's key; unsigned comparison by flipping the sign bit."""
    flip = -(1 << 63)
    h, l_ = F.col("key_hi").bitwiseXOR(F.lit(flip)), F.col("key_lo").bitwiseXOR(F.lit(flip))
    at_h, at_l = _signed(hi ^ (1 << 63)), _signed(lo ^ (1 << 63))
    return (h > F.lit(at_h)) | ((h == F.lit(at_h)) & (l_ >= F.lit(at_l)))


def shard_rows(rows: DataFrame, shards: int, tolerance: float = TOLERANCE, counted: DataFrame | None = None) -> DataFrame:
    """Adds shard (int) and slot (long, gapless from 0 in a shard) to rows that have key_hi, key_lo and size.

    Counts are made on ``counted``, the stored keys and sizes of the rows (default: rows, read several times). Slots follow
    cells of the key; the cells' counts give each its first slot, so no task orders a whole shard. Equal keys of equal rows
    take any order."""
    counted = rows if counted is None else counted
    cuts = splitters(counted, shards, tolerance)
    shard = F.lit(0)
    for hi, lo in cuts:
        shard = shard + F.when(_below(hi, lo), 1).otherwise(0)
    cell = F.shiftrightunsigned("key_hi", 52) * 64 + F.shiftrightunsigned("key_lo", 58)
    place = {"shard": shard.cast("int"), "cell": cell.cast("int")}
    placed = rows.withColumns(place)
    counts = counted.withColumns(place).groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    begins = counts.select("shard", "cell", F.coalesce(before, F.lit(0)).alias("begin"))
    rank = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("key_hi", "key_lo", *[c for c in ("doc_id",) if c in rows.columns]))
    return placed.withColumn("rank", rank).join(begins, ["shard", "cell"]).withColumn("slot", F.col("begin") + F.col("rank") - 1).drop("begin", "rank", "cell")


def keyed(docs: DataFrame, keep: list) -> DataFrame:
    """keep columns plus size (UTF-8 bytes + 1; null text: 1), text_crc32 and the sort keys."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        *keep,
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("key_hi"),
        F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("row"), text).alias("key_lo"),
    )


def shard_documents(docs: DataFrame, shards: int = 16, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    Law ``bytes``: shards hold near equal sums of size (within tolerance of the mean and the largest text). Null texts
    have size 1 and the checksum of the empty text, null ids stay rows of their own, repeated rows are each placed,
    an empty table gives no rows; other columns are ignored."""
    rows = stored(keyed(docs, ["doc_id"]), "shard-keys")
    placed = shard_rows(rows, shards, tolerance)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def shard_columns(docs: DataFrame, shards: int = 16, tolerance: float = TOLERANCE) -> DataFrame:
    """All columns of docs and shard and slot, by the law of shard_documents; columns of docs with these two names are
    replaced, all others stay whatever they are called. Rows with a null id or text and repeated rows are each placed;
    an empty table gives no rows.

    The splitters come from the keys alone; the rows cross the network once, with their shard."""
    keep = [docs[c] for c in docs.columns if c.lower() not in ("shard", "slot")]
    keys = stored(keyed(docs, []).select("key_hi", "key_lo", "size"), "shard-keys")
    placed = shard_rows(keyed(docs, [F.struct(*keep).alias("row")]), shards, tolerance, counted=keys)
    return placed.select("row.*", "shard", F.col("slot").cast("long").alias("slot"))


def op10_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 15 of near equal bytes; see shard_documents for nulls, repeated rows and empty tables."""
    return shard_documents(documents(spark, sf_dir))

"""Mixing sources to target weights by entropy balancing.

Document rates minimise the Kullback-Leibler divergence from rate 1 under one token constraint a source, so they are
exponentially tilted: rate = min(cap, exp(lambda_source * size / scale_source)). The dual is convex and separates by
source; its Newton iterations run as Spark aggregations over a (source, size) histogram, all sources at once, with a
bracket that catches steps too long. Sums are of integers (rates in 2**-20), so that reruns agree to the bit. Rates are
then rounded into whole copies: within a source sizes are taken from large to small and each size's copies are rounded
with the tokens carried over, which leaves an error of about half the smallest text.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.llm.shared import SPACES, documents, stored

CAP = 3
UNIT = 1 << 20
STEPS = 40
TOLERANCE = 1e-4
BUCKETS = 128


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACES}]+")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Orders by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def source_targets(hist: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """skey, source_size, mean size, target: shares of all words by weight, at most cap times the source's own.

    The excess is reshared by weight until none is above: sources sorted by cap * size / weight are capped up to the
    first whose share of the rest fits. One row a source, so these windows are small."""
    sources = hist.groupBy("skey").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.max("size").alias("largest"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy("skey")) - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("weight", weight.cast("double")).withColumn("limit", (F.col("source_size") * cap).cast("double"))
    by = Window.orderBy(F.col("limit") / F.col("weight"), "skey")
    capped = F.coalesce(F.sum("limit").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("source_size").over(Window.partitionBy()) - capped
    level = rest / F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumns({"level": level, "rank": F.row_number().over(by)})
    fits = F.when(F.col("limit") / F.col("weight") >= F.col("level"), F.struct("rank", "level"))
    s = s.withColumn("chosen", F.min(fits).over(Window.partitionBy())["level"])
    return s.select("skey", "source_size", "largest", F.least("limit", F.coalesce(F.col("chosen") * F.col("weight"), F.col("limit"))).alias("target"))


def rate(cap: int = CAP) -> Column:
    """A document's rate in units of 1/UNIT, for columns lam, size and largest."""
    tilt = F.exp(F.least(F.col("lam") * F.col("size") / F.greatest(F.col("largest"), F.lit(1)), F.lit(20.0)))
    return F.least(F.round(tilt * UNIT), F.lit(float(cap * UNIT))).cast("long")


def balance(hist: DataFrame, targets: DataFrame, cap: int = CAP) -> DataFrame:
    """The dual's solution lam for each source. Newton on g(lam) = sum of rate * size, guarded by a bracket.

    A source is done within TOLERANCE of its target, or within one unit of rate for all its texts; if one isn't after
    STEPS, this fails."""
    state = stored(targets.withColumns({"lam": F.lit(0.0), "lo": F.lit(-1e7), "hi": F.lit(1e7), "done": F.lit(False)}), "mix-state")
    for _ in range(STEPS):
        tilted = hist.join(state, "skey").withColumn("rate", rate(cap))
        tokens = F.col("rate").cast("decimal(38,0)") * F.col("size") * F.col("n")
        slope = F.when(F.col("rate") < cap * UNIT, tokens.cast("double") * F.col("size") / F.greatest(F.col("largest"), F.lit(1))).otherwise(0).cast("decimal(38,0)")
        sums = tilted.groupBy("skey").agg((F.sum(tokens).cast("double") / UNIT).alias("got"), (F.sum(slope).cast("double") / UNIT).alias("slope"))
        s = state.join(sums, "skey")
        s = s.withColumns({"done": F.abs(F.col("got") - F.col("target")) <= F.greatest(TOLERANCE * F.col("target"), F.col("source_size") / UNIT), "lo": F.when(F.col("got") < F.col("target"), F.col("lam")).otherwise(F.col("lo")), "hi": F.when(F.col("got") > F.col("target"), F.col("lam")).otherwise(F.col("hi"))})
        newton = F.col("lam") + (F.col("target") - F.col("got")) / F.nullif(F.col("slope"), F.lit(0.0))
        middle = F.when(F.col("hi") >= 1e7, F.greatest(F.col("lo") * 4, F.lit(1.0))).when(F.col("lo") <= -1e7, F.least(F.col("hi") * 4, F.lit(-1.0))).otherwise((F.col("lo") + F.col("hi")) / 2)
        inside = (newton > F.col("lo")) & (newton < F.col("hi")) & (F.abs(newton - F.col("lam")) <= F.greatest(F.lit(2.0), 2 * F.abs(F.col("lam"))))
        s = s.withColumn("lam", F.when(F.col("done"), F.col("lam")).when(inside, newton).otherwise(middle))
        state = stored(s.select(state.columns), "mix-state")
        left = state.where("not done")
        if left.isEmpty():
            return state
    raise RuntimeError(f"after {STEPS} steps {left.count()} sources are off their targets, such as {left.first()}")


def round_copies(rows: pd.DataFrame) -> pd.DataFrame:
    """For one source's sizes, whole copies for all (floor) and how many texts get one more (extra), carrying tokens.
    Whole numbers throughout; no text gets more than CAP copies."""
    rows = rows.sort_values("size", ascending=False)
    floor, extra, carry = [], [], 0
    for size, n, rate_ in zip(rows["size"].tolist(), rows["n"].tolist(), rows["rate"].tolist()):
        total = 0
        if size:
            want = rate_ * n * size + carry
            total = min(max((2 * want + size * UNIT) // (2 * size * UNIT), 0), CAP * n)
            carry = want - total * size * UNIT
        floor.append(total // n)
        extra.append(total % n)
    return rows.assign(floor=floor, extra=extra)[["skey", "size", "floor", "extra"]]


def _mixed(docs: DataFrame, keep: list[str], weights: tuple[int, ...], cap: int) -> DataFrame:
    """row (a struct of the columns keep), size, source_size, target and copies of every row."""
    rows = docs.select(F.struct(*[docs[c] for c in keep] or [F.lit(None).alias("none")]).alias("row"), word_count(docs["text"]).alias("size"), source_key(docs["source"]).alias("skey"), F.xxhash64(F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.coalesce(docs["text"], F.lit(""))).alias("_h"), docs["doc_id"].alias("_id")).withColumn("_bucket", F.pmod("_h", F.lit(BUCKETS)).cast("int"))
    fine = stored(rows.groupBy("skey", "size", "_bucket").agg(F.count("*").alias("m")), "mix-sizes")
    hist = stored(fine.groupBy("skey", "size").agg(F.sum("m").alias("n")), "mix-histogram")
    state = balance(hist, source_targets(hist, weights, cap), cap)
    rated = hist.join(state, "skey").withColumn("rate", rate(cap))
    rounded = rated.select("skey", "size", "n", "rate").groupBy("skey").applyInPandas(round_copies, "skey string, size long, floor long, extra long")
    w = Window.partitionBy("skey", "size").orderBy("_bucket")
    total, upto = F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.sum("m").over(w)
    spread = fine.join(rounded, ["skey", "size"]).withColumns({"total": total, "upto": upto})
    share = F.floor((F.col("extra") * F.col("upto")) / F.col("total")) - F.floor((F.col("extra") * (F.col("upto") - F.col("m"))) / F.col("total"))
    plan = stored(spread.withColumn("more", share).join(state.select("skey", "source_size", "target"), "skey").select("skey", "size", "_bucket", "floor", "more", "source_size", "target"), "mix-plan")
    rank = F.row_number().over(Window.partitionBy("skey", "size", "_bucket").orderBy("_h", "_id"))
    out = rows.withColumn("rank", rank).join(plan, ["skey", "size", "_bucket"])
    copies = F.when(F.col("size") == 0, 1).otherwise(F.least(F.col("floor") + (F.col("rank") <= F.col("more")).cast("long"), F.lit(cap)))
    return out.select("row", "size", "source_size", "target", copies.cast("int").alias("copies"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP, keep: list[str] | None = None) -> DataFrame:
    """Every row with its size, source_size, target and copies (0 to cap), after the columns ``keep`` (all).

    Null text or no words: size 0, one copy. A null source is a source, the last. Rows alike in source and size share a
    rate; a hash of id and text decides who gets the extra copy, so reruns agree and repeated rows are interchangeable.
    Columns of docs that have one of the four names are replaced, all others stay whatever they are called; an empty
    table stays empty."""
    keep = [c for c in keep or docs.columns if c.lower() not in ("size", "source_size", "target", "copies")]
    return _mixed(docs, keep, weights, cap).select("row.*", "size", "source_size", "target", "copies")


def repeat_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with exactly the columns of docs; see mix_documents."""
    times = F.array_repeat(F.lit(0), F.col("copies"))
    return _mixed(docs, docs.columns, weights, cap).select("row", F.explode(times).alias("nth")).select("row.*")


def op2_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of each document; see mix_documents for null texts and sources, repeated rows and empty tables."""
    mixed = mix_documents(documents(spark, sf_dir), keep=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies")

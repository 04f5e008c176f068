"""Personal data by candidate gradient boosting, in DataFrame functions only.

Generators of high recall propose overlapping spans: the base patterns before their checks, looser numbers, addresses
with spelled-out signs and IPv6. Each candidate gets format and context features. The labels are none of them: a base
candidate is positive if it passes its checks (Luhn, ranges, digits), a loose one if a cue word such as "mail" or "phone"
stands before it. So the trees learn which forms people announce as personal data, and decide on every loose candidate,
announced or not. The trees are fitted on all candidates. For each kind the threshold is the least score from which on
PRECISION of all loose candidates are positive, each scored by trees that were fitted on the other folds (FOLDS in all); a
kind with fewer than SUPPORT of them there adds nothing. The trees become one SQL
expression, so scoring stays a projection without a shuffle. Base spans are kept whatever the model says; a loose span is
added where it scores enough and overlaps no base span.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.shared import documents, stored

KINDS = ("email", "ip", "card", "phone")
TREES, DEPTH = 10, 3
FOLDS = 2
BINS = 1024  # values of a feature that splits are tried at, at least
PRECISION, SUPPORT = 0.9, 20
CHUNK = 256  # matches whose places are added up at a time
LOCAL = "[A-Za-z0-9._%+-]"
# The base patterns; possessive and with bounds that spare retries, the matches are the same.
BASE = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"(?<!{LOCAL}){LOCAL}++\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]++\x20?(?:\.|\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z]{{2,}}",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z.,/-])[0-9]{4}(?:[./_-][0-9]{4}){2,3}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+.,/-])\(?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9A-Za-z])",
}
GUARD = {"email": "@", "phone": "+"}
DIGITS = r"[0-9]"
CUES = {"email": r"(?i)(mail|contact|write|reach)", "ip": r"(?i)(\bip\b|host|server|addr)", "card": r"(?i)(card|visa|credit|debit|pay|account)", "phone": r"(?i)(phone|tel|call|fax|mobile|cell|contact)"}
FEATURES = ("length", "digits", "groups", "plus", "at", "dots", "dashes", "spaces", "brackets", "upper", "before", "after", "distinct", "shape")


def _spans(text: Column, pattern: str) -> Column:
    """array<struct<start, match, near, after>> of the leftmost non-overlapping matches, code points, with up to 24
    characters before and one after that belong to no match. The pieces between matches and the matches add up to the
    positions, in chunks, as a list that grows by one is copied each time."""
    gaps = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(gaps, matches, lambda gap, match: F.struct(F.length(gap).alias("gap"), match.alias("match"), F.right(gap, F.lit(24)).alias("near")))
    steps = F.zip_with(steps, F.transform(F.slice(gaps, 2, F.size(gaps)), lambda gap: F.left(gap, F.lit(1))), lambda s, after: F.struct(s["gap"].alias("gap"), s["match"].alias("match"), s["near"].alias("near"), after.alias("after")))
    none = F.array().cast("array<struct<start:int,match:string,near:string,after:string>>")
    add = lambda acc, s: F.struct((acc["at"] + s["gap"] + F.length(s["match"])).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + s["gap"]).alias("start"), s["match"].alias("match"), s["near"].alias("near"), s["after"].alias("after")))).alias("out"))
    chunk = lambda acc, c: F.aggregate(c, F.struct(acc["at"].alias("at"), none.alias("out")), add, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["all"], F.array(x["out"])).alias("all")))

    def placed(s: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 2) / CHUNK).cast("int")), lambda i: F.slice(s, i * CHUNK + 1, F.least(F.lit(CHUNK), F.size(s) - 1 - i * CHUNK)))
        found = F.aggregate(chunks, F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,match:string,near:string,after:string>>>").alias("all")), chunk, lambda acc: F.flatten(acc["all"]))
        return F.when(F.size(s) > 1, found).otherwise(none)  # the last piece has no match behind it

    return F.transform(F.array(steps), placed)[0]  # so that the steps are found once, not once a chunk


def _passes(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.when(F.length(F.ltrim(p, F.lit("0"))) <= 3, F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255).otherwise(False))
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), F.call_function("luhn_check", digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _features(kind: str, strict: bool, match: Column, near: Column, after: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = lambda c: F.length(match) - F.length(F.replace(match, F.lit(c)))
    values = (
        F.length(match), F.length(digits), F.size(F.split(match, "[^0-9]+")), n("+"), n("@"), n("."), n("-"), n(" "), n("(") + n("[") + n(")") + n("]"), F.length(F.regexp_replace(match, "[^A-Z]", "")),
        near.rlike("[A-Za-z0-9]$"), after.rlike("[A-Za-z0-9]"), F.size(F.array_distinct(F.split(digits, ""))), F.lit(2 * KINDS.index(kind) + strict),
    )
    return F.array(*[v.cast("int") for v in values])


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and found: array of struct(start, rank, end, strict, valid, features), every proposed span of the text.
    valid: it passes its checks, or, for a loose one, a cue word stands before it."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    empty = F.array().cast("array<struct<start:int,match:string,near:string,after:string>>")
    number = F.col("text").rlike(DIGITS)
    lists = []
    for strict, patterns in ((True, BASE), (False, LOOSE)):
        for k, (kind, pattern) in enumerate(patterns.items()):
            guard = F.contains("text", F.lit(GUARD[kind])) if strict and kind in GUARD else F.regexp_like("text", F.lit(r"\(at\)|\[at\]|\x20at\x20")) if kind == "email" else number
            spans = F.when(guard, _spans(F.col("text"), pattern)).otherwise(empty)
            lists.append(F.transform(spans, _candidate(k, kind, strict)))
    return rows.select("doc_id", F.concat(*lists).alias("found"))


def _candidate(k: int, kind: str, strict: bool):
    def one(s: Column) -> Column:
        return F.struct(
            s["start"].alias("start"), F.lit(k).alias("rank"), (s["start"] + F.length(s["match"])).alias("end"), F.lit(strict).alias("strict"),
            (_passes(kind, s["match"]) if strict else s["near"].rlike(CUES[kind])).alias("valid"), _features(kind, strict, s["match"], s["near"], s["after"]).alias("features"),
        )

    return one


def _tree(node, features: Column) -> Column:
    """A regression tree as nested CASE."""
    if node.subtreeDepth() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(features[split.featureIndex()] <= float(split.threshold()), _tree(node.leftChild(), features)).otherwise(_tree(node.rightChild(), features))


def bins(rows: int) -> int:
    """maxBins for so many training rows. Spark looks for splits in a sample if there are more than its square, so there never are."""
    return max(BINS, math.isqrt(max(rows - 1, 0)) + 1)


def _fit(rows: DataFrame):
    """A function from a features column to a score, by trees fitted on all rows (label, features, n: how many there are)."""
    vectors = rows.groupBy("label", "features").agg(F.sum("n").alias("n")).select("label", "n", array_to_vector(F.col("features").cast("array<double>")).alias("vector"))
    vectors = stored(vectors, "pii-vectors")  # each tree reads them several times
    model = GBTClassifier(featuresCol="vector", labelCol="label", weightCol="n", maxBins=bins(vectors.count()), maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7).fit(vectors)
    roots, weights = [t._java_obj.rootNode() for t in model.trees], list(model.treeWeights)

    def score(features: Column) -> Column:
        margin = sum((_tree(r, features) * float(w) for r, w in zip(roots, weights)), F.lit(0.0))
        return 1 / (1 + F.exp(-2 * margin))

    return score


def train(found: DataFrame):
    """A function from a features column to a score, and the threshold of each kind (None: none reaches PRECISION); None
    where a label has fewer than 10 candidates, in all or outside a fold.

    All candidates take part in the trees and in the thresholds: equal ones (label, features, fold) are counted, and the
    trees are fitted on the different ones with their numbers as weights, which are few, as features are small whole
    numbers. The score that is compared with a threshold comes from all, those that set it from the other folds."""
    c = found.select("doc_id", F.explode("found").alias("c")).select("doc_id", "c.*").withColumns({"label": F.col("valid").cast("double"), "fold": F.pmod(F.xxhash64("doc_id", "start", "rank"), F.lit(FOLDS)).cast("int")})
    rows = stored(c.groupBy("label", "strict", "rank", "fold", "features").agg(F.count("*").cast("double").alias("n")), "pii-train")
    counts = {(r["label"], r["fold"]): r["n"] for r in rows.groupBy("label", "fold").agg(F.sum("n").alias("n")).collect()}
    if min(sum(n for (x, f), n in counts.items() if x == label and f != fold) for label in (0.0, 1.0) for fold in range(FOLDS)) < 10:
        return None
    score, others = _fit(rows), [_fit(rows.where(F.col("fold") != fold)) for fold in range(FOLDS)]
    own = reduce(lambda rest, fold: F.when(F.col("fold") == fold, others[fold](F.col("features"))).otherwise(rest), range(FOLDS), F.lit(0.0))
    held = rows.where("not strict").groupBy("rank", F.floor(own * 100).cast("int").alias("bin")).agg(F.sum(F.col("label") * F.col("n")).alias("good"), F.sum("n").alias("n"))
    thresholds: list[float | None] = [None] * len(KINDS)
    seen = [[0.0, 0] for _ in KINDS]
    for r in sorted(held.collect(), key=lambda r: -r["bin"]):  # at most 101 rows a kind
        total = seen[r["rank"]]
        total[0], total[1] = total[0] + r["good"], total[1] + r["n"]
        if total[0] >= PRECISION * total[1] and total[1] >= SUPPORT:
            thresholds[r["rank"]] = r["bin"] / 100
    return score, thresholds


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, base and added: arrays of struct(start, rank, end), rank the kind's place in KINDS, code points, end
    exclusive, by start and kind; one row for every row of docs.

    A null or empty text has none, ids may be null or repeat, other columns are ignored, an empty table gives no rows."""
    found = stored(candidates(docs), "pii-candidates")
    model = train(found)
    place = lambda c: F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["end"].alias("end"))
    base = F.transform(F.filter("found", lambda c: c["strict"] & c["valid"]), place)
    rows = found.withColumn("base", F.array_sort(base))
    if model is None or all(t is None for t in model[1]):
        return rows.select("doc_id", "base", F.filter("base", lambda c: F.lit(False)).alias("added"))
    score, thresholds = model
    loose = F.filter("found", lambda c: ~c["strict"])
    sure = F.filter(loose, lambda c: score(c["features"]) >= F.element_at(F.array(*[F.lit(2.0 if t is None else t) for t in thresholds]), c["rank"] + 1))
    clear = F.filter(sure, lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return rows.select("doc_id", "base", F.array_sort(F.array_distinct(F.transform(clear, place))).alias("added"))


def redact(docs: DataFrame) -> DataFrame:
    """doc_id and spans of all found data with their kind, for masking; nulls, repeats and empty tables as in find_pii."""
    return find_pii(docs).select("doc_id", F.transform(F.array_sort(F.concat("base", "added")), lambda s: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1).alias("kind"), s["start"], s["end"])).alias("spans"))


def _joined(spans: Column) -> Column:
    name = lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, name), ",")


def _of(k: int):
    return lambda s: s["rank"] == k


def op1_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and added spans of all documents; see find_pii for null and repeated texts and ids."""
    found = find_pii(documents(spark, sf_dir))
    counts = [F.size(F.filter("base", _of(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"))

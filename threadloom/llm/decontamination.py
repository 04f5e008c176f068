"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, units after numbers, and names (capitalised words inside a sentence) become typed placeholders; the rest is
lower-cased words. All windows of WINDOW template words of documents and of items are joined on their hash; an item of
fewer words is one window, which documents are cut for at its length too. A capitalised word that opens a window may be
a name there and none here, as that depends on what is before it: such windows are cut in both forms. Words and numbers
as they stand are a second form of every text, so that a shared run of WINDOW of them can't be missed whatever its case
and line breaks. Slots of matched windows are then paired, for each place where the item lies: a re-parameterised copy
maps each value of the item to one value of the document, whichever it is. Windows of numbers with few plain words say
little alone, so the plain words of all windows of a place are counted together. An item of fewer than FEW words is
looked for as a whole sentence only, with its own values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.shared import documents, small_side, stored, unused

WINDOW, LITERALS, FEW = 10, 6, 4
LEAST_FLAGS, MOST_FLAGS = 1 << 12, 1 << 21  # bits of the map that keeps most windows without a match from being cut
SENTENCE_END = r"(?<=[.!?])\s+|\n+"
# Loops over groups are possessive, as Java calls itself for each turn of any other: a text of some thousand names or parts
# of a number in a row would overflow the stack, which ends the executor. Nothing stands behind them that a turn is given back for.
NUMBER = r"[0-9]+(?:[.,:/][0-9]+)*+"
UNIT_NAME = r"(?:\x20?(?:kg|km|cm|mm|mg|ml|hours?|hrs?|minutes?|mins?|seconds?|days?|weeks?|years?|miles?|meters?|metres?|dollars?|euros?|percent|litres?|liters?)(?![\p{L}0-9])|\x20?[%$€])"
UNIT = rf"(?<=[0-9]){UNIT_NAME}"
# What must stand before a name is asked after its first letter, so that a search looks behind at few places only.
NAME = r"\p{Lu}(?<=[\p{Ll},;]\x20\p{Lu})\p{Ll}+(?:\x20\p{Lu}\p{Ll}+)*+"
INITIAL_NAME = r"\p{Lu}(?<![\p{Ll},;]\x20\p{Lu})(?<![\p{L}\uE002]\p{Lu})\p{Ll}++(?!\p{L})"
# Private-use characters that open a number, a unit and a name, close a slot, and stand before a capitalised word that is
# no slot; such characters of a text are dropped.
OPEN_NUMBER, OPEN_UNIT, OPEN_NAME, CLOSE, INITIAL = (chr(0xE000 + i) for i in range(5))
TOKEN = f"\\p{{L}}+|{INITIAL}\\p{{L}}+|[{OPEN_NUMBER}-{OPEN_NAME}][^{CLOSE}]*{CLOSE}"
TEMPLATE, LITERAL = 1, 0


def tokens(text: Column) -> Column:
    """Template words; a slot is its mark and its value, INITIAL stands before a word that begins a sentence."""
    return _tokens(_plain(text))


def _tokens(plain: Column) -> Column:
    text = F.regexp_replace(plain, f"([0-9]){UNIT_NAME}", f"$1 {OPEN_UNIT}{CLOSE} ")  # UNIT: no match ends in a digit
    text = F.regexp_replace(text, NAME, f"{OPEN_NAME}$0{CLOSE}")
    text = F.regexp_replace(text, INITIAL_NAME, f"{INITIAL}$0")
    text = F.regexp_replace(text, NUMBER, f"{OPEN_NUMBER}$0{CLOSE}")
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _plain(text: Column) -> Column:
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(text.rlike(f"[{OPEN_NUMBER}-{INITIAL}]"), F.translate(text, OPEN_NUMBER + OPEN_UNIT + OPEN_NAME + CLOSE + INITIAL, "     ")).otherwise(text)


def _slot(token: Column) -> Column:
    return (token >= OPEN_NUMBER) & (token < CLOSE)


def _mark(token: Column) -> Column:
    return F.when(_slot(token), F.left(token, F.lit(1))).otherwise(token)


def _bare(token: Column) -> Column:
    return F.when(token.startswith(INITIAL), F.substr(token, F.lit(2))).otherwise(token)


def _texts(rows: DataFrame, key: str) -> DataFrame:
    """key, row (a hash of the text) and, for each form, its tokens t (template words that begin sentences after INITIAL)
    and their hashes h."""
    rows = rows.select(F.col(key).cast("long").alias(key), "text").where(f"{key} is not null")
    rows = rows.select(key, F.xxhash64("text").alias("row"), _plain(F.col("text")).alias("plain"))
    rows = rows.select(key, "row", F.regexp_extract_all(F.lower("plain"), F.lit(NUMBER + r"|\p{L}+"), F.lit(0)).alias("t0"), _tokens(F.col("plain")).alias("t1"))
    marked = lambda t: F.when(t < OPEN_NUMBER, t).when(t < CLOSE, F.left(t, F.lit(1))).otherwise(_bare(t))
    return rows.withColumns({"h0": F.transform("t0", lambda t: F.xxhash64(t)), "h1": F.transform("t1", lambda t: F.xxhash64(marked(t)))})


def _spots(lengths: list[tuple[int, Column]], whole: bool = False) -> Column:
    """A number for each window of the given forms and lengths (whole: those that are the whole text): 16 times its place in
    the tokens of both forms, one after the other, and its length."""
    none, parts = F.array().cast("array<bigint>"), []
    for form, n in lengths:
        size, first = F.size(f"t{form}").cast("long"), (n + 16 * F.size("t0") * form).cast("long")
        fits = (size == n) if whole else (size >= n)
        parts.append(F.when(fits & (size > 0), F.sequence(first, (size - n) * 16 + first, F.lit(16).cast("long"))).otherwise(none))
    return F.concat(none, *parts)


def _windows(rows: DataFrame, key: str, bits: int = 0) -> DataFrame:
    """key, row, form, at, hash and words of each window at the spots of rows of _texts, and of (how many words the text has),
    but those whose part the map of 2^bits words hasn't got; without a map (0) also part. A window that opens with a word that begins
    a sentence comes twice, with that word and with a name.

    part is a number from three words' hashes, which costs a fraction of the window's hash; the first word isn't among them,
    so it holds for both forms of a window. Its highest bits are the place of a word of the map, its lowest six, which are
    the last word's, that of a bit. Spots become rows before they are looked up, as functions of arrays aren't compiled."""
    rows = rows.select(key, "row", F.size("t0").alias("first"), F.size("t1").alias("second"), F.concat("t0", "t1").alias("t"), F.concat("h0", "h1").alias("h"), *["flags"] * (bits > 0), "spots")
    # Of an inner explode the optimizer infers a filter on the spots, for which it would find the tokens twice.
    rows = rows.select("*", F.explode_outer("spots").alias("spot")).drop("spots").where("spot is not null")
    at, n = F.shiftright("spot", 4).cast("int"), F.col("spot").bitwiseAND(15).cast("int")
    word = lambda i: F.get("h", at + i)
    part = word(n - 1).bitwiseXOR(F.shiftleft(word(F.shiftright(n, 1)), 21)).bitwiseXOR(F.shiftleft(word(F.lit(1)), 42))
    if bits:
        rows = rows.where(F.getbit(F.get("flags", F.shiftrightunsigned(part, 64 - bits).cast("int")), word(n - 1).bitwiseAND(63).cast("int")) == 1)
    rows = rows.select(key, "row", at.alias("spot"), "first", "second", F.slice("t", at + 1, n).alias("t"), *[part.alias("part")] * (not bits))
    opens = F.startswith(F.get("t", F.lit(0)), F.lit(INITIAL))
    rows = rows.select("*", F.explode(F.when(opens, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("named"))
    words = F.transform("t", lambda t, i: F.when(F.col("named") & (i == 0), F.concat(F.lit(OPEN_NAME), _bare(t), F.lit(CLOSE))).otherwise(_bare(t)))
    literal = F.col("spot") < F.col("first")
    rows = rows.select(key, "row", F.when(literal, LITERAL).otherwise(TEMPLATE).alias("form"), F.when(literal, F.col("spot")).otherwise(F.col("spot") - F.col("first")).alias("at"), words.alias("words"), F.when(literal, F.col("first")).otherwise(F.col("second")).alias("of"), *["part"] * (not bits))
    return rows.withColumn("hash", F.xxhash64(F.transform("words", lambda t: F.xxhash64(_mark(t)))))


def _item_windows(items: DataFrame) -> DataFrame:
    """Each window of WINDOW tokens (all, if fewer) of items."""
    rows = _texts(items, "item_id")
    return _windows(rows.withColumn("spots", _spots([(form, F.least(F.size(f"t{form}"), F.lit(WINDOW))) for form in (LITERAL, TEMPLATE)])), "item_id")


def _doc_windows(docs: DataFrame, lengths: set[tuple[int, int]], flags: list[int], whole: bool = False) -> DataFrame:
    """The same for documents, windows of the given forms and lengths, or (whole, without the
    map) those that are the whole text. The map is a column read by a scalar subquery: as a literal, its digits would stand in every text of the plan that the driver
    keeps."""
    table = docs.sparkSession.createDataFrame([(flags,)], "flags array<bigint>")
    rows = _texts(docs, "doc_id").withColumns({"spots": _spots([(form, F.lit(n)) for form, n in sorted(lengths)], whole), **({} if whole else {"flags": table.scalar()})})
    return _windows(rows, "doc_id", 0 if whole else len(flags).bit_length() - 1)


def _flags(item: DataFrame) -> list[int]:
    """Words of 64 bits; those of the parts of all windows are set. The bits are 64 times the windows or more, up
    to MOST_FLAGS."""
    n = min(max(LEAST_FLAGS, 1 << (64 * item.count()).bit_length()), MOST_FLAGS) // 64
    out = [0] * n
    keys = item.select(F.col("item_part").alias("k")).where("k is not null")
    at = F.shiftrightunsigned("k", 65 - n.bit_length()).cast("int").alias("i")
    for r in keys.groupBy(at).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("k").bitwiseAND(63).cast("int"))).alias("word")).collect():  # at most MOST_FLAGS / 64 numbers
        out[r["i"]] = r["word"]
    return out


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows (of the item, matched), n_slots, same_values: an item's passage lies in the document.

    Windows that match at one distance between document and item are one occurrence. It counts if its slots map one value
    to one value; else those of its windows count whose values are all equal. n_slots and same_values are those of the
    occurrence with the most windows, n_windows is of all. Windows in which fewer than LITERALS of WINDOW words are plain
    must have equal values, unless a short item meets a document as short, or the windows of the occurrence have LITERALS
    different plain words together, or are all of the item's and have three. Items of fewer than FEW words lie only where
    they are a whole sentence (from a sentence's or line's begin to its end) of equal values. Null ids and null or empty
    texts match nothing; rows that share an id are one document; other columns are ignored."""
    item = _item_windows(items)
    # Counted from the end, as a name at the beginning may be one word or two.
    slots, template = F.filter("words", _slot).alias("item_slots"), F.transform("words", _mark).alias("template")
    item = stored(item.select("item_id", F.col("row").alias("item_row"), "form", (F.col("at") - F.col("of")).alias("item_at"), "hash", slots, template, F.greatest(F.col("of") - WINDOW + 1, F.lit(1)).alias("item_windows"), F.col("part").alias("item_part")), "leak-items")
    item_bytes = item.agg(F.sum(64 + F.length(F.to_json(F.struct("item_slots", "template"))))).first()[0] or 0
    lengths = {(r["form"], r["n"]) for r in item.select("form", F.size("template").alias("n")).distinct().collect()}  # at most WINDOW a form
    flags = _flags(item)
    doc = _doc_windows(docs, {(form, n) for form, n in lengths if n >= FEW} | {(TEMPLATE, WINDOW)}, flags)
    if few := {(form, n) for form, n in lengths if n < FEW}:
        sentences = docs.select("doc_id", F.explode(F.split(F.col("text").cast("string"), SENTENCE_END)).alias("text"))
        doc = doc.unionByName(_doc_windows(sentences, few, flags, whole=True).drop("part"))
    hit = doc.join(small_side(item, item_bytes, 2), ["hash", "form"]).where(F.transform("words", _mark) == F.col("template"))
    pairs = F.zip_with("item_slots", F.filter("words", _slot), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    plain = F.filter("template", lambda t: ~_slot(t)).alias("plain")
    hit = hit.select("doc_id", "row", "item_id", "item_row", "item_windows", "form", (F.col("at") - F.col("item_at")).alias("shift"), "item_at", pairs.alias("pairs"), plain, F.size("words").alias("n"), "of")
    hit = hit.withColumn("equal", F.forall("pairs", lambda p: p["a"] == p["b"]))
    much = (F.size("plain") * WINDOW >= F.col("n") * LITERALS) | ((F.col("n") < WINDOW) & (F.col("n") == F.col("of")))
    hit = hit.withColumn("sure", F.col("equal") | ((F.col("n") >= FEW) & much))
    hit = hit.where(F.col("sure") | ((F.col("n") >= FEW) & (F.size(F.array_distinct("plain")) >= 2)))
    place = hit.groupBy("doc_id", "row", "item_id", "item_row", "form", "shift").agg(F.max("item_windows").alias("of"), F.collect_set(F.struct("item_at", "pairs", "equal", "sure", "plain")).alias("all"))
    paired = lambda windows: F.array_distinct(F.flatten(F.transform(windows, lambda w: w["pairs"])))
    one = lambda windows: F.size(F.array_distinct(F.transform(paired(windows), lambda p: p["a"]))) == F.size(paired(windows))
    words = F.size(F.array_distinct(F.flatten(F.transform("all", lambda w: w["plain"]))))
    covered = F.size(F.array_distinct(F.transform("all", lambda w: w["item_at"]))) >= F.col("of")
    place = place.withColumn("certain", F.filter("all", lambda w: w["sure"]))
    kept = F.when(one("all") & ((words >= LITERALS) | (covered & (words >= 3))), F.col("all")).when(one("certain"), F.col("certain")).otherwise(F.filter("all", lambda w: w["equal"]))
    place = place.withColumn("kept", kept).where(F.size("kept") > 0)
    place = place.select("doc_id", "item_id", "form", F.array_distinct(F.transform("kept", lambda w: w["item_at"])).alias("at"), F.forall("kept", lambda w: w["equal"]).alias("equal"), F.size(paired("kept")).alias("slots"))
    matched = lambda form: F.size(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("form") == form, F.col("at"))))))
    found = place.groupBy("doc_id", "item_id").agg(F.max(F.struct("form", F.size("at").alias("n"), "equal", "slots")).alias("best"), matched(TEMPLATE).alias("template"), matched(LITERAL).alias("literal"))
    n = F.when(F.col("best.form") == TEMPLATE, F.col("template")).otherwise(F.col("literal"))
    return found.select("doc_id", "item_id", n.cast("long").alias("n_windows"), F.col("best.slots").cast("long").alias("n_slots"), F.col("best.equal").alias("same_values"))


def drop_leaked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs, all columns whatever their names, that hold no item's passage. Rows are judged by their texts
    (told apart by a 64-bit hash), so a null or repeated id neither saves nor condemns one; null and empty texts stay; an
    empty table stays empty."""
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    found = stored(leaks(docs.select(key.alias("doc_id"), "text"), items).select(F.col("doc_id").alias(unused("leaked", docs))).distinct(), "leaked")
    return docs.join(small_side(found, found.count(), 24), key == F.col(found.columns[0]), "left_anti").select(docs.columns)


def op6_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of an item; see leaks for nulls, repeated ids and empty texts."""
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

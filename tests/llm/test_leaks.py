"""Leaks of benchmark items against a plain version, number-heavy and very short items."""

import random
from collections import defaultdict

import pytest
import regex
from pyspark.sql import functions as F

from threadloom.llm import decontamination as d


def _leaks(spark, items, docs):
    frame = lambda rows, key: spark.createDataFrame(list(enumerate(rows)), f"{key} long, text string")
    return {(r["doc_id"], r["item_id"]): r["same_values"] for r in d.leaks(frame(docs, "doc_id"), frame(items, "item_id")).collect()}


def _tokens(text):
    text = regex.sub(d.UNIT, f" {d.OPEN_UNIT}{d.CLOSE} ", text)
    text = regex.sub(d.NAME, lambda m: d.OPEN_NAME + m[0] + d.CLOSE, text)
    text = regex.sub(d.INITIAL_NAME, lambda m: d.INITIAL + m[0], text)
    text = regex.sub(d.NUMBER, lambda m: d.OPEN_NUMBER + m[0] + d.CLOSE, text)
    return regex.findall(d.TOKEN, text.lower())


def _cuts(text, sizes):
    """(form, at from the end, mark or word of each token, slot values, tokens of the text) of all windows."""
    literal, raw = regex.findall(d.NUMBER + r"|\p{L}+", text.lower()), _tokens(text)
    template = [t.lstrip(d.INITIAL) for t in raw]
    for form, words in ((0, literal), (1, template)):
        for n in sizes or [min(len(words), d.WINDOW)]:
            for i in range(len(words) - n + 1 if n else 0):
                forms = [words[i : i + n]]
                if form and raw[i].startswith(d.INITIAL):
                    forms.append([d.OPEN_NAME + words[i] + d.CLOSE, *words[i + 1 : i + n]])
                for w in forms:
                    slot = [d.OPEN_NUMBER <= t[0] <= d.OPEN_NAME for t in w]
                    yield form, i, tuple(t[0] if s else t for t, s in zip(w, slot)), tuple(t for t, s in zip(w, slot) if s), len(words)


def _one(windows):
    pairs = {p for w in windows for p in w[1]}
    return len({a for a, _ in pairs}) == len(pairs)


def _plain(items, docs):
    """(document, item) pairs by comparing all windows."""
    by = defaultdict(list)
    for k, text in enumerate(items):
        for form, at, words, slots, of in _cuts(text, None):
            by[form, words].append((k, at - of, slots, max(of - d.WINDOW + 1, 1)))
    sizes = sorted({len(words) for _, words in by})
    out = set()
    for doc, text in enumerate(docs):
        places, windows = defaultdict(set), {}
        cuts = [(0, c) for c in _cuts(text, [n for n in sizes if n >= d.FEW])]
        for s in regex.split(d.SENTENCE_END, text):
            cuts += [(s, c) for c in _cuts(s, [n for n in sizes if n < d.FEW]) if c[4] == len(c[2])]
        for row, (form, at, words, slots, of) in cuts:
            plain = [w for w in words if not d.OPEN_NUMBER <= w[0] <= d.OPEN_NAME]
            for k, item_at, item_slots, n_item in by.get((form, words), []):
                equal, n = slots == item_slots, len(words)
                sure = equal or n >= d.FEW and (len(plain) * d.WINDOW >= n * d.LITERALS or n < d.WINDOW and n == of)
                if sure or n >= d.FEW and len(set(plain)) >= 2:
                    places[k, row, form, at - item_at].add((item_at, tuple(zip(item_slots, slots)), equal, sure, tuple(plain)))
                    windows[k, row, form, at - item_at] = n_item
        for key, found in places.items():
            words = len({p for w in found for p in w[4]})
            strong = words >= d.LITERALS or words >= 3 and len({w[0] for w in found}) >= windows[key]
            if strong and _one(found) or any(w[2] for w in found) or any(w[3] for w in found) and _one([w for w in found if w[3]]):
                out.add((doc, key[0]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_as_comparing_all_windows(spark, seed):
    r = random.Random(seed)
    verbs, things = ["buys", "sells", "counts", "paints"], ["red pears", "old boxes", "kg of corn", "stamps"]

    def question():
        n = r.choice([1, 2, 3, 5])
        parts = [f"{r.choice(['Anna', 'Peter', 'she', 'the man'])} {r.choice(verbs)} {r.randrange(2, 6)} {r.choice(things)}" for _ in range(n)]
        return r.choice(["", "Then ", "In May "]) + " and ".join(parts) + r.choice(["?", ". How many are left", " + 4 - 3 times 2"])

    items = [question() for _ in range(25)] + ["Yes", "7 boxes", "Solve 3 + 4 - 5", "two red pears"]
    docs = [" ".join(r.choice([question(), r.choice(items), "Yes.", "we saw 7 boxes there.", "nothing of note"]) for _ in range(r.randrange(1, 5))) for _ in range(60)]
    got, want = set(_leaks(spark, items, docs)), _plain(items, docs)
    assert got == want and len(want) > 20


def test_number_heavy_items(spark):
    item = "Compute 12 + 7 times 30 minus 4 over 18 and then add 5 to 9 plus 6"
    other = "Compute 13 + 8 times 31 minus 2 over 19 and then add 3 to 7 plus 1"
    mixed = "Compute 7 + 7 times 30 minus 4 over 18 and then add 5 to 9 plus 6"  # two values of the item in one place of equal value elsewhere
    rest = " while nobody in this quiet town was looking"
    got = _leaks(spark, [item], ["so " + item + rest, "so " + other + rest, "1 2 3 4 5 6 7 8 9 10 11 12 13", "so " + mixed + rest])
    assert got[0, 0] and got[1, 0] is False and (2, 0) not in got


def test_items_of_a_word_or_two_are_whole_sentences(spark):
    items = ["Yes", "New York", "7 apples"]
    docs = ["yes this is a clean text about trees", "He said so. Yes. And left.", "a trip to New York with 7 apples and 9 pears", "Where to?\nNew York\nfine", "9 apples.", "7 apples"]
    assert set(_leaks(spark, items, docs)) == {(1, 0), (3, 1), (5, 2)}
    frame = spark.createDataFrame([(None, docs[0]), (1, docs[1]), (1, None), (2, "")], "doc_id long, text string")
    kept = d.drop_leaked(frame, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert sorted((r["text"] or "") for r in kept) == ["", "", docs[0]]


def test_extra_columns_repeated_ids_and_very_long_texts(spark):
    item = "every winter morning seven grey geese cross our frozen river again"
    long = "word other " * 300_000 + item + " more"
    docs = spark.createDataFrame([(1, item, 1), (1, "clean", 2), (None, item, 3), (2, long, 4)], "doc_id long, text string, hash long")
    docs = docs.withColumns({c: F.lit(1) for c in ("item_id", "flags", "form", "row", "at")})
    items = spark.createDataFrame([(0, item, "x"), (0, item, "y"), (None, item, "z")], "item_id long, text string, doc_id string")
    assert sorted((r["doc_id"], r["item_id"], r["same_values"]) for r in d.leaks(docs, items).collect()) == [(1, 0, True), (2, 0, True)]
    assert d.leaks(docs, items.limit(0)).count() == 0


def test_thousands_of_names_or_parts_of_a_number_in_a_row(spark):
    """A pattern that calls itself for each of them overflows the stack, which ends the executor."""
    names, number = "and" + " Word" * 50_000, "1" + ".1" * 50_000
    for pattern, text in ((d.NAME, names), (d.NUMBER, number), (d.NUMBER + r"|\p{L}+", number)):
        matcher = spark._jvm.java.util.regex.Pattern.compile(pattern).matcher(text)
        assert matcher.find() and matcher.end() == len(text)
    item = "every winter morning seven grey geese cross our frozen river again"
    docs = [f"so {item} {names}", f"so {item}, {number}", names, number, f"{names} {number} {item}"]
    assert _leaks(spark, [item], docs) == {(0, 0): True, (1, 0): True, (4, 0): True} and set(_plain([item], docs)) == {(0, 0), (1, 0), (4, 0)}


def test_the_map_is_in_bits_and_tokens_are_found_once(spark):
    """The map lets a window through that is an item's, and no filter below finds the tokens a second time."""
    items = spark.createDataFrame([(0, "every winter morning seven grey geese cross our frozen river again")], "item_id long, text string")
    item = d._item_windows(items)
    flags = d._flags(item.withColumnRenamed("part", "item_part"))
    assert 0 < sum(bin(w & (2**64 - 1)).count("1") for w in flags) <= item.count() and len(flags) * 64 >= d.LEAST_FLAGS
    docs = spark.createDataFrame([(1, "so every winter morning seven grey geese cross our frozen river again"), (2, "nothing like " * 20)], "doc_id long, text string")
    found = d._doc_windows(docs, {(0, 10), (1, 10)}, flags)
    assert {r["hash"] for r in found.where("doc_id = 1").collect()} >= {r["hash"] for r in item.where("at = 1").collect()}
    assert not [line for line in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Filter" in line and "regexp_extract_all" in line]

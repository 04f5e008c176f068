"""Large groups, several tasks of edges, and texts whose plain sums of letters are equal."""

import random
import re

import pytest

from threadloom.llm import components, jaccard, repeats
from threadloom.llm.hidden_markov import score_texts


def _sets(texts, size):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        out.append({tuple(w[j : j + size]) for j in range(max(len(w) - size + 1, 1))} if w else set())
    return out


def _labels(sets, percent):
    label = list(range(len(sets)))
    for a, x in enumerate(sets):
        for b in range(a):
            if x and 100 * len(x & sets[b]) >= percent * len(x | sets[b]):
                p, q = sorted((label[a], label[b]))
                label = [p if k == q else k for k in label]
    return label


@pytest.mark.parametrize("members, edges, owners", [(1024, 1 << 20, 8 << 20), (6, 3, 50)])
def test_near_copies_of_all_degrees(spark, monkeypatch, members, edges, owners):
    """Copies with few to many changes, so that some of a list's sets link with its leader, some with each other only."""
    monkeypatch.setattr(jaccard, "MEMBERS", members)
    monkeypatch.setattr(jaccard, "OWNERS", owners)
    monkeypatch.setattr(components, "LOCAL_EDGES", edges)
    r = random.Random(11)
    texts = ["", None]
    for length in (3, 8, 60, 150, 300):
        base = [r.choice("abcdefghij") + str(r.randrange(60)) for _ in range(length)]
        for k in range(20):
            copy = list(base)
            for _ in range(k // 3):
                copy[r.randrange(len(copy))] = f"x{r.randrange(9)}"
            texts.append(" ".join(copy[: len(copy) - k % 3]))
    got = jaccard.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    sets = _sets(texts, 4)
    want = _labels(sets, 85)
    assert len(set(want)) < len(texts) - 30
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(s), want[i]) for i, s in enumerate(sets)}


def test_words_of_equal_sums_differ(spark):
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(3, word), (2, other), (1, f"{word} {rest}"), (4, f"{other} {rest}")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs, 1, 100).collect()} == {i: i for i in (1, 2, 3, 4)}
    assert {r["doc_id"]: r["n_removed"] for r in repeats.remove_repeats(docs).collect()} == {3: 0, 2: 0, 1: 40, 4: 40}
    # Document 3 is held out; without text 1 its word isn't known, as the other word's hash isn't its own.
    known = lambda d: {r["doc_id"]: r["n_known"] for r in score_texts(d).collect()}[3]
    assert known(docs) == 2 and known(docs.where("doc_id <> 1")) == 1


def test_components_of_a_path_and_a_star(spark, monkeypatch):
    monkeypatch.setattr(components, "LOCAL_EDGES", 20)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 540)] + [(7, 7), (9, 8), (8, 9), (None, 3)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 500 for i in range(500, 540)}, 8: 8, 9: 8}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_copies_in_many_slices_are_one_set(spark):
    from threadloom.llm import jaccard as jc

    r = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    text = " ".join(r.choices(words, k=100))
    near = text.split()
    near[50] = "other"
    rows = [(i, text) for i in range(40)] + [(100, " ".join(near)), (101, " ".join(r.choices(words, k=100)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(10)
    prints, nodes, edges = jc.links(df, 4, 85)
    row = df.selectExpr("doc_id", "xxhash64(text) as key", "text")
    lists = jc.postings(row, nodes, 4, 85).collect()
    assert nodes.count() == 3 and len({(x["h"], x["node"]) for x in lists}) == len(lists) > 0
    assert min(x["pos"] for x in lists) >= 0
    got = {x["doc_id"]: x["component_id"] for x in jc.jaccard_components(df, 4, 85).collect()}
    assert got == {i: 0 for i in [*range(40), 100]} | {101: 101}


def test_sets_are_taken_in_small_slices():
    """What a task holds at once is bounded by 1 MB of text (a text at least), and the sets don't depend on it."""
    import pyarrow as pa

    from threadloom.llm import jaccard

    texts = [" ".join(f"w{(i * 7 + k) % 50_000}" for i in range(90_000)) for k in range(4)]
    batch = pa.record_batch([pa.array(range(4)), pa.array(range(4)), pa.array(texts)], ["doc_id", "key", "text"])
    parts = list(jaccard._prints(5)(iter([batch])))
    alone = [b for i in range(4) for b in jaccard._prints(5)(iter([batch.slice(i, 1)]))]
    assert len(parts) > 1 and pa.Table.from_batches(parts).equals(pa.Table.from_batches(alone).combine_chunks())

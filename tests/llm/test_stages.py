"""Every stage of the pipeline on nulls, empty and long texts, ties, repeated rows, clashing names and empty tables."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, skey string, size long, rank int, row string, key string, key_hi long, component int, copies int, target string, quality_score double, leaked int, cell int, n int, doc int"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(3)
    words = [f"word{i}" for i in range(400)]
    prose = lambda n: " ".join(r.choices(words, k=n)) + "."
    item = next(x["text"] for x in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() if x["text"] and len(x["text"].split()) > 12)
    base = prose(90)
    texts = [(1, base), (2, base), (2, base), (3, base + " more"), (None, base), (None, prose(60)), (None, prose(60)), (4, prose(80)), (4, prose(80)), (5, None), (6, ""), (7, " \n\t"), (8, prose(40_000)), (9, f"{prose(20)} {item} {prose(20)}"), (None, f"{prose(20)} {item} {prose(20)}"), (10, "one"), (11, "One")]
    extra = ("sk", 5, 6, "r", "k", 7, 8, 9, "t", 0.5, 1, 2, 3, 4)
    out = [(i, t, "en", [None, "a", "b"][n % 3], 1, *extra) for n, (i, t) in enumerate(texts)]
    return [*out, out[7], out[5]]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage(spark, rows, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.createDataFrame(rows, SCHEMA)
    none = stage(spark, docs.limit(0), DATA)
    assert none.count() == 0 and none.columns[: len(docs.columns)] == docs.columns
    out = stage(spark, docs, DATA)
    assert out.columns == docs.columns + ["shard", "slot"] * (name == "shards")
    got, given = Counter(tuple(x)[: len(docs.columns)] for x in out.collect()), Counter(rows)
    if name == "quality":
        assert all(given[x] == n for x, n in got.items())
    elif name == "near_duplicates":
        gone = [rows[i] for i in (1, 2, 3, 4, 16)]  # copies of the first text, near ones, the later of "one" and "One"
        want = Counter({x: 1 for x in given if x not in gone})
        assert got == want
    elif name == "benchmark":
        assert got == given - Counter([rows[13], rows[14]])
    elif name == "mix":
        assert set(got) <= set(given) and all(n <= 3 * given[x] for x, n in got.items())
        assert all(got[rows[i]] == 1 for i in (9, 10, 11))  # without words
    else:
        assert got == given
        slots = out.groupBy("shard").agg(F.collect_list("slot").alias("s")).collect()
        assert all(sorted(x["s"]) == list(range(len(x["s"]))) for x in slots)

"""Base spans against plain searches, many matches in one text, and what the trees add."""

import random
import re
import time

from threadloom.llm import pii

DATA = "/root/testdata/sf0.001"


def _luhn(digits):
    total = 0
    for i, d in enumerate(reversed([int(x) for x in digits])):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _base(t):
    digits = lambda x: re.sub("[^0-9]", "", x)
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and _luhn(digits(m[0]))]
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return sorted(found)


def _same(rows, texts):
    for r in rows:
        assert [tuple(s) for s in r["base"]] == _base(texts[r["doc_id"]] or "")


def test_base_spans_of_all_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    texts |= {-1: None, -2: "", -3: "a@b@c.d.e @x.y a@b..c a@b.c@d.e +1 +1(2)3456789 +49 30.123 45 67 - 1.2.3.4.5 300.1.1.1 0001.02.3.4 4111-1111-1111-1111 4111 1111 1111 1112", -4: "é🙂 x.y@z.org 🙂 10.0.0.1"}
    rows = pii.find_pii(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    _same(rows, texts)


def test_many_matches_in_one_text(spark):
    text = " ".join(f"10.0.{i % 256}.{i % 199}" for i in range(100_000))
    began = time.time()
    row = pii.candidates(spark.createDataFrame([(1, text)], "doc_id long, text string")).selectExpr("size(filter(found, x -> x.rank = 1 and x.valid)) as n").first()
    assert row["n"] == 100_000 and time.time() - began < 60


def test_the_trees_decide_on_loose_candidates(spark):
    """Spelled-out addresses are announced by a cue most times, so those without one are added too; sentences of the same
    pattern without brackets never are, so they stay out."""
    r = random.Random(1)
    name = lambda: "".join(r.choices("abcdefgh", k=6))
    texts = [f"mail {name()}@{name()}.org" for _ in range(100)] + [f"{name()} met at {name()} . then left" for _ in range(400)]
    texts += [f"please mail {name()} (at) {name()} (dot) com" for _ in range(400)] + [f"signed {name()} [at] {name()} [dot] net" for _ in range(5)] + [f"see {name()} (at) {name()} (dot) com" for _ in range(5)]
    rows = {x["doc_id"]: x for x in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(not rows[i]["added"] for i in range(500))
    assert all(len(rows[i]["added"]) == 1 for i in range(500, len(texts)))


def test_all_candidates_take_part_in_training(spark, monkeypatch):
    """The stored training rows stand for every candidate, however many there are."""
    kept = {}
    monkeypatch.setattr(pii, "stored", lambda df, name: kept.setdefault(name, df.cache()))
    texts = [f"see 10.0.{i % 250}.{i % 7} or 10.1.{i % 250}.{i % 300} and 555 123 {i % 9000:04d}" for i in range(25_000)]
    found = pii.candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).cache()
    pii.train(found)
    total = found.selectExpr("sum(size(found)) as n").first()["n"]
    assert total > 50_000 and kept["pii-train"].selectExpr("sum(n) as n").first()["n"] == total


def test_thresholds_come_from_all_candidates_and_splits_from_all_rows(spark, monkeypatch):
    """What sets the thresholds adds up to every loose candidate, and no row number lets Spark sample for splits."""
    assert all(n <= pii.bins(n) ** 2 for n in (0, 1, 1 << 20, (1 << 20) + 1, 10**9)) and pii.bins(5) == pii.BINS
    fitted, scored = [], []
    fit = pii._fit

    def spy(rows):
        fitted.append(rows.selectExpr("sum(n) as n").first()["n"])
        return fit(rows)

    monkeypatch.setattr(pii, "_fit", spy)
    monkeypatch.setattr(pii, "sorted", lambda rows, **how: scored.extend(rows) or sorted(rows, **how), raising=False)
    texts = [f"{'phone' if i % 3 else 'x'} 555 123 {i % 9000:04d} or 10.0.{i % 250}.{i % 300}" for i in range(2000)]
    found = pii.candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).cache()
    pii.train(found)
    total, loose = found.selectExpr("sum(size(found)) as n", "sum(size(filter(found, x -> not x.strict))) as m").first()
    assert fitted[0] == total and sum(total - n for n in fitted[1:]) == total
    assert loose == 2000 and sum(r["n"] for r in scored) == loose

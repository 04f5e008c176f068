import random
import re
from collections import Counter

import pyarrow as pa

from threadloom.llm import cascade as cs
from threadloom.llm.wordgrid import words

SPACE = "[^\\x20\\x09-\\x0D]+"


def plain(text):
    """BASE, base_failed and kept of a text, rule by rule."""
    text = text or ""
    w = re.findall(SPACE, text)
    n, chars = len(w), sum(map(len, w))
    lines = [x for x in text.split("\n") if re.search(SPACE, x)]
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for k in range(3)}
    symbols, dup = sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines))
    failed = n < 50 or 100 * len(covered) > 50 * n
    caps = sum(len(re.findall("[A-Z]", x)) >= 2 and not re.search("[a-z]", x) for x in w)
    letters = sum(bool(re.search("[A-Za-z]|[^\\x00-\\x7f]", x)) for x in w)
    bad = [chars < 2 * n or chars > 12 * n, 10 * symbols > n, 10 * letters < 8 * n, 10 * caps > 3 * n, 10 * sum(x[-1] in "!?" for x in w) > 3 * n, 2 * dup > len(lines), 10 * sum(a == b for a, b in zip(w, w[1:])) > n, w and 10 * max(Counter(w).values()) > 3 * n]
    return n, chars, symbols, dup, len(covered), failed, not failed and not any(bad)


def texts():
    r = random.Random(1)
    pool = ["word", "Über", "été", "the", "A", "AB", "!!", "x%", "12", "ok?", "日本", "and|or", "longerthantwelveletters"]
    out = ["", " \n\t\n", "one", "a b c a b c", "a b\na b\n\na b \n", "é" * 60, "\n".join(["line of words here"] * 20), "word " * 70, "W" * 200_000, " ".join(str(i) for i in range(40_000))]
    for _ in range(300):
        some = r.sample(pool, r.randint(1, 9)) + ["plain"] * r.randint(0, 9) + [f"w{i}" for i in range(r.randint(0, 60))]
        out.append("".join(r.choice(some) + r.choice([" ", " ", "  ", "\n", "\t", "\r\n"]) for _ in range(r.randint(1, 160))))
    return out + out[10:40]


def test_same_as_plain_rules(spark):
    rows = [(i if i % 5 else None, t, "n", True) for i, t in enumerate(texts())] + [(1, None, "n", True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string, kept boolean").repartition(3)
    for sample in (1, 40, 10_000):
        got = cs.judge_documents(df, sample=sample)
        assert got.columns == [*df.columns, "n_words_", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept_"]
        assert sorted(tuple(r)[4:] for r in got.collect()) == sorted(plain(t) for _, t, *_ in rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert cs.judge_documents(df).count() == 0 and cs.rule_report(df).count() == 0


def test_order_is_rejection_per_cost_among_what_is_left():
    e = cs.Estimate(["slow", "fast", "same", "idle", "free"])
    e.seconds = cs.np.array([1.0, 0.1, 0.2, 0.9, 0.5])
    e.verdicts = cs.np.array([[1, 1, 1, 0, 0], [1, 1, 1, 0, 0], [1, 0, 0, 0, 0], [0, 0, 0, 0, 0]], bool)
    assert e.order() == ["fast", "slow", "same", "free", "idle"]


def test_rejected_texts_are_not_shown_to_later_rules():
    t = cs.Texts(words(pa.array(["a b", "c", "d e f", "", "g"], pa.large_string())))
    seen = []

    def rule(reject):
        def run(t):
            seen.append([t.w.data[a:b].tobytes().decode() for a, b in zip(t.w.begin, t.w.begin[1:])])
            return cs.np.array([x in reject for x in seen[-1]])

        return run

    done = {}
    rules = {"x": rule({"a b", "", "c"}), "y": rule({"g"}), "z": rule({"d e f"})}
    assert cs.cascade(t, ["x", "y", "z"], rules, done).tolist() == [False] * 5
    assert seen == [["a b", "c", "d e f", "", "g"], ["d e f", "g"], ["d e f"]]
    assert {k: v[:2] for k, v in done.items()} == {"x": [5, 3], "y": [2, 1], "z": [1, 1]}


def test_report_adds_up(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id long, text string").repartition(2)
    report = {r["rule"]: r for r in cs.rule_report(df, sample=1).collect()}
    judged = sum(not plain(t)[5] for t in texts())
    assert set(report) == set(cs.RULES) and max(r["judged"] for r in report.values()) == judged
    assert min(r["judged"] for r in report.values()) < judged

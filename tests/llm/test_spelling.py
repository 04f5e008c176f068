import random
import re
import zlib
from collections import Counter

import pytest

from threadloom.llm import spelling as sp

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def count(docs):
    n = Counter()
    for i, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{i}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if i is not None and h % 97 == 0 else w] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(n):
    near = {w: [v for v in n if v != w and one_edit(v, w)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w, ""), root(w), n[w], len(near[w]), n[form[w]] if w in form else 0) for w in n)


def result(spark, docs, most=sp.MOST):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, word string, n int").repartition(3)
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in sp.variant_groups(df, most).collect())


def some_docs(letters, seed, n=260):
    r = random.Random(seed)
    words = ["".join(r.choice(letters) for _ in range(r.randint(4, 8))) for _ in range(90)]

    def typo(w):
        k = r.randrange(len(w))
        return r.choice([w, w, w[:k] + w[k + 1 :], w[:k] + r.choice(letters) + w[k:], w[:k] + r.choice(letters) + w[k + 1 :]])

    return [(i, " ".join(typo(words[min(int(r.expovariate(0.06)), 89)]) for _ in range(40))) for i in range(n)]


@pytest.mark.parametrize("most", [sp.MOST, 8, 1])
def test_same_as_all_pairs(spark, most):
    docs = some_docs("abàÿ", 1) + [(None, "Wörter WÖRTER wörter, ×÷×÷× x1 Ā中 abcde"), (3, None), (4, ""), (4, ""), (5, "-- 12")]
    assert result(spark, docs, most) == brute(count(docs))


def test_chain_of_forms(spark):
    docs = [(None, " ".join(["a" * (5 + k)] * (3 << k))) for k in range(9)]
    got = result(spark, docs)
    assert got == brute(count(docs)) and {r[2] for r in got} == {"a" * 13}


def test_all_words_share_most_letters(spark):
    words = ["aaaaa" + x + y + "bbbbb" for x in "abcdefghij" for y in "abcdefghij"]
    docs = [(None, " ".join(words * 3)), (None, "aaaaaaabbbbb")]
    assert result(spark, docs, 16) == brute(count(docs))


def test_very_long_words(spark):
    docs = [(None, " ".join(["x" * 3000] * 3 + ["x" * 3001] * 7 + ["x" * 1500 + "y" + "x" * 1499] * 3))]
    assert result(spark, docs) == brute(count(docs))


def test_empty(spark):
    assert result(spark, []) == [] and result(spark, [(1, "rare words only")]) == []


def test_acceptor_is_minimal_and_finds_each_pair_once():
    r = random.Random(5)
    for _ in range(60):
        words = sorted({"".join(r.choice("ab") for _ in range(r.randint(0, 5))) for _ in range(20)})
        machine = sp.Acceptor(words)
        kinds = [(machine.ends[s], tuple(sorted(machine.next[s].items()))) for s in {t for m in machine.next for t in m.values()}]
        used, todo = {0}, [0]
        while todo:
            for t in machine.next[todo.pop()].values():
                if t not in used:
                    used.add(t)
                    todo.append(t)
        kinds = [(machine.ends[s], tuple(sorted(machine.next[s].items()))) for s in used]
        assert len(set(kinds)) == len(kinds)
        pairs = [tuple(sorted(p[1:])) for p in machine.one_edit()]
        assert sorted(pairs) == sorted((a, b) for i, a in enumerate(words) for b in words[i + 1 :] if one_edit(a, b))

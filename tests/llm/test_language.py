"""Counts against plain ones, and Baum-Welch against sums over all paths."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from threadloom.llm import hidden_markov as hm

DATA = "/root/testdata/sf0.001"


def test_base_scores_of_all_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()} | {-5: None, -6: "", -7: "Word word WORD unheard-of"}
    tokens = {i: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    c = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    rows = hm.score_texts(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(t), sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), abs=1e-6)
        assert r["score"] < 0


def test_expected_counts_are_those_over_all_paths():
    model = hm.Hmm(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), np.array([[0.5, 0.1], [0.3, 0.2], [0.2, 0.7]]))
    seen = [[0, 2, 1, 2, 0], [1]]
    starts, moves, emits = np.zeros(2), np.zeros((2, 2)), np.zeros((3, 2))
    for s in seen:
        paths = list(itertools.product((0, 1), repeat=len(s)))
        p = [model.start[q[0]] * np.prod([model.emit[c, x] for c, x in zip(s, q)]) * np.prod([model.move[a, b] for a, b in zip(q, q[1:])]) for q in paths]
        for q, w in zip(paths, np.array(p) / sum(p)):
            starts[q[0]] += w
            for a, b in zip(q, q[1:]):
                moves[a, b] += w
            for c, x in zip(s, q):
                emits[c, x] += w
    got = model.expected(np.array(sum(seen, []), dtype=np.int16), np.array([0, 5, 6]))
    assert np.allclose(got[0], starts) and np.allclose(got[1], moves) and np.allclose(got[2], emits)


def test_pieces_lose_no_token_and_no_move(monkeypatch):
    model = hm.Hmm(np.array([0.9, 0.1]), np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([[0.6, 0.1], [0.4, 0.9]]))
    classes, first = np.random.default_rng(1).integers(0, 2, 3000).astype(np.int16), np.array([0, 1200, 1203, 3000])
    got = model.expected(classes, first)
    monkeypatch.setattr(hm, "PIECE", 4000)
    whole = model.expected(classes, first)
    assert got[0].sum() == pytest.approx(3) and got[1].sum() == pytest.approx(2997) and got[2].sum() == pytest.approx(3000)
    assert all(np.abs(a - b).max() < 0.5 for a, b in zip(got, whole))

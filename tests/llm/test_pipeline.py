import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest

from threadloom.llm import decontamination, telephony
from threadloom.llm.shared import documents, stored

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def kept(spark):
    """Rows that each stage keeps, by name, each on its predecessor's."""
    docs, out = documents(spark, DATA), {}
    out["documents"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, DATA), f"test-{name}")
        out[name] = docs.collect()
        if name == "near_duplicates":
            items = spark.read.parquet(f"{DATA}/benchmark.parquet")
            out["leaked"] = {r["doc_id"] for r in decontamination.leaks(docs, items).collect()}
    return out


def _ids(rows):
    return {r["doc_id"] for r in rows}


def test_one_of_each_component_stays(kept):
    rows, size, percent = kept["quality"], corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_PERCENT
    assert rows and _ids(rows) <= _ids(kept["documents"])
    sets = {}
    for r in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(r["text"] or "")]
        sets[r["doc_id"]] = {tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    assert _ids(kept["near_duplicates"]) == set(label.values())


def test_leaked_documents_go_and_the_others_stay(kept):
    assert _ids(kept["benchmark"]) == _ids(kept["near_duplicates"]) - kept["leaked"]


def test_copies_and_shards(kept):
    copies = Counter(r["doc_id"] for r in kept["mix"])
    assert copies and max(copies.values()) <= 3 and set(copies) <= _ids(kept["benchmark"])
    assert Counter(r["doc_id"] for r in kept["shards"]) == copies
    slots = {}
    for r in kept["shards"]:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(0 <= s < 16 and sorted(v) == list(range(len(v))) for s, v in slots.items())


def test_adpcm_blocks_as_one_sample_at_a_time():
    blocks = np.random.default_rng(3).integers(0, 256, (40, 64), dtype=np.uint8)
    got, steps = telephony.decode_adpcm(blocks), telephony.ima_steps()
    for block, samples in zip(blocks.tolist(), got.tolist()):
        value = int.from_bytes(bytes(block[:2]), "little", signed=True)
        index, want = min(block[2], 88), [value]
        for byte in block[4:]:
            for nibble in (byte & 15, byte >> 4):
                step = int(steps[index])
                size = step // 8 + sum(step // d for bit, d in ((4, 1), (2, 2), (1, 4)) if nibble & bit)
                value = max(-32768, min(32767, value - size if nibble & 8 else value + size))
                index = max(0, min(88, index + (-1 if nibble & 7 < 4 else 2 * (nibble & 7) - 6)))
                want.append(value)
        assert samples == want


@pytest.mark.parametrize("rates", [(8000, 16000), (8000, 44100), (44100, 8000)])
def test_resampling_keeps_a_constant(rates):
    out = telephony.resample(np.full(400, 1000, dtype=np.int16), *rates)
    assert len(out) == -(-400 * rates[1] // rates[0]) and np.abs(out[len(out) // 4 : -len(out) // 4].astype(int) - 1000).max() <= 2

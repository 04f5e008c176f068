"""Operators against SQL and plain versions on the test tables."""

import glob
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from threadloom.llm import mixing, quality, sharding, telephony
from threadloom.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got = QUERIES[name](spark, DATA)
    want = c.sql(ORACLE_SQL[name])
    at = [want.columns.index(x) for x in got.columns]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())


def test_shards_are_balanced(spark):
    rows = sharding.op10_histogram_shards(spark, DATA).collect()
    shards, largest = Counter(), max(r["size"] for r in rows)
    for r in rows:
        shards[r["shard"]] += r["size"]
    mean = sum(shards.values()) / 16
    assert set(shards) == set(range(16)) and all(abs(x - mean) <= sharding.TOLERANCE * mean + largest for x in shards.values())
    even = spark.createDataFrame([(i, f"text {i:06d}") for i in range(8000)], "doc_id long, text string")
    sizes = Counter()
    for r in sharding.shard_documents(even).collect():
        sizes[r["shard"]] += r["size"]
    mean = sum(sizes.values()) / 16
    assert all(abs(x - mean) <= 0.01 * mean for x in sizes.values())


def test_targets_of_sources(spark):
    size, names = defaultdict(int), set()
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        size[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    names = sorted(size, key=lambda s: (s is None, s))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, free, rest = {}, list(names), sum(size.values())
    while True:
        above = [s for s in free if rest * weight[s] / sum(weight[x] for x in free) > 3 * size[s]]
        if not above:
            break
        for s in above:
            target[s] = 3 * size[s]
        free, rest = [s for s in free if s not in above], rest - sum(3 * size[s] for s in above)
    target |= {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
    got = mixing.mix_documents(spark.read.parquet(f"{DATA}/documents.parquet")).select("source", "source_size", "target").distinct().collect()
    assert {r["source"]: (r["source_size"], round(r["target"], 6)) for r in got} == {s: (size[s], round(target[s], 6)) for s in names}


def test_quality_is_a_shrunk_discriminant(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet").collect() for t in ("documents", "labels"))
    label = {r["doc_id"]: r["quality"] for r in labels if zlib.crc32(str(r["doc_id"]).encode()) % 5}
    f = {r["doc_id"]: quality.features(pa.array([r["text"]], pa.string()))[0] for r in docs}
    x = [np.array([f[i] for i in f if label.get(i) == k]) for k in (0, 1)]
    scatter = [(a - a.mean(axis=0)).T @ (a - a.mean(axis=0)) for a in x]
    pooled = sum(scatter) / sum(map(len, x))
    floor = np.diag(np.maximum(np.diag(pooled), 1e-6))
    cov = [(1 - quality.DIAGONAL) * ((1 - quality.POOLED) * s / len(a) + quality.POOLED * pooled) + quality.DIAGONAL * floor for s, a in zip(scatter, x)]
    for r in quality.op8_quality_qda(spark, DATA).collect():
        d = [-0.5 * ((f[r["doc_id"]] - a.mean(axis=0)) @ np.linalg.solve(c, f[r["doc_id"]] - a.mean(axis=0)) + np.linalg.slogdet(c)[1]) for a, c in zip(x, cov)]
        assert r["score"] == pytest.approx(1 / (1 + np.exp(np.clip(d[0] - d[1] - np.log(len(x[1]) / len(x[0])), -500, 500))), abs=1e-6)


def test_pcm_of_stored_files(spark):
    data = bytes(range(256)) * 2
    files = [(1, telephony.wave(data)), (2, telephony.wave(data, telephony.A_LAW)), (3, telephony.wave(data, telephony.IMA_ADPCM, bits=4, block=64)), (4, telephony.wave(b"", telephony.MU_LAW))]
    got = {r["doc_id"]: r for r in telephony.pcm_column(spark.createDataFrame(files, "doc_id long, media binary")).collect()}
    for i, media in files:
        rate, pcm = telephony.decode(media)
        assert got[i]["pcm"] == telephony.resample(pcm, rate, telephony.OUT_RATE).astype("<i2").tobytes()
    assert len(got[1]["pcm"]) == 2 * 2 * len(data) and len(got[4]["pcm"]) == 0
    raw = np.frombuffer(data, np.uint8)
    assert (telephony.decode(files[1][1])[1] == telephony.expansion(telephony.A_LAW)[raw]).all()

"""Files of several sizes, in hidden folders, in blocks and as streams."""

import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from threadloom.operators import backup, extract
from threadloom.plans import fixtures
from threadloom.sources import files as fs
from threadloom.streaming import ingest

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def logs(tmp_path):
    """A home with a long log, one of bad lines only, settings without messages, and a file of no interest."""
    home = tmp_path / "home"
    os.makedirs(home / ".cursor" / "deep")
    lines = [json.dumps({"role": "user" if i % 2 else "assistant", "content": f"line {i} " + "é" * (i % 90)}, ensure_ascii=False) if i % 40 else "{bad" for i in range(5000)]
    (home / ".cursor" / "long.jsonl").write_bytes("\n".join(x + ("\r" if i % 3 == 0 else "") + ("\n" if i % 7 == 0 else "") for i, x in enumerate(lines)).encode())
    (home / ".cursor" / "deep" / "bad.jsonl").write_text("{\n{\n")
    (home / ".cursor" / "settings.jsonl").write_text('{"type":"nobody"}\n\n{"type":"none"}\n')
    (home / ".cursor" / "empty.jsonl").write_text("")
    (home / ".cursor" / "x.bin").write_text('{"role":"user","content":"no"}')
    return str(home)


def _plain(rows):
    return sorted((r["meta"]["file_path"].split("/")[-1], r["type"], r["messages"], r["meta"]["warnings"], r["meta"]["prompt"], r["meta"]["tokens"], r["meta"]["created_at"], r["meta"]["recognition_confidence"]) for r in rows)


def test_lines_in_blocks_as_whole_files(spark, logs):
    roots = fs.tool_folders(logs)
    whole = fs.read_raw_files(spark, roots)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        lines = fs.read_lines(spark, roots)
        assert lines.select("path", "block").distinct().where(F.col("path").endswith("long.jsonl")).count() > 5
        got = extract.extract_lines(lines).collect()
        want = extract.extract_jsonl(whole).collect()
        assert sorted((r["path"], r["messages"], r["bad"]) for r in got) == sorted((r["path"], r["messages"], r["bad"]) for r in want)
        rows = extract.line_message_rows(lines).where(F.col("path").endswith("long.jsonl")).orderBy("block", "at", "pos").collect()
        assert [r["content"] for r in rows] == [m["content"] for r in want if r["path"].endswith("long.jsonl") for m in r["messages"]]
        assert _plain(extract.normalize_lines(lines).collect()) == _plain(extract.normalize_raw(whole.where("size > 0")).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_stream_of_files_and_replays(spark, logs, tmp_path):
    out, state = f"{tmp_path}/out", f"{tmp_path}/state"
    run = lambda: sorted((r["thread_id"], r["messages"]) for r in ingest.stream_files(spark, f"{logs}/.cursor", out, state, files=1).collect())
    first = run()
    assert first == sorted((r["thread_id"], r["messages"]) for r in extract.normalize_raw(fs.read_raw_files(spark, f"{logs}/.cursor")).collect())
    with open(f"{logs}/.cursor/new.md", "w") as f:
        f.write("## User\nhi\n## Assistant\nyo\n")
    with open(f"{logs}/.cursor/long.jsonl", "a") as f:
        f.write("\n")
    second = run()
    assert len(second) == len(first) + 1 and all(x in second for x in first)
    last = max(int(n) for n in os.listdir(f"{state}/commits") if n.isdigit())
    os.remove(f"{state}/commits/{last}")
    crc = f"{state}/commits/.{last}.crc"
    if os.path.exists(crc):
        os.remove(crc)
    assert run() == second  # the last batch ran again
    shutil.rmtree(f"{out}/ids/batch={last}")
    os.remove(f"{state}/commits/{last}")
    if os.path.exists(crc):
        os.remove(crc)
    assert run() == second  # as if it had failed between threads and ids


def test_batch_without_files(spark, tmp_path):
    files = spark.createDataFrame([], ingest.ROWS)
    ingest.append_unseen(files, 0, f"{tmp_path}/t")
    assert ingest.read_target(spark, f"{tmp_path}/t").count() == 0 and ingest.read_target(spark, f"{tmp_path}/none").count() == 0


def test_backup_twice(spark, tmp_path):
    t = fixtures.threads(spark, DATA).drop("ord")
    for run in ("a", "a", "b"):
        backup.write_backup(t.where(F.col("meta.source") == ("codex" if run == "a" else "cursor")), f"{tmp_path}/b", "json", run)
    got = fs.read_threads(spark, f"{tmp_path}/b", lines=True)
    assert sorted(r[0] for r in got.select("thread_id").collect()) == sorted(r[0] for r in t.where(F.col("meta.source").isin("codex", "cursor")).select("thread_id").collect())


def test_dedupe_with_null_keys(spark):
    rows = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a"), (5, "")], "ord long, thread_id string")
    assert sorted(r["ord"] for r in backup.dedupe_threads(rows).collect()) == [1, 3, 5]


def test_search_reads_candidate_files_only(spark, tmp_path):
    from threadloom.operators import search, stats

    t = fixtures.threads(spark, DATA).drop("ord").withColumn("type", F.when(F.col("meta.source") == "codex", "Zürich-Only").otherwise(F.col("type")))
    backup.write_backup(t, f"{tmp_path}/b")
    search.write_index(spark, f"{tmp_path}/b", f"{tmp_path}/i")
    files = search.candidate_files(spark, f"{tmp_path}/i", "züRICH-only")
    assert files and all("/source=codex/" in f for f in files)
    for text in ("züRICH-only", "the", "e", "", "no such text anywhere", "\U0001f600"):
        got = search.search_backup(spark, f"{tmp_path}/b", f"{tmp_path}/i", text)
        assert sorted(r["thread_id"] for r in got.collect()) == sorted(r["thread_id"] for r in stats.search_threads(t, text).collect())


def test_imports(spark, tmp_path):
    from threadloom.operators import imports

    none = spark.createDataFrame([], "hash string")
    for name, text in {"a.json": '[{"messages":[{"role":"user","content":"x"}]}, {"schema_version":"1.0.0","thread_id":"t","messages":[],"meta":{"project":"p"}}]', "b.json": '{"conversation":[{"role":"user","content":"x"}]}', "c.jsonl": '{"role":"user","content":"x"}\n\n{oops\n{"role":"user","content":"y"}\n{"role":"user","content":"x"}\n', "d.json": "{oops", "e.jsonl": ""}.items():
        (tmp_path / name).write_text(text)
        got = {apart: imports.import_records(spark, f"{tmp_path}/{name}", none, 0, f"/u/{name}", apart).collect() for apart in (False, True)}
        want = {"a.json": 2, "b.json": 1, "c.jsonl": 2, "d.json": 0, "e.jsonl": 0}[name]
        assert len(got[False]) == len(got[True]) == want, name
        assert len({r["thread_id"] for r in got[True]}) == want and len({r["thread_id"] for r in got[False]}) == (1 if name == "c.jsonl" else want)
        assert all(r["file"] == f"imported-{r['hash']}.json" for r in got[True])
        assert [r["meta"]["source"] for r in got[True] if r["thread_id"] == "t"] == ["imported"] * (name == "a.json")
        again = spark.createDataFrame([(r["hash"],) for r in got[True]], "hash string")
        assert imports.import_records(spark, f"{tmp_path}/{name}", again, 0, f"/u/{name}", True).count() == 0

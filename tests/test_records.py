"""Cleaning with counters, schema faults, reports and pages."""

import json
import random
import re
import time

from pyspark.sql import functions as F

from threadloom.functions import classify, json_schema
from threadloom.operators import clean, stats, validate
from threadloom.plans import fixtures

DATA = "/root/testdata/sf0.001"


def test_chain_leaves_what_the_pipeline_leaves(spark):
    rows = fixtures.riddled(spark, DATA)
    bare = rows.limit(1).withColumns({"ord": F.lit(-1).cast("long"), "messages": F.transform("messages", lambda m: m.withField("content", F.lit(None).cast("string"))), "meta": F.col("meta").withField("prompt", F.lit(None).cast("string"))})
    none = bare.withColumns({"ord": F.lit(-2).cast("long"), "messages": F.expr("slice(messages, 1, 0)")})
    rows = rows.unionByName(bare).unionByName(none)
    got = clean.clean_chain(rows)
    assert got.columns == [*rows.columns, "cleaned"]
    key = lambda r: (r["ord"], r["messages"], r["meta"])
    assert sorted(map(key, got.collect()), key=lambda x: x[0]) == sorted(map(key, clean.clean_pipeline(rows).collect()), key=lambda x: x[0])
    zero = got.where("ord < 0").collect()
    assert len(zero) == 2 and all(sum(r["cleaned"]) == 0 and len(r["cleaned"]) == len(clean.kinds()) for r in zero)


def test_part_of_the_chain(spark):
    steps = (clean.mask_pii, "prune")
    rows = clean.clean_chain(fixtures.riddled(spark, DATA), steps)
    got = {(r["cleanup"], r["type"]) for r in clean.chain_stats(rows, steps).collect()}
    assert got == {("pii", k) for k in clean.PII} | {("prune", "Truncated_Messages")}
    assert [r["matches"] for r in clean.chain_stats(rows.limit(0), steps).collect()] == [0] * 5


def test_schema_words(spark):
    schema = {"type": ["object", "null"], "required": ["a"], "properties": {"a": {"type": "number", "minimum": 2}, "b": {"type": "array", "items": {"type": "string", "minLength": 2, "enum": ["xx", "y"]}}, "c": {"pattern": "^z"}}}
    cases = {
        '{"a":2}': [], "null": [], "[]": ["(root) must be object,null"], '"s"': ["(root) must be object,null"], "{}": ["(root) must have required property 'a'"], '{"a":1.5}': ["/a must be >= 2"], '{"a":"9"}': ["/a must be number"], '{"a":true}': ["/a must be number"],
        '{"a":3,"b":["xx",null,"y",{}]}': ["/b/1 must be string", "/b/1 must be equal to one of the allowed values", "/b/2 must not have fewer than 2 characters", "/b/3 must be string", "/b/3 must be equal to one of the allowed values"],
        '{"a":3,"b":{}}': ["/b must be array"], '{"a":3,"c":"a"}': ['/c must match pattern "^z"'], '{"a":3,"c":5}': [], "oops": ["(root) must be JSON"],
    }
    rows = spark.createDataFrame([*((k,) for k in cases), (None,)], "json string")
    got = {r["json"]: r["errors"] for r in validate.validate_json(rows, schema=schema).collect()}
    assert got == cases | {None: ["(root) must be JSON"]}
    assert json_schema.faults(F.lit(1), {}) is not None


def test_canonical_json(spark):
    rows = spark.createDataFrame([(1, [(2, None, "x")])], "b int, a array<struct<z:int,y:string,c:string>>")
    assert json.loads(rows.select(classify.canonical_json(F.struct("b", "a"), rows.schema)).first()[0]) == {"a": [{"c": "x", "z": 2}], "b": 1}
    assert rows.select(classify.canonical_json(F.struct("b", "a"), rows.schema)).first()[0] == '{"a":[{"c":"x","z":2}],"b":1}'


def test_report_and_pages(spark):
    t = fixtures.threads(spark, DATA)
    report = stats.thread_report(t, ["source", "type"]).collect()
    assert sorted(r["threads"] for r in report if not r["is_total"]) == sorted(r["threads"] for r in stats.thread_stats(t, ["source", "type"]).collect())
    assert [r["threads"] for r in report if r["is_total"]] == [t.count()]
    assert stats.thread_report(t.limit(0)).count() == 0
    pages, after = [], None
    while True:
        page = stats.list_after(t, after, 7).select("meta.source", "thread_id").collect()
        if not page:
            break
        pages += [tuple(r) for r in page]
        after = pages[-1]
    assert pages == [tuple(r) for r in t.select("meta.source", "thread_id").orderBy("meta.source", "thread_id").collect()]


def test_addresses_are_found_without_reading_a_run_twice(spark):
    texts = ["a@b.co.x@y.org", "a@b.co1@e.fr", "@e.fr a@@b.co x@y z@y.c q.w+e@r-t.uio,", "u@v.org" * 3, "é@a.bc 1%a@b.c.de.f9", "a@b.co@c.de@f.gh"]
    want = [re.sub(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "***PII_MASKED***", t) for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    assert [r["t"] for r in rows.select("i", clean.mask_pii.text(F.col("t")).alias("t")).orderBy("i").collect()] == want
    began = time.time()
    long = spark.createDataFrame([("a" * 400_000 + " @ " + "b" * 400_000 + "@c.de",)], "t string")
    assert long.select(clean.mask_pii.text(F.col("t")).endswith("***PII_MASKED***").alias("t")).first()["t"] and time.time() - began < 20


def test_masks_and_counts_are_those_of_plain_patterns(spark):
    """Types but one are searched only in texts with a literal that they need; what masks a match counts it, once, whatever
    stands around it."""
    maskers = (clean.mask_secrets, clean.mask_pii, clean.mask_assets)
    assert {k for m in maskers for k, _ in m.steps} - set(clean.HINTS) == {"Bank_Card"}
    plain = {
        "AWS_AccessKey": r"(?<![A-Z0-9])(?:AKIA|ABIA|ACCA|ASIA)[A-Z0-9]{16}(?![A-Z0-9])", "ID_Card": r"(?<![0-9])[1-9][0-9]{5}(?:18|19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])[0-9]{3}[0-9X](?![0-9])",
        "Phone": r"(?<![0-9])1[3-9][0-9]{9}(?![0-9])", "Bank_Card": r"(?<![0-9])[1-9][0-9]{12,18}(?![0-9])", "Email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
        "DB_URI": clean.ASSETS["DB_URI"].replace("(?=[mpr])", ""), "Internal_IP": r"(?<![0-9])(?:10\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}|192\.168\.[0-9]{1,3}\.[0-9]{1,3}|172\.(?:1[6-9]|2[0-9]|3[01])\.[0-9]{1,3}\.[0-9]{1,3})(?![0-9])",
    }
    r = random.Random(3)
    bits = ["AKIA", "ASIA0123456789ABCDEF", "0123456789ABCDEF", "110101199003071234", "11010120000307123X", "13912345678", "6222000000000001", "7", "X", "@", "@", "a.b", "c.org", "é", " ", "\n", ".", "10.0.3.7", "192.168.1.1", "172.16.0.9", "172.40.0.1",
            "mysql://", "redis://u:p@h:1/d", "postgresql://a:b@c.d/e", "sk-", "k" * 36, "ghp_", "gho_", "sk-ant-api03-", "bce-v3/", "ALTAK-", "-----BEGIN CERTIFICATE-----", "-----END CERTIFICATE-----", "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----", "***MASKED***", "***PII_MASKED***", "***PII_MASKED", "PII_MASKED***", "🙂"]
    texts = ["".join(r.choices(bits, k=r.randrange(12))) for _ in range(1500)] + ["***PII_MASKED13912345678PII_MASKED***"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    for m in maskers:
        got = rows.select("i", m.text(F.col("t")).alias("t"), m.counts(F.col("t")).alias("n")).orderBy("i").collect()
        for row, text in zip(got, texts):
            counts = []
            for kind, pattern in m.steps:
                text, n = re.subn(plain.get(kind, pattern), m.mask, text)
                counts.append(n)
            assert (row["t"], row["n"]) == (text, counts)

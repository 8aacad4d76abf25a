import glob
import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from custodia.functions import plugins
from custodia.operators import guardrails
from custodia.session import new_path, scratch
from custodia.sources import documents, logs, vector_store
from custodia.streaming import flows, recent


def test_json_array_of_documents(spark, tmp_path):
    docs = [
        {"id": "d1", "title": "T", "content": "c", "domain": "hr", "author": "x", "date": "2024-07-15", "classification": "internal"},
        {"id": "d2", "title": "T", "content": "c"},
    ]
    (tmp_path / "docs.json").write_text(json.dumps(docs))
    out = {r["id"]: r for r in documents.scan_documents(spark, str(tmp_path / "docs.json")).collect()}
    assert str(out["d1"]["date"]) == "2024-07-15" and out["d2"]["domain"] is None


def test_broken_or_missing_documents_abort(spark, tmp_path):
    (tmp_path / "bad.json").write_text('[{"id": "d1", ')
    with pytest.raises(Exception):
        documents.scan_documents(spark, str(tmp_path / "bad.json")).collect()
    with pytest.raises(Exception):
        documents.scan_documents(spark, str(tmp_path / "none.json")).collect()


def test_violation_log_keeps_empty_maps_and_the_newest(spark, tmp_path):
    log = [
        {"violation_type": "toxic_content", "severity": "HIGH", "description": f"d{i}", "additional_data": {},
         "user": "u", "recorded_at": f"2025-11-18T20:{i:02d}:44.995794"}
        for i in range(30)
    ]
    (tmp_path / "v.json").write_text(json.dumps(log))
    out = logs.scan_violations(spark, str(tmp_path / "v.json"), retention=5).collect()
    assert {r["description"] for r in out} == {f"d{i}" for i in range(25, 30)}
    assert out[0]["additional_data"] == {}


def test_audit_lines_round_trip(spark, rows, tmp_path):
    df = rows(
        "ts timestamp, user string, role string, domain string, ok boolean, query string, n int, s double",
        (pd.Timestamp("2024-01-01 10:00:00").to_pydatetime(), "jo | x", "guest", "hr", False, "why | User: not\nthis", 3, 1.005),
    )
    lines = [
        logs.access_line(F.col("user"), F.col("role"), F.col("domain"), F.col("ok")),
        logs.pii_line(F.lit("d1"), F.array(F.lit("SSN"), F.lit("Salary"))),
        logs.query_line(F.col("user"), F.col("query"), F.col("n"), F.col("s")),
        F.lit("something else"),
    ]
    text = df.select(F.explode(F.array(*[logs.log_file_line("ts", x) for x in lines])).alias("line"))
    logs.write_text_log(text, str(tmp_path / "log"))
    out = {r["kind"]: r for r in logs.read_audit_log(spark, str(tmp_path / "log")).collect()}
    assert (out["access"]["status"], out["access"]["role"], out["access"]["domain"]) == ("DENIED", "guest", "hr")
    assert (out["pii"]["doc_id"], out["pii"]["pii_types"]) == ("d1", "SSN, Salary")
    assert (out["query"]["documents"], out["query"]["duration_seconds"]) == (3, float(f"{1.005:.2f}"))
    assert out["other"]["other"].endswith("something else")


def test_append_log_never_rewrites(spark, rows, tmp_path):
    path = str(tmp_path / "log")
    ts = pd.Timestamp("2024-01-01 10:00:00").to_pydatetime()
    for i in range(3):
        logs.append_log(rows("recorded_at timestamp, i int", (ts, i)), path)
    assert spark.read.parquet(path).count() == 3


def test_gates(rows):
    verdicts = rows("k long, toxic int", (1, 1), (1, 0), (2, 0))
    texts = rows("id long, role string, response string", (1, "guest", "x"), (2, "guest", "a@b.co"), (3, "admin", "a@b.co"))
    out = {r["id"]: r for r in guardrails.output_gate(texts, verdicts, "id", "k").collect()}
    assert out[1]["violation_type"] == "toxic_content" and out[1]["severity"] == "HIGH"
    assert out[2]["violation_type"] == "pii_detected" and out[2]["description"] == "PII detected: EMAIL_ADDRESS"
    # admins are not checked, a missing verdict passes
    assert out[3]["is_safe"] and out[3]["violation_type"] is None


def test_plug_ins(rows):
    df = rows("id long, role string, response string", (1, "guest", "Ann Doe"), (2, "guest", "fine"))
    sizes = []

    def embed(texts):
        sizes.append(len(texts))
        return [[float(len(t)), 1.0] for t in texts]

    vec = plugins.with_embeddings(df, "response", plugins.embedder(embed))
    assert {r["id"]: r["embedding"] for r in vec.collect()} == {1: [7.0, 1.0], 2: [4.0, 1.0]}

    moderate = plugins.moderator(lambda texts: [t.startswith("Ann") for t in texts])
    table = plugins.verdict_table(df, "id", "response", moderate)
    assert {r["verdict_id"]: r["toxic"] for r in table.collect()} == {1: 1, 2: 0}

    def broken(texts):
        raise RuntimeError("no model")

    passed = plugins.verdict_table(df, "id", "response", plugins.moderator(broken))
    assert {r["toxic"] for r in passed.collect()} == {0}

    names = plugins.entity_recognizer(lambda texts: [[("PERSON", t)] if "Doe" in t else [] for t in texts])
    gated = guardrails.pii_output_gate(df, recognizer=names)
    assert {r["id"]: r["entities"] for r in gated.collect()} == {1: ["PERSON"], 2: []}


def test_domain_tools(rows):
    tools = plugins.DomainTools("hr")
    df = rows("id long, department_role string, content string", (1, "hr_specialist", "a@b.co 123-45-6789"), (2, "general", "a@b.co"))
    allowed = {r["id"]: (r["general_role"], r["allowed"]) for r in df.transform(tools.check_access).collect()}
    assert allowed == {1: ("analyst", True), 2: ("guest", False)}
    masked = {r["id"]: r["content"] for r in df.transform(tools.mask_pii_for_role).collect()}
    assert masked == {1: "a@b.co [MASKED-SSN]", 2: "[MASKED-EMAIL]"}


SECOND = 1_000_000


def _stream_in_files(spark, df, path, parts):
    """Each part becomes a file of its own, older parts with older modification times."""
    import os
    import time

    os.makedirs(path)
    start = time.time() - 10_000
    for i, part in enumerate(parts):
        part_dir = f"{path}-part{i}"
        part.coalesce(1).write.parquet(part_dir)
        (name,) = [f for f in os.listdir(part_dir) if f.endswith(".parquet")]
        target = f"{path}/{i}.parquet"
        with open(f"{part_dir}/{name}", "rb") as src, open(target, "wb") as dst:
            dst.write(src.read())
        os.utime(target, (start + i * 10, start + i * 10))
    return logs.stream_log(spark, path, df.schema, maxFilesPerTrigger=1)


def test_live_rate_limit_over_many_batches(spark, rows, tmp_path):
    import random

    rng = random.Random(1)
    data = sorted((rng.randrange(3 * 3600) * SECOND, rng.choice("abc")) for _ in range(200))
    df = rows("request_id long, username string, micros long", *[(i, u, t) for i, (t, u) in enumerate(data)])
    parts = [df.filter((F.col("request_id") / 50).cast("int") == p) for p in range(4)]
    stream = _stream_in_files(spark, df, str(tmp_path / "in"), parts)
    out = str(tmp_path / "out")
    recent.stream_rate_limit(stream, out, str(tmp_path / "work"), 2, 15).awaitTermination()
    got = {r["request_id"]: (r["n_global"], r["n_user"]) for r in spark.read.parquet(out).collect()}
    want = {r["request_id"]: (r["n_global"], r["n_user"]) for r in guardrails.rate_limits(df, 2, 15).collect()}
    assert spark.read.parquet(out).select("batch").distinct().count() == 4
    assert got == want


def test_dashboard_counts_over_many_batches(spark, rows, tmp_path):
    df = rows("i int, micros long, kind string", *[(i, i * 600 * SECOND, "ab"[i % 2]) for i in range(40)])
    parts = [df.filter((F.col("i") / 10).cast("int") == p) for p in range(4)]
    stream = _stream_in_files(spark, df, str(tmp_path / "in"), parts).withColumn("ts", F.timestamp_micros("micros"))
    out = str(tmp_path / "out")
    counts = flows.dashboard_counts(stream, ["kind"])
    flows.upsert_files(counts, out, str(tmp_path / "work")).awaitTermination()
    newest = flows.newest_rows(spark, out, ["window_start", "window_end", "kind"])
    got = {(r["window_start"], r["kind"]): r["n"] for r in newest.collect()}
    hours = df.withColumn("h", F.date_trunc("hour", F.timestamp_micros("micros"))).groupBy("h", "kind").count()
    assert got == {(r["h"], r["kind"]): r["count"] for r in hours.collect()}


def test_an_upsert_rewrites_the_touched_partitions_only(spark, tmp_path):
    path = str(tmp_path / "store")
    old = spark.range(200).selectExpr("id", "concat('ns', id % 3) as namespace", "1 as version")
    vector_store.write_store(vector_store.with_key(old), path, buckets=4)
    before = set(glob.glob(f"{path}/*/*/*.parquet"))
    changes = spark.createDataFrame([(0, "ns0", 2), (0, "ns0", 3), (900, "ns0", 2)], "id long, namespace string, version int")
    vector_store.merge_into(vector_store.with_key(changes), path, buckets=4)
    after = set(glob.glob(f"{path}/*/*/*.parquet"))
    touched = {os.path.dirname(p) for p in after - before}
    assert 1 <= len(touched) <= 2
    assert {p for p in before if os.path.dirname(p) not in touched} <= after
    rows = spark.read.parquet(path).select("id", "version").collect()
    assert len(rows) == 201 and {tuple(r) for r in rows if r["version"] > 1} == {(0, 3), (900, 2)}


def test_live_state_stays_as_small_as_the_past_it_needs(spark, tmp_path):
    source, out, work = (str(tmp_path / n) for n in ("in", "out", "work"))
    schema = "request_id long, username string, micros long, ts timestamp, session_id string, role string, domain string, reason string, query string"
    for batch in range(4):
        rows = spark.createDataFrame([(batch, "u", batch * 10**6, None, "s", "guest", "hr", None, "q")], schema)
        rows.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        recent.stream_excessive_denials(stream, out, work, limit=2).awaitTermination()
    assert sorted(os.listdir(f"{work}/recent")) == ["2", "3"] and os.listdir(f"{work}/known") == []
    assert spark.read.parquet(out).filter("alert_type = 'excessive_denials'").count() == 3


def test_work_folders_are_removed(spark):
    with scratch(spark):
        path = new_path(spark, "short-lived")
        spark.range(3).write.parquet(path)
        assert os.path.isdir(path)
    assert not os.path.exists(path)

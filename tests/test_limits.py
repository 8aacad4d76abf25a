"""Live limits against the batch operators."""

import glob
import os
import random
import time

import pytest
from custodia.operators import alerts, guardrails
from custodia.sources import logs
from custodia.streaming import flows, limits
from pyspark.sql import functions as F

SECOND = 1_000_000
SCHEMA = ("request_id long, username string, micros long, ts timestamp, session_id string, role string, domain string, "
          "reason string, query string, latency double")  # fmt: skip


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Micro-batches of some rows each: most of their time is the number of tasks."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture
def arriving(spark, tmp_path):
    """A stream of the given lists of (id, user, micros), one file and so one micro-batch each."""

    def make(*batches, per_batch=1):
        folder = tmp_path / "in"
        os.makedirs(folder, exist_ok=True)
        start = time.time() - 100_000 + 10 * len(os.listdir(folder))
        for i, rows in enumerate(batches):
            made = table(spark, rows).coalesce(1)
            made.write.parquet(str(tmp_path / f"part-{start}-{i}"))
            (name,) = glob.glob(str(tmp_path / f"part-{start}-{i}" / "*.parquet"))
            os.rename(name, folder / f"{start}-{i}.parquet")
            os.utime(folder / f"{start}-{i}.parquet", (start + i * 10, start + i * 10))
        return logs.stream_log(spark, str(folder), table(spark, []).schema, maxFilesPerTrigger=per_batch)

    return make


def table(spark, rows):
    micros = [(i, u, t, "s", "guest", "hr", None, 'q "\n', 0.1) for i, u, t in rows]
    df = spark.createDataFrame(
        micros, "request_id long, username string, micros long, session_id string, role string, domain string, reason string, query string, latency double")
    return df.withColumn("ts", F.timestamp_micros("micros")).select(*[c.strip().split(" ")[0] for c in SCHEMA.split(",")])


def some_requests(seed, n, hours=3, users=("a", "b", "hot", "hot", "hot", None)):
    rng = random.Random(seed)
    times = sorted(rng.randrange(hours * 3600) * SECOND + rng.randrange(3) for _ in range(n))
    return [(i, rng.choice(users), t) for i, t in enumerate(times)]


def found(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


RATE = ("request_id", "username", "ts", "query", "latency", "n_global", "blocked_global", "n_user", "blocked_user")


@pytest.mark.parametrize("places", [1, 3])
def test_rate_limits_equal_the_batch_operator(spark, arriving, tmp_path, places):
    requests = some_requests(1, 400)
    stream = arriving(*[requests[i : i + 50] for i in range(0, 400, 50)])
    out, work = str(tmp_path / "out"), str(tmp_path / "work")
    limits.stream_rate_limit(stream, out, work, 2, 15, places=places).awaitTermination()
    got = spark.read.parquet(out)
    assert len(glob.glob(f"{work}/global/batch=*")) >= 8
    assert found(got, *RATE) == found(guardrails.rate_limits(table(spark, requests), 2, 15), *RATE)


def test_excessive_denials_over_fifty_batches(spark, arriving, tmp_path):
    denials = some_requests(2, 500, hours=5)
    stream = arriving(*[denials[i : i + 10] for i in range(0, 500, 10)])
    out, work = str(tmp_path / "out"), str(tmp_path / "work")
    limits.stream_excessive_denials(stream, out, work, limit=3, places=4).awaitTermination()
    names = ("alert_type", "timestamp", "user", "message", "denial_count")
    batch = table(spark, denials)
    want = alerts.union_alerts(alerts.denial_to_alert(batch), alerts.excessive_denials(batch, 3))
    assert found(spark.read.parquet(out), *names) == found(want, *names)
    # what a micro-batch writes follows its rows: late batches, with hours behind them, write no more
    size = {b: sum(map(os.path.getsize, glob.glob(f"{out}/batch={b}/*.parquet"))) for b in range(50)}
    deltas = {b: sum(map(os.path.getsize, glob.glob(f"{work}/checkpoint/state/0/*/{b + 1}.delta"))) for b in range(50)}
    for sizes in (size, deltas):
        early, late = sum(sizes[b] for b in range(5, 20)), sum(sizes[b] for b in range(35, 50))
        assert 0 < late < 2 * early


def test_odd_requests(spark, arriving, tmp_path):
    """Repeated rows, in one and in later batches, null users, no time, late rows, ids that tie."""
    batches = [
        [(1, None, 0), (1, None, 0), (2, "u", SECOND), (3, "u", None), (3, "u", None), (None, "u", 5)],
        [(1, None, 0), (2, "u", 2 * SECOND), (2, "u", 2 * SECOND), (None, None, None)],
        [(9, "u", 4000 * SECOND)],
        [(8, "u", 3990 * SECOND), (7, "u", 10 * SECOND)],  # late, and later than the lateness
    ]
    out = str(tmp_path / "out")
    limits.stream_excessive_denials(arriving(*batches), out, str(tmp_path / "work"), limit=1, lateness_seconds=60).awaitTermination()
    got = spark.read.parquet(out)
    every = got.filter("alert_type = 'access_denied'")
    assert every.count() == sum(map(len, batches))  # nothing is lost
    counts = sorted((r["user"] or "-", r["timestamp"].timestamp(), r["denial_count"]) for r in got.filter("denial_count > 0").collect())
    base = min(t for _, t, _ in counts)
    assert [(u, round(t - base, 6), n) for u, t, n in counts] == [
        ("-", 0, 1), ("-", 0, 2), ("-", 0, 3),
        ("u", 0.000005, 1), ("u", 1, 2), ("u", 2, 3), ("u", 2, 4), ("u", 10, 1), ("u", 3990, 1), ("u", 4000, 1),
    ]


def test_state_is_cleared_behind_the_watermark(spark, arriving, tmp_path):
    work = str(tmp_path / "work")
    busy = [(i, f"user{i}", i * SECOND) for i in range(40)]
    stream = arriving(busy, [(100, "later", 30_000 * SECOND)], [(101, "later", 30_001 * SECOND)])
    limits.stream_excessive_denials(stream, str(tmp_path / "out"), work, limit=3, places=2, lateness_seconds=60).awaitTermination()
    state = spark.read.format("statestore").load(f"{work}/checkpoint")
    keys = state.selectExpr("key.key").distinct().collect()
    assert len(keys) == 1 and "later" in keys[0]["key"] and state.count() <= 2


def test_a_restart_goes_on_and_a_batch_run_again_is_written_once(spark, arriving, tmp_path):
    requests = some_requests(4, 90, hours=1)
    out, work = str(tmp_path / "out"), str(tmp_path / "work")
    limits.stream_rate_limit(arriving(requests[:30]), out, work, 2, 15).awaitTermination()
    # as if the driver had been lost behind the write of the batch
    for name in ("checkpoint-global", "checkpoint-user"):
        for path in glob.glob(f"{work}/{name}/commits/0") + glob.glob(f"{work}/{name}/commits/.0.crc"):
            os.rename(path, str(tmp_path / (name + os.path.basename(path))))
    stream = arriving(requests[30:60], requests[60:])
    limits.stream_rate_limit(stream, out, work, 2, 15).awaitTermination()
    assert found(spark.read.parquet(out), *RATE) == found(guardrails.rate_limits(table(spark, requests), 2, 15), *RATE)


def test_string_ids(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = [("b", "u", 0), ("a", "u", 0), (None, "u", 0), ("é", "u", 1)]
    df = spark.createDataFrame(rows, "request_id string, username string, micros long")
    df.write.parquet(path)
    out = str(tmp_path / "out")
    limits.stream_rate_limit(spark.readStream.schema(df.schema).parquet(path), out, str(tmp_path / "work"), 9, 9).awaitTermination()
    got = {r["request_id"]: r["n_global"] for r in spark.read.parquet(out).collect()}
    assert got == {None: 1, "a": 2, "b": 3, "é": 4}


def test_open_sessions_come_from_the_state(spark, arriving, tmp_path):
    """Closed and open sessions together are those of all accesses, batch by batch, without reading the input."""
    requests = some_requests(6, 120, hours=20, users=("a", "b", "c"))
    out, work = str(tmp_path / "out"), str(tmp_path / "work")
    for upto in (60, 120):
        stream = arriving(requests[upto - 60 : upto - 30], requests[upto - 30 : upto])
        sessions = flows.cache_sessions(stream.select(F.col("username").alias("fingerprint"), "ts"), ttl_seconds=600)
        flows.append_files(sessions, out, work).awaitTermination()
        closed = spark.read.parquet(out)
        still = flows.open_sessions(spark, work)
        assert 0 < still.count() < closed.count()
        every = flows.with_open_sessions(closed, work)
        runs = {}
        for _, user, t in requests[:upto]:
            mine = runs.setdefault(user, [])
            if mine and t - mine[-1][1] <= 600 * SECOND:
                mine[-1][1:] = [t, mine[-1][2] + 1]
            else:
                mine.append([t, t, 1])
        want = sorted((u, n, n - 1) for u, mine in runs.items() for _, _, n in mine)
        assert sorted((r["fingerprint"], r["accesses"], r["hits"]) for r in every.collect()) == want


def test_no_place_meets_more_than_two_slices_of_a_long_log(spark):
    """All requests of one micro-batch share a key: the largest group does not grow with the log's length."""

    def largest(hours):
        rows = table(spark, [(i, "u", i * 20 * SECOND) for i in range(180 * hours)])
        rows = limits._rows(rows, [], "micros", "request_id", None, "long")
        asked = limits._asked(rows, 2, 60 * SECOND, 1800 * SECOND, 600)
        groups = asked.groupBy("key", "slice", "place").agg(F.count("*").alias("n"), F.sum(F.col("own").cast("int")).alias("own"))
        assert groups.agg(F.sum("own")).first()[0] == 180 * hours  # every row has one place of its own
        return groups.agg(F.max("n")).first()[0]

    assert largest(2) == largest(8) == 90 + 3


@pytest.mark.parametrize("slice_widths", [1, 2])
def test_short_slices_count_across_their_ends(spark, arriving, tmp_path, slice_widths):
    requests = some_requests(8, 300, hours=6)
    out = str(tmp_path / "out")
    stream = arriving(requests[:100], requests[100:])
    answers = limits.trailing_answers(stream, ["username"], 3600, 600, places=2, slice_widths=slice_widths)
    limits._per_batch(answers, lambda batch: limits.summed(batch, stream.schema), out, str(tmp_path / "work")).awaitTermination()
    want = []
    for i, u, t in requests:
        want.append((i, sum(v == u and t - 3600 * SECOND < s and (s, j) <= (t, i) for j, v, s in requests)))
    assert found(spark.read.parquet(out), "request_id", "n_recent") == sorted(want, key=repr)

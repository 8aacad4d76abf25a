import random

import pytest
from pyspark.sql import functions as F

from custodia.operators import alerts, analytics, guardrails, order_stats
from custodia.operators.trailing import trailing_counts

SECOND = 1_000_000


def brute(events, width, counted=None):
    """(key, micros, id) -> rows of the key less than width back, in arrival order."""
    out = {}
    ordered = sorted(events, key=lambda e: (e[1], e[2]))
    for at, (key, t, i) in enumerate(ordered):
        out[i] = sum(
            1
            for k2, t2, i2 in ordered[: at + 1]
            if k2 == key and t - t2 < width * SECOND and (counted is None or i2 in counted)
        )
    return out


def events_of(kind):
    rng = random.Random(7)
    if kind == "ties":  # many rows share an instant, ids jump over chunk borders
        return [(rng.choice("ab"), rng.randrange(5) * 30 * SECOND, i * 40_000) for i in range(300)]
    if kind == "hot":  # one key holds nearly all rows
        return [("h" if i % 20 else "c", rng.randrange(7200 * SECOND), i) for i in range(400)]
    return [(rng.choice("abc"), rng.randrange(600) * SECOND // 3, i) for i in range(300)]


@pytest.mark.parametrize("kind", ["ties", "hot", "mixed"])
@pytest.mark.parametrize("keyed", [True, False])
def test_trailing_counts(rows, kind, keyed):
    events = events_of(kind)
    df = rows("key string, t long, id long", *events)
    out = trailing_counts(df, ["key"] if keyed else [], "t", "id", 60)
    expected = brute(events if keyed else [("", t, i) for _, t, i in events], 60)
    assert {r["id"]: r["n_recent"] for r in out.collect()} == expected


def test_trailing_counts_of_some_rows(rows):
    events = events_of("ties")
    counted = {i for _, _, i in events if i % 3}
    df = rows("key string, t long, id long", *events)
    out = trailing_counts(df, ["key"], "t", "id", 60, counted=F.col("id") % 3 != 0)
    assert {r["id"]: r["n_recent"] for r in out.collect()} == brute(events, 60, counted)


def test_window_border(rows):
    df = rows("key string, t long, id long", ("a", 0, 1), ("a", 60 * SECOND - 1, 2), ("a", 60 * SECOND, 3))
    out = {r["id"]: r["n_recent"] for r in trailing_counts(df, ["key"], "t", "id", 60).collect()}
    # an age of exactly 60 seconds is out
    assert out == {1: 1, 2: 2, 3: 2}


def test_blocked_requests_count_globally_but_not_for_their_user(rows):
    df = rows(
        "request_id long, username string, micros long",
        *[(i, "u", i * SECOND) for i in range(4)], (9, "u", 100 * SECOND),
    )
    out = {r["request_id"]: r for r in guardrails.rate_limits(df, 2, 2).collect()}
    assert [out[i]["n_global"] for i in (0, 1, 2, 3, 9)] == [1, 2, 3, 4, 1]
    assert [out[i]["n_user"] for i in (0, 1, 2, 3, 9)] == [1, 2, None, None, 3]
    assert out[9]["blocked_user"] is True and out[1]["blocked_user"] is False


def test_excessive_denials_start_at_the_limit(rows):
    df = rows(
        "request_id long, username string, micros long, ts timestamp, session_id string",
        *[(i, "u", i * 100 * SECOND, None, "s") for i in range(12)],
    )
    out = alerts.excessive_denials(df, 10).collect()
    assert sorted(r["denial_count"] for r in out) == [10, 11, 12]
    assert {r["severity"] for r in out} == {"HIGH"}


def test_cache_hits_slide_with_each_touch(rows):
    ttl = 3600
    times = [0, ttl, 2 * ttl, 3 * ttl + 1, 3 * ttl + 1, 9 * ttl]
    df = rows("fingerprint string, micros long", *[("k", t * SECOND) for t in times], ("other", 5))
    out = {r[0]: tuple(r)[1:] for r in analytics.cache_hits(df).collect()}
    # a gap of exactly the ttl is a hit, one second more is a miss
    assert out == {"k": (6, 3, 3), "other": (1, 0, 1)}
    stats = analytics.cache_stats(analytics.cache_hits(df)).first()
    assert tuple(stats) == (3, 4, 42.86)


def test_cache_hits_brute_force(rows):
    rng = random.Random(3)
    events = [(rng.choice("ab"), rng.randrange(40_000)) for _ in range(300)]
    df = rows("fingerprint string, micros long", *[(k, t * SECOND) for k, t in events])
    out = {r[0]: r[2] for r in analytics.cache_hits(df, ttl_seconds=120).collect()}
    for key in "ab":
        times = sorted(t for k, t in events if k == key)
        assert out[key] == sum(b - a <= 120 for a, b in zip(times, times[1:]))


def wanted(values, p):
    return sorted(values)[int(len(values) * p)]


@pytest.mark.parametrize("small", [50_000, 0])
def test_order_statistics(spark, rows, monkeypatch, small):
    monkeypatch.setattr(order_stats, "_SMALL", small)
    rng = random.Random(5)
    groups = {
        "skewed": [rng.lognormvariate(0, 3) for _ in range(9000)],
        "copies": [float(rng.randrange(4)) for _ in range(9000)],
        "one_value": [1.5] * 4000,
    }
    df = rows("g string, v double", *[(g, v) for g, vs in groups.items() for v in vs])
    ps = [0.0, 0.5, 0.95, 0.99]
    out = {(r["g"], r["p"]): r["v"] for r in order_stats.order_statistics(df, ["g"], "v", ps).collect()}
    assert out == {(g, p): wanted(vs, p) for g, vs in groups.items() for p in ps}


def test_order_statistics_without_key_and_tiny_groups(rows):
    df = rows("v double", (3.0,), (1.0,), (2.0,), (None,))
    out = order_stats.order_statistics(df, [], "v", [0.5, 0.99]).collect()
    assert {(r["p"], r["n"], r["v"]) for r in out} == {(0.5, 3, 2.0), (0.99, 3, 3.0)}


def test_system_metrics_use_the_last_queries_only(rows):
    schema = "query_id long, ts timestamp, success boolean, documents_retrieved long, documents_denied long, total_time_ms double"
    import datetime

    base = datetime.datetime(2024, 1, 1)
    data = [(i, base + datetime.timedelta(seconds=i), i % 5 != 0, 5, 1, float(i)) for i in range(20)]
    out = analytics.system_metrics(rows(schema, *data), history=10).first()
    assert out["total_queries"] == 20 and out["failed_queries"] == 4
    assert out["avg_latency_ms"] == 14.5
    assert (out["p50_latency_ms"], out["p95_latency_ms"], out["p99_latency_ms"]) == (15.0, 19.0, 19.0)
    empty = analytics.system_metrics(rows(schema)).first()
    assert empty["total_queries"] == 0 and empty["p99_latency_ms"] == 0.0


def test_trailing_counts_with_string_ids(rows):
    df = rows("key string, t long, id string", ("a", 0, "x"), ("a", 0, "y"), ("a", 59 * SECOND, "z"))
    out = trailing_counts(df, ["key"], "t", "id", 60)
    assert {r["id"]: r["n_recent"] for r in out.collect()} == {"x": 1, "y": 2, "z": 3}


def test_every_row_is_counted_once_whatever_its_key_time_and_id(rows):
    data = [(None, 0, 1), ("a", 0, 2), ("a", None, 3), ("a", 5, 2), ("a", 5, 2), (None, 7, None), (None, None, None)]
    df = rows("key string, t long, id long", *data)
    out = trailing_counts(df, ["key"], "t", "id", 60).collect()
    assert sorted((tuple(r)[:3] for r in out), key=repr) == sorted(data, key=repr)
    counts = {}
    for r in out:
        counts.setdefault((r["key"], r["t"]), []).append(r["n_recent"])
    assert {k: sorted(v, key=repr) for k, v in counts.items()} == {
        (None, 0): [1], ("a", 0): [1], ("a", None): [None], ("a", 5): [2, 3], (None, 7): [2], (None, None): [None],
    }


def test_limits_keep_null_users_and_repeated_requests(rows):
    data = [(1, None, 0), (1, None, 0), (2, "u", 1), (3, "u", None)]
    out = guardrails.rate_limits(rows("request_id long, username string, micros long", *data), 2, 5).collect()
    assert sorted(((r["request_id"], r["username"], r["micros"]) for r in out), key=repr) == sorted(data, key=repr)
    assert sorted((r["n_global"], r["n_user"]) for r in out if r["username"] is None) == [(1, 1), (2, 2)]
    assert [r["blocked_global"] for r in out if r["request_id"] in (2, 3)].count(True) == 1


def test_counts_above_any_bound(rows):
    df = rows("request_id long, username string, micros long", *[(i, "u", i) for i in range(1200)])
    out = guardrails.rate_limits(df, 1150, 10_000)
    assert out.agg(F.max("n_global"), F.count_if("blocked_global")).first()[:] == (1200, 50)


def test_one_instant_is_cut_by_any_id(spark):
    df = spark.range(40_000).selectExpr("uuid() as id", "cast(0 as long) as t")
    out = trailing_counts(df, [], "t", "id", 60)
    assert out.agg(F.min("n_recent"), F.max("n_recent"), F.count_distinct("n_recent")).first()[:] == (1, 40_000, 40_000)


def test_order_statistics_keep_the_null_group(rows):
    df = rows("g string, v double", (None, 1.0), (None, 3.0), ("a", 2.0))
    out = {(r["g"], r["p"]): r["v"] for r in order_stats.order_statistics(df, ["g"], "v", [0.5]).collect()}
    assert out == {(None, 0.5): 3.0, ("a", 0.5): 2.0}


def test_metrics_cover_the_whole_log(rows):
    data = [(str(i), "HIGH" if i % 2 else None, "t", i) for i in range(1500)]
    df = rows("violation_id string, severity string, violation_type string, recorded_at long", *data)
    out = {(r["kind"], r["key"]): r["n"] for r in analytics.guardrail_metrics(df).collect()}
    assert out == {("severity", "HIGH"): 750, ("severity", "UNKNOWN"): 750, ("type", "t"): 1500, ("total", "all"): 1500}
    bounded = {(r["kind"], r["key"]): r["n"] for r in analytics.guardrail_metrics(df, retention=100).collect()}
    assert bounded[("total", "all")] == 100

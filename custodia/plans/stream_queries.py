"""Streaming queries, run over the files that are there and compared with the batch answer."""

from pyspark.sql import functions as F

from custodia import constants as C
from custodia.operators import access
from custodia.plans.log_queries import sql_stamp, stamp
from custodia.plans.registry import query
from custodia.plans.sql_views import role_mask, terms, with_views, words
from custodia.session import is_folder, new_path
from custodia.sources import logs
from custodia.sources import tables as T
from custodia.streaming import flows, limits, recent
from custodia.plans.corpus_queries import EXTRA_TERMS


def _stream(spark, sf_dir, name):
    """A table's file, or the files of its folder, as a stream; new ones would be picked up as they appear."""
    schema = T.table(spark, sf_dir, name).schema
    if is_folder(spark, path := f"{sf_dir}/{name}.parquet"):
        return logs.stream_log(spark, path, schema)
    return logs.stream_log(spark, sf_dir, schema, pathGlobFilter=f"{name}.parquet")


def _finish(running):
    running.awaitTermination()
    return running


def _paths(spark, name):
    return new_path(spark, f"{name}-out"), new_path(spark, f"{name}-work")


def _requests(spark, sf_dir):
    return T.requests_of(_stream(spark, sf_dir, "events"))


@query("stream_log_files", "SELECT event_type, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY event_type")
def stream_log_files(spark, sf_dir):
    out, work = _paths(spark, "log-files")
    _finish(flows.append_files(_stream(spark, sf_dir, "events"), out, work))
    return spark.read.parquet(out).groupBy("event_type").agg(
        F.count("*").alias("n"), F.max("event_id").alias("last_id")
    )


@query("stream_rate_limit", with_views("limited", """
    SELECT request_id, blocked_global, n_user, blocked_user FROM limited"""))
def stream_rate_limit(spark, sf_dir):
    out, work = _paths(spark, "rate-limit")
    _finish(recent.stream_rate_limit(_requests(spark, sf_dir), out, work, T.PER_MINUTE, T.PER_USER_HOUR))
    return spark.read.parquet(out).select("request_id", "blocked_global", "n_user", "blocked_user")


@query("stream_excessive_denials", with_views("denial_alerts excessive", f"""
    SELECT alert_type, {sql_stamp('ts')} AS "timestamp", "user", message, severity, denial_count FROM
    (SELECT *, NULL::BIGINT AS denial_count FROM denial_alerts UNION ALL BY NAME SELECT * FROM excessive)"""))
def stream_excessive_denials(spark, sf_dir):
    out, work = _paths(spark, "denials")
    refused = access.access_denied(_requests(spark, sf_dir)).withColumn(
        "reason", F.when(F.col("event_type") == "click", F.lit("policy")).otherwise(F.lit(None).cast("string"))
    )
    _finish(recent.stream_excessive_denials(refused, out, work, T.DENIALS_PER_HOUR))
    return spark.read.parquet(out).select(
        "alert_type", stamp("timestamp").alias("timestamp"), "user", "message", "severity", "denial_count"
    )


@query("stateful_rate_limit", with_views("limited", """
    SELECT request_id, n_global, blocked_global, n_user, blocked_user FROM limited"""))
def stateful_rate_limit(spark, sf_dir):
    """The same limits with keyed state."""
    out, work = _paths(spark, "rate-state")
    _finish(limits.stream_rate_limit(_requests(spark, sf_dir), out, work, T.PER_MINUTE, T.PER_USER_HOUR))
    return spark.read.parquet(out).select("request_id", "n_global", "blocked_global", "n_user", "blocked_user")


@query("stateful_denials", with_views("denial_alerts excessive", f"""
    SELECT alert_type, {sql_stamp('ts')} AS "timestamp", "user", message, severity, denial_count FROM
    (SELECT *, NULL::BIGINT AS denial_count FROM denial_alerts UNION ALL BY NAME SELECT * FROM excessive)"""))
def stateful_denials(spark, sf_dir):
    out, work = _paths(spark, "denial-state")
    refused = access.access_denied(_requests(spark, sf_dir)).withColumn(
        "reason", F.when(F.col("event_type") == "click", F.lit("policy")).otherwise(F.lit(None).cast("string"))
    )
    _finish(limits.stream_excessive_denials(refused, out, work, T.DENIALS_PER_HOUR))
    return spark.read.parquet(out).select(
        "alert_type", stamp("timestamp").alias("timestamp"), "user", "message", "severity", "denial_count"
    )


def _violation_log(spark, sf_dir):
    path = new_path(spark, "violation-stream")
    T.violations(spark, sf_dir).write.parquet(path)
    return logs.stream_log(spark, path, spark.read.parquet(path).schema)


@query("stream_violation_alerts", with_views("violations", f"""
    SELECT 'guardrail_' || lower(violation_type) AS alert_type, {sql_stamp('recorded_at')} AS "timestamp", "user",
      'Guardrail violation: ' || description AS message, severity FROM violations WHERE severity IN ('CRITICAL', 'HIGH')"""))
def stream_violation_alerts(spark, sf_dir):
    out, work = _paths(spark, "violation-alerts")
    _finish(flows.append_files(flows.violation_alerts(_violation_log(spark, sf_dir)), out, work))
    return spark.read.parquet(out).select(
        "alert_type", stamp("timestamp").alias("timestamp"), "user", "message", "severity"
    )


@query("stream_append_logs", with_views("violations", """
    SELECT violation_id, violation_type, severity FROM violations"""))
def stream_append_logs(spark, sf_dir):
    """Every record is sent twice and stored once."""
    out, work = _paths(spark, "append-logs")
    path = new_path(spark, "violation-twice")
    found = T.violations(spark, sf_dir)
    twice = found.withColumn("sent", F.explode(F.array(F.lit(1), F.lit(2))))
    twice.write.parquet(path)
    log = logs.stream_log(spark, path, spark.read.parquet(path).schema).drop("sent")
    _finish(flows.append_files(flows.deduplicated(log, "violation_id"), out, work))
    return spark.read.parquet(out).select("violation_id", "violation_type", "severity")


@query("stream_dashboard_counts", f"""
    SELECT 'tumbling' AS kind, {sql_stamp("time_bucket(INTERVAL 1 HOUR, ts)")} AS window_start, event_type, count(*) AS n
    FROM events GROUP BY ALL UNION ALL
    SELECT 'sliding', {sql_stamp("time_bucket(INTERVAL 30 MINUTES, ts) - i * INTERVAL 30 MINUTES")}, event_type, count(*)
    FROM events, (SELECT unnest([0, 1]) AS i) GROUP BY ALL""")
def stream_dashboard_counts(spark, sf_dir):
    from custodia.session import union

    parts = []
    for kind, slide in (("tumbling", None), ("sliding", "30 minutes")):
        out, work = _paths(spark, f"counts-{kind}")
        counts = flows.dashboard_counts(_requests(spark, sf_dir), ["event_type"], slide=slide)
        _finish(flows.upsert_files(counts, out, work))
        newest = flows.newest_rows(spark, out, ["window_start", "window_end", "event_type"])
        parts.append(newest.select(F.lit(kind).alias("kind"), stamp("window_start").alias("window_start"), "event_type", "n"))
    return union(*parts)


@query("stream_cache_sessions", with_views("requests", f"""
    , touched AS (SELECT md5(event_type || query) AS fingerprint, ts, micros FROM requests),
    marked AS (SELECT *, CASE WHEN micros - lag(micros) OVER (PARTITION BY fingerprint ORDER BY micros) <= 3600000000 THEN 0 ELSE 1 END AS s
      FROM touched),
    runs AS (SELECT *, sum(s) OVER (PARTITION BY fingerprint ORDER BY micros) AS run FROM marked)
    SELECT fingerprint, {sql_stamp('min(ts)')} AS session_start, count(*) AS accesses, count(*) - 1 AS hits FROM runs
    GROUP BY fingerprint, run""".lstrip()))
def stream_cache_sessions(spark, sf_dir):
    out, work = _paths(spark, "sessions")
    touched = _requests(spark, sf_dir).select(F.md5(F.concat("event_type", "query")).alias("fingerprint"), "ts")
    _finish(flows.append_files(flows.cache_sessions(touched), out, work))
    return flows.with_open_sessions(spark.read.parquet(out), work).select(
        "fingerprint", stamp("session_start").alias("session_start"), "accesses", "hits"
    )


@query("stream_redaction", f"""
    WITH docs AS (SELECT doc_id AS id, text AS content, {words(T.DOMAINS)}[doc_id % 5 + 1] AS domain,
      {words(C.ROLES)}[(doc_id // 5) % 5 + 1] AS role FROM documents),
    ok AS (SELECT * FROM docs WHERE domain = 'public' OR role = 'admin' OR (role = 'analyst' AND domain IN ('finance', 'hr'))
      OR (role = 'manager' AND domain = 'hr'))
    SELECT id, role, domain, {role_mask()} AS content, {terms(values=EXTRA_TERMS)} AS sensitive_terms FROM ok""")
def stream_redaction(spark, sf_dir):
    out, work = _paths(spark, "redaction")
    doc = F.col("doc_id")
    arriving = _stream(spark, sf_dir, "documents").select(
        doc.alias("id"), F.col("text").alias("content"), T.pick(T.DOMAINS, doc).alias("domain"),
        T.pick(C.ROLES, F.floor(doc / 5)).alias("role"),
    )
    _finish(flows.append_files(flows.redaction(arriving, EXTRA_TERMS), out, work))
    return spark.read.parquet(out).select(
        "id", "role", "domain", "content", F.array_join("sensitive_terms_detected", ",").alias("sensitive_terms")
    )


@query("stream_latency_histogram", with_views("flagged", f"""
    SELECT window_start, endpoint, le, sum(CASE WHEN seconds <= CASE WHEN le = '+Inf' THEN 'infinity'::DOUBLE ELSE le::DOUBLE END
      THEN 1 ELSE 0 END)::BIGINT AS n, round(sum(seconds), 4) AS total, count(*) AS observations FROM
    (SELECT {sql_stamp("time_bucket(INTERVAL 1 HOUR, ts)")} AS window_start, CASE WHEN request_id % 3 = 0 THEN '/query/compliance'
      ELSE '/query' END AS endpoint, latency_ms / 100 AS seconds FROM flagged),
    (SELECT unnest({words([*C.LATENCY_BUCKETS, '+Inf'])}) AS le) GROUP BY ALL"""))
def stream_latency_histogram(spark, sf_dir):
    out, work = _paths(spark, "histogram")
    timed = _requests(spark, sf_dir).select(
        "ts", F.when(F.col("request_id") % 3 == 0, "/query/compliance").otherwise("/query").alias("endpoint"),
        (F.col("latency_ms") / 100).alias("seconds"),
    )
    _finish(flows.upsert_files(flows.latency_histogram(timed, ["endpoint"]), out, work))
    newest = flows.newest_rows(spark, out, ["window_start", "endpoint", "le"])
    return newest.select(
        stamp("window_start").alias("window_start"), "endpoint", "le", "n",
        F.round("total", 4).alias("total"), "observations",
    )

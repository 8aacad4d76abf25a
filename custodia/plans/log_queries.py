"""Request, audit, violation and alert logs: counts, windows, limits, alerts."""

from pyspark.sql import functions as F

from custodia import constants as C
from custodia.functions import text
from custodia.operators import access, alerts, analytics, guardrails, lifetimes
from custodia.operators.order_stats import order_statistics
from custodia.plans.registry import query
from custodia.plans.sql_views import text as lit
from custodia.plans.sql_views import with_views, words
from custodia.sources import tables as T

STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def stamp(column):
    return F.date_format(column, STAMP)


def sql_stamp(column):
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


# --- request shape ---------------------------------------------------------------------


@query("validate_requests", f"""
    WITH raw AS (SELECT event_id AS request_id, 'user_' || user_id AS username, {words(T.REQUESTED_ROLES)}[(user_id % 6) + 1] AS role,
      CASE WHEN event_type = 'signup' THEN '' ELSE props END AS query,
      (regexp_extract(props, '"k": ([0-9]+)', 1))::INT AS k, {words(T.REQUESTED_FRAMEWORKS)}[(event_id % 5) + 1] AS framework FROM events)
    SELECT request_id, coalesce(array_to_string([
      CASE WHEN length(username) NOT BETWEEN 1 AND 100 THEN 'username' END,
      CASE WHEN role NOT IN ('admin', 'analyst', 'manager', 'employee', 'guest') THEN 'role' END,
      CASE WHEN length(query) NOT BETWEEN 1 AND 1000 THEN 'query' END,
      CASE WHEN k NOT BETWEEN 1 AND 20 THEN 'k' END,
      CASE WHEN framework NOT IN ('hipaa', 'gdpr', 'sox', 'general') THEN 'framework' END], ','), '') AS reasons FROM raw""")
def validate_requests(spark, sf_dir):
    events = T.table(spark, sf_dir, "events")
    raw = events.select(
        F.col("event_id").alias("request_id"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("username"),
        T.pick(T.REQUESTED_ROLES, F.col("user_id")).alias("role"),
        F.when(F.col("event_type") == "signup", "").otherwise(F.col("props")).alias("query"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        T.pick(T.REQUESTED_FRAMEWORKS, F.col("event_id")).alias("framework"),
    )
    return text.with_reject_reasons(raw).select("request_id", F.array_join("reasons", ",").alias("reasons"))


@query("message_text", """
    SELECT conv_id, turn, array_to_string(list_filter(string_split(text, chr(10)), lambda p: p <> ''), ' ') AS message
    FROM conversations WHERE role = 'user' AND len(list_filter(string_split(text, chr(10)), lambda p: p <> '')) > 0""")
def message_text(spark, sf_dir):
    """The lines of a user turn stand for the parts of its message."""
    turns = T.table(spark, sf_dir, "conversations").filter("role = 'user'")
    parts = turns.select("conv_id", "turn", F.split("text", "\n").alias("parts"))
    return parts.select("conv_id", "turn", text.message_text("parts").alias("message")).filter("message is not null")


@query("stage_times", with_views("query_metrics", """
    SELECT query_id, round(retrieval_time * 1000, 6) AS retrieval_time_ms, round(validation_time * 1000, 6) AS validation_time_ms,
      round(generation_time * 1000, 6) AS generation_time_ms, round(total_time_ms, 6) AS total_time_ms,
      length(query) AS query_length, strftime(ts, '%Y-%m-%d-%H') AS hour_key FROM query_metrics"""))
def stage_times(spark, sf_dir):
    timed = analytics.stage_times(T.query_metrics(spark, sf_dir))
    times = [c for c in timed.columns if c.endswith("_ms")]
    return timed.select("query_id", *[F.round(c, 6).alias(c) for c in times], "query_length", "hour_key")


@query("interaction_log", f"""
    WITH pairs AS (SELECT u.conv_id, u.turn, u.text AS query, a.text AS response FROM conversations u
      LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user')
    SELECT conv_id, turn, CASE WHEN conv_id % 7 = 0 THEN 'anonymous' ELSE 'user_' || conv_id END AS "user",
      CASE WHEN conv_id % 7 = 0 THEN 'guest' ELSE {words(C.ROLES)}[(conv_id % 5) + 1] END AS user_role, query,
      CASE WHEN response IS NULL THEN 'Error: no response' WHEN length(response) > 200 THEN substr(response, 1, 200) || '...'
        ELSE response END AS response_preview, length(response) / 100.0 AS duration_seconds,
      CASE WHEN response IS NULL THEN 'error' ELSE 'success' END AS status,
      CASE WHEN response IS NULL THEN 'no response' END AS error FROM pairs""")
def interaction_log(spark, sf_dir):
    return _interactions(spark, sf_dir).drop("timestamp")


def _interactions(spark, sf_dir):
    turns = T.table(spark, sf_dir, "conversations")
    conv = F.col("conv_id")
    known = conv % 7 != 0
    asked = turns.filter("role = 'user'").select(
        "conv_id", "turn", F.col("text").alias("query"),
        F.when(known, F.concat(F.lit("user_"), conv.cast("string"))).alias("username"),
        F.when(known, T.pick(C.ROLES, conv)).alias("role"),
        F.timestamp_seconds(F.lit(1704067200) + conv * 60).alias("start_ts"),
    )
    answered = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"),
    )
    rows = asked.join(answered, ["conv_id", "turn"], "left").withColumns(
        {
            "end_ts": F.timestamp_micros(F.unix_micros("start_ts") + F.length("response") * 10_000),
            "error": F.when(F.col("response").isNull(), "no response"),
        }
    )
    return analytics.interaction_log(rows, ["conv_id", "turn"])


@query("audit_events", with_views("flagged", f"""
    SELECT * FROM (SELECT request_id, 'access_control' AS event_type, {sql_stamp('ts')} AS "timestamp", username AS "user",
      role AS user_role, domain, CASE WHEN allowed THEN 'granted' ELSE 'denied' END AS decision,
      'doc_' || (request_id % 100) AS document_id, CASE WHEN NOT allowed THEN 'role' END AS reason, NULL AS query,
      NULL::BIGINT AS documents_retrieved, NULL::BIGINT AS documents_validated FROM flagged
    UNION ALL SELECT request_id, 'query', {sql_stamp('ts')}, username, role, domain, NULL, NULL, NULL, query, 5,
      5 - user_id % 3 FROM flagged WHERE allowed)"""))
def audit_events(spark, sf_dir):
    return _audit(spark, sf_dir).withColumn("timestamp", stamp("timestamp"))


def _audit(spark, sf_dir):
    flagged = access.with_access_flag(T.requests(spark, sf_dir)).withColumns(
        {
            "document_id": F.concat(F.lit("doc_"), (F.col("request_id") % 100).cast("string")),
            "reason": F.when(~F.col("allowed"), F.lit("role")),
            "documents_retrieved": F.lit(5).cast("long"),
            "documents_validated": (F.lit(5) - F.col("user_id") % 3).cast("long"),
        }
    )
    return analytics.audit_events(flagged, "request_id")


# --- aggregates ------------------------------------------------------------------------


@query("system_metrics", with_views("query_metrics", """
    SELECT t.*, round(avg_ms, 8) AS avg_latency_ms, round(v[floor(n * 0.5::DOUBLE)::BIGINT + 1], 8) AS p50_latency_ms,
      round(v[floor(n * 0.95::DOUBLE)::BIGINT + 1], 8) AS p95_latency_ms, round(v[floor(n * 0.99::DOUBLE)::BIGINT + 1], 8) AS p99_latency_ms
    FROM (SELECT count(*) AS total_queries, count_if(success) AS successful_queries, count_if(NOT success) AS failed_queries,
      sum(documents_retrieved)::BIGINT AS total_documents_retrieved, sum(documents_denied)::BIGINT AS total_validation_denials
      FROM query_metrics) t,
    (SELECT avg(total_time_ms) AS avg_ms, list_sort(list(total_time_ms)) AS v, count(*) AS n
      FROM query_metrics)"""))
def system_metrics(spark, sf_dir):
    out = analytics.system_metrics(analytics.stage_times(T.query_metrics(spark, sf_dir)))
    return out.select(*[F.round(c, 8).alias(c) if c.endswith("_ms") else c for c in out.columns])


@query("latency_percentiles", with_views("requests", """
    SELECT role, p, n, v[floor(n * p)::BIGINT + 1] AS latency_ms FROM (SELECT role, list_sort(list(latency_ms)) AS v, count(*) AS n
      FROM requests GROUP BY role), (SELECT unnest([0.5::DOUBLE, 0.95::DOUBLE, 0.99::DOUBLE]) AS p)"""))
def latency_percentiles(spark, sf_dir):
    return order_statistics(T.requests(spark, sf_dir), ["role"], "latency_ms", [0.5, 0.95, 0.99])


@query("queries_by_role", with_views("query_metrics", "SELECT user_role, count(*) AS n FROM query_metrics GROUP BY user_role"))
def queries_by_role(spark, sf_dir):
    return analytics.counts_by(T.query_metrics(spark, sf_dir), "user_role")


@query("queries_by_hour", with_views("query_metrics", """
    SELECT strftime(ts, '%Y-%m-%d-%H') AS hour_key, count(*) AS n FROM query_metrics GROUP BY 1"""))
def queries_by_hour(spark, sf_dir):
    return analytics.counts_by(analytics.stage_times(T.query_metrics(spark, sf_dir)), "hour_key")


@query("queries_by_role_and_hour", with_views("query_metrics", """
    SELECT 'role' AS kind, user_role AS key, count(*) AS n FROM query_metrics GROUP BY 2
    UNION ALL SELECT 'hour', strftime(ts, '%Y-%m-%d-%H'), count(*) FROM query_metrics GROUP BY 2"""))
def queries_by_role_and_hour(spark, sf_dir):
    return analytics.queries_by_role_and_hour(analytics.stage_times(T.query_metrics(spark, sf_dir)))


@query("security_summary", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def security_summary(spark, sf_dir):
    return analytics.counts_by(T.requests(spark, sf_dir), "event_type")


@query("guardrail_metrics", with_views("violations", """
    SELECT 'severity' AS kind, severity AS key, count(*) AS n FROM violations GROUP BY 2
    UNION ALL SELECT 'type', violation_type, count(*) FROM violations GROUP BY 2
    UNION ALL SELECT 'total', 'all', count(*) FROM violations"""))
def guardrail_metrics(spark, sf_dir):
    return analytics.guardrail_metrics(T.violations(spark, sf_dir))


def _alerts(spark, sf_dir):
    refused = T.denials(spark, sf_dir)
    return alerts.union_alerts(
        alerts.denial_to_alert(refused),
        alerts.excessive_denials(refused, T.DENIALS_PER_HOUR),
        alerts.violation_to_alert(T.violations(spark, sf_dir)),
    )


_SEVERITIES = """severities AS (SELECT severity FROM denial_alerts UNION ALL SELECT severity FROM excessive
      UNION ALL SELECT severity FROM violations WHERE severity IN ('CRITICAL', 'HIGH'))"""
_LEVELS = """count(*) AS total_alerts, count_if(severity = 'CRITICAL') AS critical_alerts,
      count_if(severity = 'HIGH') AS high_alerts, count_if(severity = 'MEDIUM') AS medium_alerts,
      count_if(severity = 'LOW') AS low_alerts"""


@query("security_metrics", with_views("denial_alerts excessive violations", f"SELECT {_LEVELS} FROM severities", _SEVERITIES))
def security_metrics(spark, sf_dir):
    return analytics.security_metrics(_alerts(spark, sf_dir))


@query("compliance_report", with_views("flagged", """
    SELECT 'SOX' AS framework, 'Last 10 days' AS period, count(*) AS total_access_attempts, count_if(allowed) AS access_granted,
      count_if(NOT allowed) AS access_denied, count_if(allowed) AS total_queries,
      CASE WHEN count_if(NOT allowed) = 0 THEN 'COMPLIANT' ELSE 'DENIALS_RECORDED' END AS status
    FROM flagged WHERE ts >= TIMESTAMP '2024-01-25 12:00:00' - INTERVAL 10 DAYS"""))
def compliance_report(spark, sf_dir):
    now = F.lit("2024-01-25 12:00:00").cast("timestamp")
    return analytics.compliance_report(_audit(spark, sf_dir), now, 10, "sox")


@query("compliance_report_retained", with_views("flagged", """
    , events_of AS (SELECT ts, request_id, 'access_control' AS kind, allowed FROM flagged
      UNION ALL SELECT ts, request_id, 'query', allowed FROM flagged WHERE allowed),
    kept AS (SELECT * FROM events_of ORDER BY ts DESC, request_id DESC, kind DESC LIMIT 10000)
    SELECT 'GENERAL' AS framework, 'Last 30 days' AS period, count_if(kind = 'access_control') AS total_access_attempts,
      count_if(kind = 'access_control' AND allowed) AS access_granted, count_if(NOT allowed) AS access_denied,
      count_if(kind = 'query') AS total_queries, CASE WHEN count_if(NOT allowed) = 0 THEN 'COMPLIANT' ELSE 'DENIALS_RECORDED' END AS status
    FROM kept WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 30 DAYS""".lstrip()))
def compliance_report_retained(spark, sf_dir):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return analytics.compliance_report(_audit(spark, sf_dir), now, retention=C.AUDIT_RETENTION)


_COUNTERS = """count(*) + count_if(allowed) AS total_events, count_if(allowed) AS access_granted,
      count_if(NOT allowed) AS access_denied, count_if(allowed) AS total_queries"""


@query("audit_counters", with_views("flagged", f"SELECT {_COUNTERS} FROM flagged"))
def audit_counters(spark, sf_dir):
    return analytics.audit_counters(_audit(spark, sf_dir))


@query("dashboard_summary", with_views("denial_alerts excessive violations", f"""
    , g AS (SELECT count(*) AS total_violations, count_if(severity = 'CRITICAL') AS critical_violations,
      count_if(severity = 'HIGH') AS high_violations FROM violations),
    s AS (SELECT {_LEVELS} FROM severities), a AS (SELECT {_COUNTERS} FROM flagged)
    SELECT g.*, s.*, a.* FROM g, s, a""".lstrip(), _SEVERITIES))
def dashboard_summary(spark, sf_dir):
    return analytics.dashboard_summary(
        T.violations(spark, sf_dir), _alerts(spark, sf_dir), _audit(spark, sf_dir)
    )


def _request_labels(spark, sf_dir):
    flagged = access.with_access_flag(T.requests(spark, sf_dir))
    status = (
        F.when(~F.col("success"), "error").when(F.col("allowed"), "success").otherwise("denied")
    )
    return flagged.select(
        F.lit("POST").alias("method"),
        F.when(F.col("request_id") % 3 == 0, "/query/compliance").otherwise("/query").alias("endpoint"),
        status.alias("status"),
        (F.col("latency_ms") / 100).alias("seconds"),
    )


_LABELS = """labels_of AS (SELECT 'POST' AS method, CASE WHEN request_id % 3 = 0 THEN '/query/compliance' ELSE '/query' END
      AS endpoint, CASE WHEN NOT success THEN 'error' WHEN allowed THEN 'success' ELSE 'denied' END AS status,
      latency_ms / 100 AS seconds FROM flagged)"""


@query("request_counters", with_views("flagged", "SELECT method, endpoint, status, count(*) AS n FROM labels_of GROUP BY ALL", _LABELS))
def request_counters(spark, sf_dir):
    return analytics.counts_by(_request_labels(spark, sf_dir), "method", "endpoint", "status")


@query("denials_by_reason", with_views("denials", "SELECT coalesce(reason, 'access_denied') AS reason, count(*) AS n FROM denials GROUP BY 1"))
def denials_by_reason(spark, sf_dir):
    refused = T.denials(spark, sf_dir).withColumn("reason", F.coalesce("reason", F.lit("access_denied")))
    return analytics.counts_by(refused, "reason")


@query("latency_histogram", with_views("flagged", f"""
    SELECT method, endpoint, le, sum(CASE WHEN seconds <= CASE WHEN le = '+Inf' THEN 'infinity'::DOUBLE ELSE le::DOUBLE END
      THEN 1 ELSE 0 END)::BIGINT AS n, round(sum(seconds), 4) AS total, count(*) AS observations
    FROM labels_of, (SELECT unnest({words([*C.LATENCY_BUCKETS, '+Inf'])}) AS le) GROUP BY ALL""", _LABELS))
def latency_histogram(spark, sf_dir):
    out = analytics.latency_histogram(_request_labels(spark, sf_dir), ["method", "endpoint"], "seconds")
    return out.withColumn("total", F.round("total", 4))


def _actions(spark, sf_dir):
    return T.requests(spark, sf_dir).select(
        T.pick(C.AGENTS, F.col("user_id")).alias("agent_role"), "success"
    )


_ACTIONS = f"actions AS (SELECT {words(C.AGENTS)}[(user_id % 5) + 1] AS agent_role, success FROM requests)"


@query("agent_action_summary", with_views("requests", """
    SELECT agent_role, count(*) AS actions, count_if(success) AS successful, count_if(NOT success) AS failed,
      agent_role || ': ' || count(*) || ' actions (' || count_if(success) || ' successful, ' || count_if(NOT success) || ' failed)'
      AS summary FROM actions GROUP BY agent_role""", _ACTIONS))
def agent_action_summary(spark, sf_dir):
    return analytics.action_summary(_actions(spark, sf_dir))


@query("agent_metrics", with_views("requests", """
    SELECT count(*) AS total_actions, 5 AS agent_count, count_if(agent_role = 'orchestrator') AS orchestrator_tasks
    FROM actions""", _ACTIONS))
def agent_metrics(spark, sf_dir):
    return analytics.agent_metrics(_actions(spark, sf_dir))


@query("session_state", with_views("requests", """
    SELECT session_id, domain, department_role, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, request_id DESC) = 1
      AS is_last_domain FROM (SELECT *, row_number() OVER (PARTITION BY session_id, domain ORDER BY ts DESC, request_id DESC) AS r
      FROM (SELECT * EXCLUDE (department_role), ['manager','Employee','general','analyst','doctor','paralegal','visitor']
        [(request_id % 7) + 1] AS department_role FROM requests)) WHERE r = 1"""))
def session_state(spark, sf_dir):
    named = T.requests(spark, sf_dir).withColumn(
        "department_role", T.pick(T.DEPARTMENT_ROLE_NAMES, F.col("request_id"))
    )
    return analytics.session_state(named)


# --- windows and limits ----------------------------------------------------------------


@query("rate_limit_global", with_views("rate_global", f"""
    SELECT request_id, n_global, n_global > {T.PER_MINUTE} AS blocked_global FROM rate_global"""))
def rate_limit_global(spark, sf_dir):
    limited = guardrails.rate_limit_global(T.requests(spark, sf_dir), T.PER_MINUTE)
    return limited.select("request_id", "n_global", "blocked_global")


@query("rate_limit_user", with_views("limited", """
    SELECT request_id, blocked_global, n_user, blocked_user FROM limited"""))
def rate_limit_user(spark, sf_dir):
    limited = guardrails.rate_limits(T.requests(spark, sf_dir), T.PER_MINUTE, T.PER_USER_HOUR)
    return limited.select("request_id", "blocked_global", "n_user", "blocked_user")


@query("excessive_denials", with_views("denial_alerts excessive", f"""
    SELECT alert_type, type, {sql_stamp('ts')} AS "timestamp", "user", session_id, message, description, severity,
      denial_count, domain, role, query FROM
    (SELECT * EXCLUDE (request_id), NULL::BIGINT AS denial_count FROM denial_alerts UNION ALL BY NAME
     SELECT * EXCLUDE (request_id) FROM excessive)"""))
def excessive_denials(spark, sf_dir):
    refused = T.denials(spark, sf_dir)
    both = alerts.union_alerts(
        alerts.denial_to_alert(refused), alerts.excessive_denials(refused, T.DENIALS_PER_HOUR)
    )
    return both.withColumn("timestamp", stamp("timestamp"))


_CACHE = """touched AS (SELECT md5(event_type || query) AS fingerprint, micros FROM requests),
    gaps AS (SELECT fingerprint, micros - lag(micros) OVER (PARTITION BY fingerprint ORDER BY micros) AS gap FROM touched),
    per_key AS (SELECT fingerprint, count(*) AS accesses, count_if(coalesce(gap <= 3600000000, false)) AS hits,
      count(*) - count_if(coalesce(gap <= 3600000000, false)) AS misses FROM gaps GROUP BY fingerprint)"""


def _cache_keys(spark, sf_dir):
    touched = T.requests(spark, sf_dir).select(
        F.md5(F.concat("event_type", "query")).alias("fingerprint"), "micros"
    )
    return analytics.cache_hits(touched)


@query("repeat_query_hits", with_views("requests", "SELECT * FROM per_key", _CACHE))
def repeat_query_hits(spark, sf_dir):
    return _cache_keys(spark, sf_dir)


@query("cache_stats", with_views("requests", """
    SELECT sum(hits)::BIGINT AS hits, sum(misses)::BIGINT AS misses, round(sum(hits) * 100.0::DOUBLE / sum(accesses), 2)
      AS hit_rate_percent FROM per_key""", _CACHE))
def cache_stats(spark, sf_dir):
    return analytics.cache_stats(_cache_keys(spark, sf_dir))


@query("fixed_lifetime_hits", with_views("requests", """
    SELECT * FROM (WITH RECURSIVE moments AS MATERIALIZED (SELECT event_type, micros AS t, count(*) AS n FROM requests GROUP BY ALL),
      nexts AS MATERIALIZED (SELECT a.event_type, a.t, min(b.t) AS next FROM moments a JOIN moments b
        ON b.event_type = a.event_type AND b.t > a.t + 3600000000 GROUP BY ALL),
      sets AS (SELECT event_type, min(t) AS t FROM moments GROUP BY event_type
        UNION ALL SELECT s.event_type, x.next FROM sets s JOIN nexts x ON x.event_type = s.event_type AND x.t = s.t)
      SELECT m.event_type, accesses, accesses - misses AS hits, misses
      FROM (SELECT event_type, sum(n)::BIGINT AS accesses FROM moments GROUP BY event_type) m
      JOIN (SELECT event_type, count(*) AS misses FROM sets GROUP BY event_type) USING (event_type))"""))
def fixed_lifetime_hits(spark, sf_dir):
    """One entry per event type: few keys, each of them hot."""
    return lifetimes.fixed_lifetime_hits(T.requests(spark, sf_dir).select("event_type", "micros"), "event_type")


@query("retain_last_n", with_views("violations", """
    SELECT violation_id, severity FROM violations ORDER BY recorded_at DESC, violation_id DESC LIMIT 1000"""))
def retain_last_n(spark, sf_dir):
    kept = analytics.retain_last_n(T.violations(spark, sf_dir), C.LOG_RETENTION, "recorded_at", "violation_id")
    return kept.select("violation_id", "severity")


@query("recent_n", with_views("query_metrics", """
    SELECT query_id, "user", user_role, round(total_time_ms, 6) AS total_time_ms, documents_retrieved, documents_validated, success,
      row_number() OVER (ORDER BY ts, query_id) AS position FROM (SELECT * FROM query_metrics ORDER BY ts DESC, query_id DESC LIMIT 10)"""))
def recent_n(spark, sf_dir):
    timed = analytics.stage_times(T.query_metrics(spark, sf_dir))
    latest = analytics.recent_n(timed, 10, "ts", "query_id")
    return analytics.positions(latest, "ts", "query_id").select(
        "query_id", "user", "user_role", F.round("total_time_ms", 6).alias("total_time_ms"),
        "documents_retrieved", "documents_validated", "success", "position",
    )


# --- violations and alerts -------------------------------------------------------------


@query("to_violation_record", with_views("rate_violations", f"""
    SELECT violation_type, severity, description, {sql_stamp('ts')} AS "timestamp", username AS "user", username,
      session_id, {sql_stamp('ts')} AS recorded_at, query, query AS user_message FROM rate_violations"""))
def to_violation_record(spark, sf_dir):
    limited = guardrails.rate_limits(T.requests(spark, sf_dir), T.PER_MINUTE, T.PER_USER_HOUR)
    hits = limited.withColumns(guardrails.rate_violation_columns()).filter("violation_type is not null")
    record = guardrails.violation_record(hits, query="query").drop("additional_data")
    return record.withColumns({"timestamp": stamp("timestamp"), "recorded_at": stamp("recorded_at")})


@query("violation_to_alert", with_views("violations", f"""
    SELECT 'guardrail_' || lower(violation_type) AS alert_type, violation_type AS type, {sql_stamp('recorded_at')} AS "timestamp",
      "user", session_id, 'Guardrail violation: ' || description AS message, description, severity, substr(query, 1, 200) AS query,
      violation_type FROM violations WHERE severity IN ('CRITICAL', 'HIGH')"""))
def violation_to_alert(spark, sf_dir):
    out = alerts.violation_to_alert(T.violations(spark, sf_dir))
    return out.withColumn("timestamp", stamp("timestamp"))


@query("denial_to_alert", with_views("denial_alerts", f"""
    SELECT * EXCLUDE (ts, request_id), {sql_stamp('ts')} AS "timestamp" FROM denial_alerts"""))
def denial_to_alert(spark, sf_dir):
    return alerts.denial_to_alert(T.denials(spark, sf_dir)).withColumn("timestamp", stamp("timestamp"))


@query("create_alert", with_views("requests", f"""
    SELECT 'slow_request' AS alert_type, 'slow_request' AS type, {sql_stamp('ts')} AS "timestamp", username AS "user", session_id,
      'Request ' || request_id || ' was slow' AS message, 'Request ' || request_id || ' was slow' AS description,
      'MEDIUM' AS severity, latency_ms FROM requests WHERE latency_ms > 100"""))
def create_alert(spark, sf_dir):
    slow = T.requests(spark, sf_dir).filter(F.col("latency_ms") > 100)
    message = F.concat(F.lit("Request "), F.col("request_id").cast("string"), F.lit(" was slow"))
    out = alerts.create_alert(
        slow, "slow_request", message, user="username", session_id="session_id", latency_ms=F.col("latency_ms")
    )
    return out.withColumn("timestamp", stamp("timestamp"))


_BLOCKED = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in C.BLOCKED_REASONS.items())


@query("blocked_message", with_views("violations", f"""
    SELECT violation_id, {lit(C.BLOCKED_HEAD)} || coalesce(CASE upper(violation_type) {_BLOCKED} END, description)
      || {lit(C.BLOCKED_TAIL)} AS message FROM violations"""))
def blocked_message(spark, sf_dir):
    return T.violations(spark, sf_dir).select(
        "violation_id", text.blocked_message("violation_type", "description").alias("message")
    )


@query("filter_violations", with_views("violations", """
    SELECT violation_id, violation_type, severity FROM violations WHERE severity = 'HIGH' AND violation_type = 'rate_limit_exceeded'
    ORDER BY recorded_at DESC, violation_id DESC LIMIT 50"""))
def filter_violations(spark, sf_dir):
    kept = guardrails.filter_violations(T.violations(spark, sf_dir), C.HIGH, C.RATE_LIMIT_EXCEEDED)
    return analytics.recent_n(kept, 50, "recorded_at", "violation_id").select(
        "violation_id", "violation_type", "severity"
    )


@query("filter_alerts", with_views("excessive", f"""
    SELECT alert_type, "user", {sql_stamp('ts')} AS "timestamp", message FROM excessive ORDER BY ts DESC, "user" DESC LIMIT 50"""))
def filter_alerts(spark, sf_dir):
    refused = T.denials(spark, sf_dir)
    both = alerts.union_alerts(
        alerts.denial_to_alert(refused), alerts.excessive_denials(refused, T.DENIALS_PER_HOUR)
    )
    high = alerts.filter_alerts(both, C.HIGH)
    return analytics.recent_n(high, 50, "timestamp", "user").select(
        "alert_type", "user", stamp("timestamp").alias("timestamp"), "message"
    )


_JUDGED = """judged AS (SELECT *, coalesce((SELECT max(toxic) FROM labels l WHERE l.doc_id = request_id), 0) = 1 AS unsafe
      FROM limited)"""


@query("moderation_gate", with_views("corpus", """
    SELECT id, coalesce((SELECT max(toxic) FROM labels l WHERE l.doc_id = id), 0) = 1 AS unsafe,
      CASE WHEN coalesce((SELECT max(toxic) FROM labels l WHERE l.doc_id = id), 0) = 1 THEN 'toxic_content' END AS violation_type
    FROM corpus"""))
def moderation_gate(spark, sf_dir):
    docs = T.corpus(spark, sf_dir).select("id")
    judged = guardrails.moderation_gate(docs, T.verdicts(spark, sf_dir), "id", "verdict_id")
    return judged.select("id", "unsafe", F.when(F.col("unsafe"), C.TOXIC_CONTENT).alias("violation_type"))


_INPUT = """CASE WHEN blocked_global OR blocked_user THEN 'rate_limit_exceeded' WHEN unsafe THEN 'toxic_content' END"""
_INPUT_SEVERITY = "CASE WHEN blocked_global THEN 'HIGH' WHEN blocked_user THEN 'MEDIUM' WHEN unsafe THEN 'HIGH' END"
_INPUT_TEXT = f"""CASE WHEN blocked_global THEN 'Global rate limit exceeded: ' || n_global || ' requests per minute'
      WHEN blocked_user THEN 'User rate limit exceeded: ' || n_user || ' requests per hour'
      WHEN unsafe THEN {lit(C.TOXIC_DESCRIPTION)} END"""


def _input_gate(spark, sf_dir):
    return guardrails.input_gate(
        T.requests(spark, sf_dir), T.verdicts(spark, sf_dir), "request_id", "verdict_id",
        T.PER_MINUTE, T.PER_USER_HOUR,
    )


@query("input_gate", with_views("limited", f"""
    SELECT request_id, {_INPUT} AS violation_type, {_INPUT_SEVERITY} AS severity, {_INPUT_TEXT} AS description FROM judged""", _JUDGED))
def input_gate(spark, sf_dir):
    return _input_gate(spark, sf_dir).select("request_id", "violation_type", "severity", "description")


@query("safety_verdicts", with_views("limited", f"""
    SELECT request_id, {_INPUT} IS NULL AS is_safe, {_INPUT} IS NULL AS passed_validation, {_INPUT} AS violation_type,
      CASE WHEN {_INPUT} IS NULL THEN 'Query is safe' ELSE 'Validation failed: ' || {_INPUT_TEXT} END AS message FROM judged""", _JUDGED))
def safety_verdicts(spark, sf_dir):
    return _input_gate(spark, sf_dir).select(
        "request_id", "is_safe", F.col("is_safe").alias("passed_validation"), "violation_type",
        guardrails.safety_message("Query").alias("message"),
    )


@query("dashboard_rows", with_views("violations", f"""
    SELECT violation_id, array_to_string(list_transform(string_split(violation_type, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ')
      AS type_label, severity, username, coalesce(session_id, 'N/A') AS session_id,
      CASE WHEN length(query) > 50 THEN substr(query, 1, 50) || '...' ELSE coalesce(query, 'N/A') END AS query, description,
      {sql_stamp('recorded_at')} AS shown_at FROM violations ORDER BY recorded_at DESC, violation_id DESC LIMIT 20"""))
def dashboard_rows(spark, sf_dir):
    out = analytics.dashboard_rows(T.violations(spark, sf_dir))
    return out.withColumn("shown_at", stamp("shown_at"))


@query("dashboard_bars", with_views("violations", """
    SELECT violation_type, count(*) AS n, round(count(*) / (max(count(*)) OVER ())::DOUBLE * 100, 6) AS width FROM violations GROUP BY 1"""))
def dashboard_bars(spark, sf_dir):
    return analytics.bar_widths(T.violations(spark, sf_dir), "violation_type")

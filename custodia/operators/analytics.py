"""Aggregates over request, audit, violation and alert logs."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from custodia import constants as C
from custodia.operators.order_stats import order_statistics
from custodia.session import union


def recent_n(df: DataFrame, n: int, ts="ts", order_id="request_id") -> DataFrame:
    """The newest ``n`` rows (a top-n, not a full sort); none for n = 0."""
    return df.orderBy(F.col(ts).desc(), F.col(order_id).desc()).limit(n)


def retain_last_n(df: DataFrame, n=None, ts="ts", order_id="request_id") -> DataFrame:
    """The whole log, or its newest ``n`` rows where a bound is asked for."""
    return df if n is None else recent_n(df, n, ts, order_id)


def positions(df: DataFrame, *order) -> DataFrame:
    """1-based position of each row of a short result, for readers that want it in order."""
    return df.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("long"))


def interaction_log(rows: DataFrame, ids) -> DataFrame:
    """One log row per answered (or failed) query, with the defaults of anonymous users."""
    from custodia.functions.text import preview

    answer = F.coalesce("response", F.concat(F.lit("Error: "), F.col("error")))
    micros = F.unix_micros("end_ts") - F.unix_micros("start_ts")
    return rows.select(
        *ids,
        F.coalesce("username", F.lit("anonymous")).alias("user"),
        F.coalesce("role", F.lit("guest")).alias("user_role"),
        "query",
        F.col("start_ts").alias("timestamp"),
        preview(answer).alias("response_preview"),
        (micros / 1e6).alias("duration_seconds"),
        F.when(F.col("error").isNull(), "success").otherwise("error").alias("status"),
        "error",
    )


def dashboard_summary(violations: DataFrame, alerts: DataFrame, audit: DataFrame,
                      retention=None) -> DataFrame:
    """The totals of all three logs as one row; ``retention`` bounds the violations looked at."""
    kept = retain_last_n(violations, retention, "recorded_at", "violation_id")
    guard = kept.agg(
        F.count("*").alias("total_violations"),
        F.count_if(F.col("severity") == C.CRITICAL).alias("critical_violations"),
        F.count_if(F.col("severity") == C.HIGH).alias("high_violations"),
    )
    parts = union(guard, security_metrics(alerts), audit_counters(audit), allow_missing=True)
    return parts.agg(*[F.max(c).alias(c) for c in parts.columns])


def stage_times(df: DataFrame) -> DataFrame:
    """Seconds to milliseconds per stage, their total, query length and hour key."""
    total = F.col("retrieval_time") + F.col("validation_time") + F.col("generation_time")
    return df.withColumns(
        {
            "retrieval_time_ms": F.col("retrieval_time") * 1000,
            "validation_time_ms": F.col("validation_time") * 1000,
            "generation_time_ms": F.col("generation_time") * 1000,
            "total_time_ms": total * 1000,
            "query_length": F.length("query").cast("long"),
            "hour_key": F.date_format("ts", "yyyy-MM-dd-HH"),
        }
    ).drop("retrieval_time", "validation_time", "generation_time")


def system_metrics(metrics: DataFrame, history=None) -> DataFrame:
    """One row: lifetime counters, and mean and percentiles of the latency.

    With ``history`` the latency figures are those of that many of the newest queries."""
    totals = metrics.agg(
        F.count("*").alias("total_queries"),
        F.count_if("success").alias("successful_queries"),
        F.count_if(~F.col("success")).alias("failed_queries"),
        F.coalesce(F.sum("documents_retrieved"), F.lit(0)).alias("total_documents_retrieved"),
        F.coalesce(F.sum("documents_denied"), F.lit(0)).alias("total_validation_denials"),
    )
    timed = retain_last_n(metrics, history, "ts", "query_id").select("total_time_ms")
    mean = timed.agg(F.coalesce(F.avg("total_time_ms"), F.lit(0.0)).alias("avg_latency_ms"))
    fractions = {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95, "p99_latency_ms": 0.99}
    ranked = order_statistics(timed, [], "total_time_ms", list(fractions.values()))
    ranks = ranked.agg(
        *[
            F.coalesce(F.max(F.when(F.col("p") == p, F.col("total_time_ms"))), F.lit(0.0)).alias(name)
            for name, p in fractions.items()
        ]
    )
    parts = union(totals, mean, ranks, allow_missing=True)
    return parts.agg(*[F.max(c).alias(c) for c in parts.columns])


def counts_by(df: DataFrame, *keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def queries_by_role_and_hour(metrics: DataFrame) -> DataFrame:
    """Both breakdowns from one pass over the log."""
    return (
        metrics.groupingSets(
            [[F.col("user_role")], [F.col("hour_key")]], F.col("user_role"), F.col("hour_key")
        )
        .agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
        .select(
            F.when(F.col("g") == 1, "role").otherwise("hour").alias("kind"),
            F.when(F.col("g") == 1, F.col("user_role")).otherwise(F.col("hour_key")).alias("key"),
            "n",
        )
    )


def guardrail_metrics(violations: DataFrame, retention=None, ts="recorded_at",
                      order_id="violation_id") -> DataFrame:
    """Counts by severity and by type over the log, and the totals, as (kind, key, n).

    With ``retention`` only that many of the newest violations are looked at."""
    kept = retain_last_n(violations, retention, ts, order_id).select(
        F.coalesce("severity", F.lit("UNKNOWN")).alias("severity"),
        F.coalesce("violation_type", F.lit("UNKNOWN")).alias("violation_type"),
    )
    sets = [[F.col("severity")], [F.col("violation_type")], []]
    return (
        kept.groupingSets(sets, F.col("severity"), F.col("violation_type"))
        .agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
        .select(
            F.when(F.col("g") == 1, "severity").when(F.col("g") == 2, "type").otherwise("total").alias("kind"),
            F.when(F.col("g") == 1, F.col("severity"))
            .when(F.col("g") == 2, F.col("violation_type"))
            .otherwise("all")
            .alias("key"),
            "n",
        )
    )


def security_metrics(alerts: DataFrame) -> DataFrame:
    def level(name):
        return F.count_if(F.col("severity") == name).alias(f"{name.lower()}_alerts")

    return alerts.agg(
        F.count("*").alias("total_alerts"),
        level(C.CRITICAL), level(C.HIGH), level(C.MEDIUM), level(C.LOW),
    )


def compliance_report(audit: DataFrame, now, days=30, framework="general", retention=None,
                      order_id="request_id") -> DataFrame:
    """Access attempts and queries of the last ``days`` before ``now`` (cut-off inclusive).

    The status says whether a denied access happened in the period. With ``retention`` only that
    many of the newest events are looked at, as a bounded in-memory log would."""
    if retention is not None:
        newest = [F.col(c).desc() for c in ("timestamp", order_id, "event_type")]
        audit = audit.orderBy(*newest).limit(retention)
    recent = audit.filter(F.col("timestamp") >= now - F.expr(f"interval {int(days)} days"))
    access = F.col("event_type") == "access_control"
    denied = F.count_if(access & (F.col("decision") == "denied"))
    return recent.agg(
        F.lit(framework.upper()).alias("framework"),
        F.lit(f"Last {days} days").alias("period"),
        F.count_if(access).alias("total_access_attempts"),
        F.count_if(access & (F.col("decision") == "granted")).alias("access_granted"),
        denied.alias("access_denied"),
        F.count_if(F.col("event_type") == "query").alias("total_queries"),
        F.when(denied == 0, "COMPLIANT").otherwise("DENIALS_RECORDED").alias("status"),
    )


def audit_counters(audit: DataFrame) -> DataFrame:
    access = F.col("event_type") == "access_control"
    return audit.agg(
        F.count("*").alias("total_events"),
        F.count_if(access & (F.col("decision") == "granted")).alias("access_granted"),
        F.count_if(access & (F.col("decision") == "denied")).alias("access_denied"),
        F.count_if(F.col("event_type") == "query").alias("total_queries"),
    )


def audit_events(requests: DataFrame, *ids) -> DataFrame:
    """Audit rows of both kinds from requests with an ``allowed`` flag."""
    common = [
        *ids,
        F.col("ts").alias("timestamp"),
        F.col("username").alias("user"),
        F.col("role").alias("user_role"),
        "domain",
    ]
    access = requests.select(
        F.lit("access_control").alias("event_type"),
        *common,
        F.when(F.col("allowed"), "granted").otherwise("denied").alias("decision"),
        "document_id",
        "reason",
    )
    queries = requests.filter("allowed").select(
        F.lit("query").alias("event_type"),
        *common,
        "query",
        "documents_retrieved",
        "documents_validated",
    )
    return union(access, queries, allow_missing=True)


def latency_histogram(df: DataFrame, keys, seconds: str, bounds=None) -> DataFrame:
    """Cumulative buckets per key, with sum and count, as (keys, le, n, total, observations)."""
    bounds = bounds or C.LATENCY_BUCKETS
    wide = df.groupBy(*keys).agg(
        *[F.count_if(F.col(seconds) <= b).alias(f"b{i}") for i, b in enumerate(bounds)],
        F.count(seconds).alias("observations"),
        F.sum(seconds).alias("total"),
    )
    pairs = [
        F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)
    ]
    pairs.append(F.struct(F.lit("+Inf").alias("le"), F.col("observations").alias("n")))
    return wide.select(*keys, "total", "observations", F.inline(F.array(*pairs)))


def action_summary(actions: DataFrame) -> DataFrame:
    """Per agent: actions, successes, failures and the summary line."""
    failed = F.col("actions") - F.col("successful")
    return (
        actions.groupBy("agent_role")
        .agg(F.count("*").alias("actions"), F.count_if("success").alias("successful"))
        .select(
            "agent_role",
            "actions",
            "successful",
            failed.alias("failed"),
            F.format_string(
                "%s: %d actions (%d successful, %d failed)", "agent_role", "actions", "successful", failed
            ).alias("summary"),
        )
    )


def agent_metrics(actions: DataFrame) -> DataFrame:
    return actions.agg(
        F.count("*").alias("total_actions"),
        F.lit(len(C.AGENTS)).cast("long").alias("agent_count"),
        F.count_if(F.col("agent_role") == "orchestrator").alias("orchestrator_tasks"),
    )


def retriever_stats(corpus: DataFrame) -> DataFrame:
    domains = F.array_sort(F.collect_set(F.coalesce("domain", F.lit("unknown"))))
    return corpus.agg(
        F.count("*").alias("total_documents"), F.array_join(domains, ",").alias("domains")
    )


def index_stats(vectors: DataFrame) -> DataFrame:
    """Vectors and dimension per namespace, and over all of them (``is_total``)."""
    return (
        vectors.rollup("namespace")
        .agg(
            F.grouping("namespace").cast("boolean").alias("is_total"),
            F.count("*").alias("vectors"),
            F.max(F.size("embedding")).cast("long").alias("dimension"),
        )
        .select("is_total", "namespace", "vectors", "dimension")
    )


def indexing_stats(batches: DataFrame) -> DataFrame:
    """Totals of a load, from one row per batch with ``documents``, ``failed``, ``seconds``."""
    indexed = F.sum(F.when(F.col("failed"), 0).otherwise(F.col("documents")))
    duration = F.sum("seconds")
    return batches.agg(
        F.sum("documents").alias("total_documents"),
        indexed.alias("successfully_indexed"),
        F.sum(F.when(F.col("failed"), F.col("documents")).otherwise(0)).alias("failed"),
        F.round(duration, 2).alias("duration_seconds"),
        F.when(duration > 0, F.round(indexed / duration, 2)).otherwise(0.0).alias("docs_per_second"),
    )


def session_state(df: DataFrame, session="session_id", domain="domain", role="department_role",
                  ts="ts", order_id="request_id") -> DataFrame:
    """Latest role per session and domain, and whether the domain is the session's last one."""
    latest = df.groupBy(session, domain).agg(
        F.max(F.struct(F.col(ts).alias("t"), F.col(order_id).alias("i"), F.col(role).alias("r"))).alias("m")
    )
    last = F.max("m").over(Window.partitionBy(session))  # at most one row per domain
    return latest.select(
        session, domain, F.col("m.r").alias(role), (F.col("m") == last).alias("is_last_domain")
    )


def cache_hits(accesses: DataFrame, key="fingerprint", micros="micros",
               ttl_seconds=C.CACHE_TTL_SECONDS) -> DataFrame:
    """Per key: accesses, hits and misses of a cache whose entries live ``ttl`` after the last touch.

    Two accesses in the same ttl-wide slice are never further apart than the ttl, so each slice
    adds at most one miss: only (first, last, count) per slice is shuffled, never the accesses."""
    ttl = ttl_seconds * 1_000_000
    slices = (
        accesses.withColumn("slice", F.floor(F.col(micros) / ttl))
        .groupBy(key, "slice")
        .agg(F.min(micros).alias("first"), F.max(micros).alias("last"), F.count("*").alias("n"))
    )
    previous = F.lag("last").over(Window.partitionBy(key).orderBy("slice"))
    missed = previous.isNull() | (F.col("first") - previous > ttl)
    return (
        slices.withColumn("miss", missed.cast("long"))
        .groupBy(key)
        .agg(F.sum("n").alias("accesses"), F.sum("miss").alias("misses"))
        .select(key, "accesses", (F.col("accesses") - F.col("misses")).alias("hits"), "misses")
    )


def cache_stats(per_key: DataFrame) -> DataFrame:
    hits, total = F.sum("hits"), F.sum("accesses")
    return per_key.agg(
        F.coalesce(hits, F.lit(0)).alias("hits"),
        F.coalesce(F.sum("misses"), F.lit(0)).alias("misses"),
        F.coalesce(F.round(F.try_divide(hits * 100.0, total), 2), F.lit(0.0)).alias("hit_rate_percent"),
    )


def dashboard_rows(violations: DataFrame, n=20, ts="recorded_at", order_id="violation_id") -> DataFrame:
    """The newest violations as display rows."""
    from custodia.functions.text import preview, type_label

    query = F.coalesce("query", "user_message", F.lit("N/A"))
    return recent_n(violations, n, ts, order_id).select(
        order_id,
        type_label("violation_type").alias("type_label"),
        F.coalesce("severity", F.lit("LOW")).alias("severity"),
        F.coalesce("username", "user", F.lit("Unknown")).alias("username"),
        F.coalesce("session_id", F.lit("N/A")).alias("session_id"),
        preview(query, 50).alias("query"),
        F.coalesce("description", F.lit("No description")).alias("description"),
        F.col(ts).alias("shown_at"),
    )


def bar_widths(violations: DataFrame, by: str) -> DataFrame:
    """Count per value, and its width relative to the largest count in percent."""
    per = violations.groupBy(F.coalesce(by, F.lit("UNKNOWN")).alias(by)).agg(F.count("*").alias("n"))
    largest = F.max("n").over(Window.partitionBy())  # a handful of kinds
    return per.select(by, "n", F.round(F.col("n") / largest * 100, 6).alias("width"))

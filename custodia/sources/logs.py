"""Violation, alert, interaction and metric logs as append-only tables, and text audit logs."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custodia import constants as C
from custodia.functions.text import named
from custodia.operators import analytics
from custodia.operators.alerts import ALERT_SCHEMA

# explicit, because inference drops empty maps and guesses timestamps
VIOLATION_SCHEMA = (
    "violation_type string, severity string, description string, timestamp timestamp, "
    "additional_data map<string,string>, user string, username string, session_id string, "
    "recorded_at timestamp, query string, user_message string"
)


def scan_violations(spark: SparkSession, path: str, retention=None, array_files=True) -> DataFrame:
    """The violations of a JSON log, or the newest ``retention`` of them."""
    log = spark.read.schema(VIOLATION_SCHEMA).option("multiLine", str(array_files).lower()).json(path)
    return analytics.retain_last_n(log, retention, "recorded_at", "description")


def scan_alerts(spark: SparkSession, path: str, retention=None, array_files=True) -> DataFrame:
    log = spark.read.schema(ALERT_SCHEMA).option("multiLine", str(array_files).lower()).json(path)
    return analytics.retain_last_n(log, retention, "timestamp", "message")


def stream_log(spark: SparkSession, path: str, schema, file_format="parquet", **options) -> DataFrame:
    """Log files as a stream: each file is read once, when it appears."""
    return spark.readStream.schema(schema).format(file_format).options(**options).load(path)


def export_interactions(interactions: DataFrame, path: str) -> None:
    interactions.write.mode("overwrite").json(path)


def export_metrics(metrics: DataFrame, events: DataFrame, path: str, recent=100) -> None:
    """System metrics, the last queries and the event summary, one JSON folder each.

    Uptime is the span of the log."""
    span = F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))
    uptime = metrics.agg((span / 1e6).alias("uptime_seconds"))
    parts = {
        "system_metrics": analytics.system_metrics(metrics),
        "recent_queries": analytics.recent_n(metrics, recent, "ts", "query_id"),
        "security_events": analytics.counts_by(events, "event_type"),
        "uptime": uptime,
    }
    for name, frame in parts.items():
        frame.write.mode("overwrite").json(f"{path}/{name}")


def append_log(rows: DataFrame, path: str, ts="recorded_at") -> None:
    """Append to a log partitioned by day; earlier files are never rewritten."""
    rows.withColumn("log_date", F.to_date(ts)).write.mode("append").partitionBy("log_date").parquet(path)


# --- text audit lines --------------------------------------------------------------------


def access_line(user, role, domain, granted):
    status = F.when(granted, "GRANTED").otherwise("DENIED")
    return F.concat(
        F.lit("ACCESS "), status, F.lit(" | User: "), named(user), F.lit(" | Role: "), named(role),
        F.lit(" | Domain: "), named(domain),
    )


def pii_line(doc_id, kinds):
    return F.concat(F.lit("PII DETECTED | Doc: "), named(doc_id), F.lit(" | Types: "), F.array_join(kinds, ", "))


def query_line(user, query, documents, seconds):
    # a line must stay one line
    shown = F.regexp_replace(F.substring(query, 1, 50), r"[\r\n]", " ")
    return F.concat(
        F.lit("QUERY | User: "), named(user), F.lit(" | Query: "), named(shown), F.lit("... | Docs: "),
        named(documents), F.lit(" | Duration: "),
        # half-even, as the log writer formats
        named(F.call_function("format_number", seconds, F.lit("0.00"))), F.lit("s"),
    )


def log_file_line(ts, message, logger="audit", level="INFO"):
    return F.concat(
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(f" - {logger} - {level} - "), message
    )


def write_text_log(lines: DataFrame, path: str, column="line") -> None:
    lines.select(column).write.mode("append").text(path)


_HEAD = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) - (.*?) - (\w+) - "
_KINDS = {
    "access": _HEAD + r"ACCESS (GRANTED|DENIED) \| User: (.*) \| Role: (.*) \| Domain: (.*)$",
    "pii": _HEAD + r"PII DETECTED \| Doc: (.*) \| Types: (.*)$",
    "query": _HEAD + r"QUERY \| User: (.*?) \| Query: (.*)\.\.\. \| Docs: (\d+) \| Duration: ([\d.]+)s$",
}


def parse_audit_log(lines: DataFrame, column="value") -> DataFrame:
    """The fields of each audit line; lines of no known kind are kept with kind ``other``."""
    line = F.col(column)
    kind = F.lit("other")
    for name, pattern in _KINDS.items():
        kind = F.when(line.rlike(pattern), name).otherwise(kind)

    def part(of, group):
        return F.when(F.col("kind") == of, F.regexp_extract(line, _KINDS[of], group))

    return lines.withColumn("kind", kind).select(
        "kind",
        F.try_to_timestamp(F.regexp_extract(line, _HEAD, 1)).alias("logged_at"),
        F.coalesce(part("access", 5), part("query", 4)).alias("user"),
        part("access", 4).alias("status"),
        part("access", 6).alias("role"),
        part("access", 7).alias("domain"),
        part("pii", 4).alias("doc_id"),
        part("pii", 5).alias("pii_types"),
        part("query", 5).alias("query"),
        part("query", 6).cast("long").alias("documents"),
        part("query", 7).cast("double").alias("duration_seconds"),
        F.when(F.col("kind") == "other", line).alias("other"),
    )


def read_audit_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_audit_log(spark.read.text(path))

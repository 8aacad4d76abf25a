"""Security alerts from violations and access denials."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custodia import constants as C
from custodia.functions.text import cut, named
from custodia.operators.trailing import trailing_counts
from custodia.session import union

ALERT_SCHEMA = (
    "alert_type string, type string, timestamp timestamp, user string, session_id string, "
    "message string, description string, severity string, domain string, role string, "
    "query string, denial_count long, violation_type string"
)


def violation_to_alert(violations: DataFrame) -> DataFrame:
    """CRITICAL and HIGH violations raise an alert."""
    text = F.coalesce("description", F.lit("Security violation detected"))
    return violations.filter(F.col("severity").isin(C.CRITICAL, C.HIGH)).select(
        F.concat(
            F.lit("guardrail_"), F.lower(F.coalesce("violation_type", F.lit("VIOLATION")))
        ).alias("alert_type"),
        F.coalesce("violation_type", F.lit("GUARDRAIL_VIOLATION")).alias("type"),
        F.col("recorded_at").alias("timestamp"),
        "user",
        "session_id",
        F.concat(F.lit("Guardrail violation: "), text).alias("message"),
        text.alias("description"),
        "severity",
        cut("query").alias("query"),
        "violation_type",
    )


def denial_to_alert(denials: DataFrame, user="username", reason="reason", query="query") -> DataFrame:
    """Every denial raises a MEDIUM alert."""
    role, domain = named("role"), named("domain")
    default = F.concat(
        F.lit("Access denied for role '"), role, F.lit("' to domain '"), domain, F.lit("'")
    )
    text = F.col(query)
    return denials.select(
        F.lit("access_denied").alias("alert_type"),
        F.lit("ACCESS_DENIED").alias("type"),
        F.col("ts").alias("timestamp"),
        F.col(user).alias("user"),
        "session_id",
        F.concat(
            F.lit("Access denied: Role '"), role, F.lit("' attempted to access '"), domain,
            F.lit("' domain"),
        ).alias("message"),
        F.coalesce(F.when(F.col(reason) != "", F.col(reason)), default).alias("description"),
        F.lit(C.MEDIUM).alias("severity"),
        "domain",
        "role",
        F.when(text != "", cut(text)).alias("query"),
    )


def excessive_denials(denials: DataFrame, limit=C.MAX_DENIALS_PER_HOUR, user="username",
                      order_id="request_id", micros="micros", seconds=3600) -> DataFrame:
    """A HIGH alert for each denial that is at least the ``limit``-th of its user's last hour."""
    counted = trailing_counts(denials, [user], micros, order_id, seconds, "n_recent")
    return excessive_alerts(counted, limit, user)


def excessive_alerts(counted: DataFrame, limit=C.MAX_DENIALS_PER_HOUR, user="username") -> DataFrame:
    """The alerts of denials that already carry their ``n_recent`` count."""
    number = F.col("n_recent").cast("string")
    return counted.filter(F.col("n_recent") >= limit).select(
        F.lit("excessive_denials").alias("alert_type"),
        F.lit("EXCESSIVE_DENIALS").alias("type"),
        F.col("ts").alias("timestamp"),
        F.col(user).alias("user"),
        "session_id",
        F.concat(
            F.lit("Excessive access denials detected: "), number, F.lit(" denials in last hour")
        ).alias("message"),
        F.concat(number, F.lit(" denials in last hour for user "), named(user)).alias("description"),
        F.lit(C.HIGH).alias("severity"),
        F.col("n_recent").alias("denial_count"),
    )


def create_alert(df: DataFrame, alert_type, message, severity=C.MEDIUM, user=None, session_id=None,
                 timestamp="ts", **extra) -> DataFrame:
    """A generic alert per row; extra fields become columns."""
    null = F.lit(None).cast("string")
    return df.select(
        F.lit(alert_type).alias("alert_type"),
        F.lit(alert_type).alias("type"),
        F.col(timestamp).alias("timestamp"),
        (F.col(user) if user else F.lit("system")).alias("user"),
        (F.col(session_id) if session_id else null).alias("session_id"),
        message.alias("message"),
        message.alias("description"),
        F.lit(severity).alias("severity"),
        *[value.alias(name) for name, value in extra.items()],
    )


def union_alerts(*alerts: DataFrame) -> DataFrame:
    """Alerts of all kinds in one table; columns a kind lacks are null."""
    return union(*alerts, allow_missing=True)


def filter_alerts(alerts: DataFrame, severity=None) -> DataFrame:
    return alerts.filter(F.col("severity") == severity) if severity else alerts

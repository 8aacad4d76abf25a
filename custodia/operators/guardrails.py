"""Rate limits, moderation and output gates, and the violation records they leave."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custodia import constants as C
from custodia.functions import entities as E
from custodia.operators.trailing import trailing_counts
from custodia.session import materialize


def rate_limit_global(requests: DataFrame, limit=C.MAX_REQUESTS_PER_MINUTE, order_id="request_id",
                      micros="micros", seconds=60) -> DataFrame:
    """Add ``n_global`` and ``blocked_global``; blocked requests count too."""
    counted = trailing_counts(requests, [], micros, order_id, seconds, "n_global")
    return counted.withColumn("blocked_global", F.coalesce(F.col("n_global") > limit, F.lit(False)))


def rate_limit_user(requests: DataFrame, limit=C.MAX_REQUESTS_PER_USER_HOUR, user="username",
                    order_id="request_id", micros="micros", seconds=3600, recorded=None) -> DataFrame:
    """Add ``n_user`` and ``blocked_user``. With ``recorded``, a condition, the other requests
    are not counted and get null."""
    counted = trailing_counts(requests, [user], micros, order_id, seconds, "n_user", recorded)
    if recorded is not None:
        counted = counted.withColumn("n_user", F.when(recorded, F.col("n_user")))
    return counted.withColumn("blocked_user", F.col("n_user") > limit)


def rate_limits(requests: DataFrame, per_minute=C.MAX_REQUESTS_PER_MINUTE,
                per_user_hour=C.MAX_REQUESTS_PER_USER_HOUR, user="username",
                order_id="request_id", micros="micros") -> DataFrame:
    """Both limits in order: a globally blocked request is not recorded for its user.

    Rows that share an id stay apart. A request without a time counts nowhere and passes."""
    globally = materialize(rate_limit_global(requests, per_minute, order_id, micros), "rate-limits")
    return rate_limit_user(globally, per_user_hour, user, order_id, micros, recorded=~F.col("blocked_global"))


def rate_violation_columns() -> dict:
    """Type, severity and text of a rate violation, null where the request passed."""
    blocked_global = F.col("blocked_global")
    blocked_user = F.coalesce("blocked_user", F.lit(False))
    return {
        "violation_type": F.when(blocked_global | blocked_user, C.RATE_LIMIT_EXCEEDED),
        "severity": F.when(blocked_global, C.HIGH).when(blocked_user, C.MEDIUM),
        "description": F.when(
            blocked_global,
            F.concat(F.lit("Global rate limit exceeded: "), F.col("n_global").cast("string"),
                     F.lit(" requests per minute")),
        ).when(
            blocked_user,
            F.concat(F.lit("User rate limit exceeded: "), F.col("n_user").cast("string"),
                     F.lit(" requests per hour")),
        ),
    }


def moderation_gate(texts: DataFrame, verdicts: DataFrame, key: str, verdict_key: str,
                    toxic="toxic") -> DataFrame:
    """Add ``unsafe``; a text without a verdict passes. Verdicts come as a table, so a model
    runs once over the texts and not once per request."""
    unsafe = verdicts.filter(F.col(toxic) == 1).select(F.col(verdict_key).alias("_key")).distinct()
    return texts.join(unsafe, F.col(key) == F.col("_key"), "left").select(
        *texts.columns, F.col("_key").isNotNull().alias("unsafe")
    )


def input_gate(requests: DataFrame, verdicts: DataFrame, key: str, verdict_key: str,
               per_minute=C.MAX_REQUESTS_PER_MINUTE,
               per_user_hour=C.MAX_REQUESTS_PER_USER_HOUR, **names) -> DataFrame:
    """Rate limits, then moderation: the first failure is the violation."""
    limited = rate_limits(requests, per_minute, per_user_hour, **names)
    judged = moderation_gate(limited, verdicts, key, verdict_key).withColumns(
        rate_violation_columns()
    )
    toxic = F.col("violation_type").isNull() & F.col("unsafe")
    return judged.withColumns(
        {
            "violation_type": F.when(toxic, C.TOXIC_CONTENT).otherwise(F.col("violation_type")),
            "severity": F.when(toxic, C.HIGH).otherwise(F.col("severity")),
            "description": F.when(toxic, C.TOXIC_DESCRIPTION).otherwise(F.col("description")),
        }
    ).withColumn("is_safe", F.col("violation_type").isNull())


def pii_output_gate(responses: DataFrame, text="response", role="role", recognizer=None) -> DataFrame:
    """Entities found in responses of roles that may not see them.

    ``entities`` keeps one item per finding, ``entity_kinds`` the distinct kinds, sorted."""
    # a missing role is no exempt role
    checked = ~F.coalesce(F.col(role).isin("admin", "analyst"), F.lit(False))
    found = E.detect_entities(F.when(checked, F.col(text)), recognizer)
    return (
        responses.withColumn("_found", found)
        .withColumn("entities", F.transform("_found", lambda e: e["entity"]))
        .withColumn("entity_kinds", F.array_sort(F.array_distinct("entities")))
        .withColumn("entity_count", F.coalesce(F.size("_found"), F.lit(0)).cast("long"))
        .withColumn("entity_count", F.greatest("entity_count", F.lit(0)).cast("long"))
        .withColumn("blocked_pii", F.col("entity_count") > 0)
        .drop("_found")
    )


def output_gate(responses: DataFrame, verdicts: DataFrame, key: str, verdict_key: str,
                text="response", role="role", recognizer=None) -> DataFrame:
    """Personal data first, then moderation."""
    gated = pii_output_gate(
        moderation_gate(responses, verdicts, key, verdict_key), text, role, recognizer
    )
    pii, unsafe = F.col("blocked_pii"), F.col("unsafe")
    return gated.withColumns(
        {
            "violation_type": F.when(pii, C.PII_DETECTED).when(unsafe, C.TOXIC_CONTENT),
            "severity": F.when(pii, C.CRITICAL).when(unsafe, C.HIGH),
            "description": F.when(
                pii, F.concat(F.lit("PII detected: "), F.array_join("entity_kinds", ", "))
            ).when(unsafe, C.TOXIC_DESCRIPTION),
            "is_safe": ~(pii | unsafe),
        }
    )


def safety_message(what="Query"):
    return F.when(F.col("is_safe"), F.lit(f"{what} is safe")).otherwise(
        F.concat(F.lit("Validation failed: "), F.col("description"))
    )


def violation_record(df: DataFrame, user="username", session="session_id", query=None,
                     recorded_at="ts", data=None) -> DataFrame:
    """The stored shape of a violation, with the alias columns readers use."""
    text = F.col(query) if query else F.lit(None).cast("string")
    text = F.when(text != "", text)
    extra = data if data is not None else F.create_map().cast("map<string,string>")
    return df.select(
        "violation_type", "severity", "description",
        F.col(recorded_at).alias("timestamp"),
        extra.alias("additional_data"),
        F.col(user).cast("string").alias("user"),
        F.col(user).cast("string").alias("username"),
        F.col(session).cast("string").alias("session_id"),
        F.col(recorded_at).alias("recorded_at"),
        text.alias("query"),
        text.alias("user_message"),
    )


def filter_violations(violations: DataFrame, severity=None, violation_type=None) -> DataFrame:
    out = violations
    if severity:
        out = out.filter(F.col("severity") == severity)
    if violation_type:
        out = out.filter(F.col("violation_type") == violation_type)
    return out

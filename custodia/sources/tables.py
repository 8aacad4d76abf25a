"""The shared tables as the library's inputs: corpus, requests, questions, vectors, logs.

Each view is declared twice: as a DataFrame here and as a SQL text in ``plans.sql_views``."""

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from custodia import constants as C
from custodia.functions.once import filter_computed
from custodia.operators import access, guardrails
from custodia.session import union

DOMAINS = ["finance", "hr", "health", "legal", "public"]
CLASSIFICATIONS = ["confidential", "internal", "confidential", "confidential", "public"]
DEPARTMENTS = list(C.DEPARTMENT_ROLES)
DEPARTMENT_ROLE_NAMES = ["manager", "Employee", "general", "analyst", "doctor", "paralegal", "visitor"]
REQUESTED_ROLES = [*C.ROLES, "contractor"]
REQUESTED_FRAMEWORKS = [*C.FRAMEWORK_DOMAINS, "pci"]


def pick(values, number: Column) -> Column:
    """The value at ``number`` modulo the list length."""
    return F.array(*map(F.lit, values))[F.pmod(number, F.lit(len(values))).cast("int")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def corpus(spark, sf_dir) -> DataFrame:
    n = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        n.alias("id"),
        F.concat(F.lit("Document "), n.cast("string")).alias("title"),
        F.col("text").alias("content"),
        pick(DOMAINS, n).alias("domain"),
        pick(CLASSIFICATIONS, n).alias("classification"),
        F.col("source").alias("author"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(n, F.lit(365)).cast("int")).alias("date"),
    )


def requests(spark, sf_dir) -> DataFrame:
    return requests_of(table(spark, sf_dir, "events"))


def requests_of(events: DataFrame) -> DataFrame:
    """A request log from events, batch or streaming."""
    event, user = F.col("event_id"), F.coalesce("user_id", F.lit(-1))
    return events.select(
        event.alias("request_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"),
        user.alias("user_id"),
        F.concat(F.lit("user_"), user.cast("string")).alias("username"),
        F.concat(F.lit("s"), user.cast("string")).alias("session_id"),
        pick(C.ROLES, user).alias("role"),
        pick(DOMAINS, event).alias("domain"),
        pick(DEPARTMENTS, event).alias("department"),
        pick(DEPARTMENT_ROLE_NAMES, user).alias("department_role"),
        "event_type",
        F.col("props").alias("query"),
        F.col("value").alias("latency_ms"),
        (F.col("event_type") != "error").alias("success"),
    )


def denials(spark, sf_dir) -> DataFrame:
    refused = access.access_denied(requests(spark, sf_dir))
    return refused.withColumn(
        "reason", F.when(F.col("event_type") == "click", F.lit("policy")).otherwise(F.lit(None).cast("string"))
    )


def query_metrics(spark, sf_dir) -> DataFrame:
    base = requests(spark, sf_dir)
    seconds = F.col("latency_ms") / 1000
    return base.select(
        F.col("request_id").alias("query_id"),
        "ts", "query", "success",
        F.col("username").alias("user"),
        F.col("role").alias("user_role"),
        seconds.alias("retrieval_time"),
        (seconds / 4).alias("validation_time"),
        (seconds * 2).alias("generation_time"),
        F.lit(5).cast("long").alias("documents_retrieved"),
        (F.lit(5) - F.pmod("user_id", F.lit(3))).cast("long").alias("documents_validated"),
        F.pmod("user_id", F.lit(3)).cast("long").alias("documents_denied"),
    )


def questions(spark, sf_dir) -> DataFrame:
    """Every user turn as a question, with its asker."""
    conv = F.col("conv_id")
    return (
        table(spark, sf_dir, "conversations")
        .filter(F.col("role") == "user")
        .select(
            (conv * 100 + F.col("turn")).alias("query_id"),
            conv.alias("conv_id"),
            F.col("text").alias("query"),
            F.concat(F.lit("user_"), conv.cast("string")).alias("username"),
            F.concat(F.lit("s"), conv.cast("string")).alias("session_id"),
            pick(C.ROLES, conv).alias("role"),
            pick(DOMAINS, conv + F.col("turn")).alias("domain"),
            pick(DEPARTMENT_ROLE_NAMES, conv).alias("department_role"),
            pick(REQUESTED_FRAMEWORKS, conv).alias("framework"),
        )
        .withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("query_id") * 10))
        .withColumn("micros", F.unix_micros("ts"))
    )


def vectors(spark, sf_dir) -> DataFrame:
    docs = corpus(spark, sf_dir).select("id", "title", "domain", "classification", "author", "date")
    return (
        table(spark, sf_dir, "embeddings")
        .select(
            F.col("vec_id").alias("id"),
            "embedding",
            F.concat(F.lit("ns"), (F.col("label") % 2).cast("string")).alias("namespace"),
        )
        .join(docs, "id")
    )


def question_vectors(spark, sf_dir) -> DataFrame:
    """The questions with a precomputed vector each, looked up by id."""
    stored = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("_vec"), "embedding")
    total = stored.count()
    asked = questions(spark, sf_dir).withColumn("_vec", F.col("query_id") % F.lit(total))
    return asked.join(stored, "_vec").drop("_vec")


def verdicts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("verdict_id"), "toxic")


PER_MINUTE, PER_USER_HOUR, DENIALS_PER_HOUR = 2, 1, 2


def violations(spark, sf_dir) -> DataFrame:
    """Rate violations of the request log, and toxic or personal-data documents."""
    limited = guardrails.rate_limits(requests(spark, sf_dir), PER_MINUTE, PER_USER_HOUR)
    rate = limited.withColumns(guardrails.rate_violation_columns()).filter(
        F.col("violation_type").isNotNull()
    )
    rate = rate.select(
        F.concat(F.lit("r"), F.col("request_id").cast("string")).alias("violation_id"),
        "violation_type", "severity", "description", "username", "session_id", "query", "ts",
    )
    docs = corpus(spark, sf_dir).select("id", F.col("content").alias("response"), F.col("author").alias("username"))
    judged = guardrails.output_gate(
        docs.withColumn("role", F.lit("guest")), verdicts(spark, sf_dir), "id", "verdict_id"
    )
    judged = filter_computed(judged, ~F.col("is_safe"))
    text = judged.select(
        F.concat(F.lit("d"), F.col("id").cast("string")).alias("violation_id"),
        "violation_type", "severity", "description", "username",
        F.lit(None).cast("string").alias("session_id"),
        F.lit(None).cast("string").alias("query"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 60).alias("ts"),
    )
    both = union(rate, text)
    return both.select(
        "violation_id", "violation_type", "severity", "description",
        F.col("ts").alias("recorded_at"),
        F.col("username").alias("user"), "username", "session_id", "query",
        F.col("query").alias("user_message"),
    )

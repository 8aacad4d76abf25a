"""Streaming forms of the log and document operators.

Sinks are folders of parquet files. Windowed counts are written per micro-batch and the newest
row per window wins on read."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custodia import constants as C
from custodia.operators import access, alerts, analytics
from custodia.session import union

_NOW = {"availableNow": True}


def append_files(stream: DataFrame, out: str, work: str, **trigger):
    """Exactly-once append of a stream to parquet files."""
    return (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", f"{work}/checkpoint")
        .outputMode("append")
        .trigger(**(trigger or _NOW))
        .start()
    )


def upsert_files(stream: DataFrame, out: str, work: str, **trigger):
    """Changed aggregate rows of each micro-batch, below ``out/batch=<id>``."""

    def run(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(run)
        .option("checkpointLocation", f"{work}/checkpoint")
        .outputMode("update")
        .trigger(**(trigger or _NOW))
        .start()
    )


def newest_rows(spark: SparkSession, out: str, keys) -> DataFrame:
    """The latest version of each aggregate row written by ``upsert_files``."""
    rows = spark.read.parquet(out)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")


def violation_alerts(violations: DataFrame) -> DataFrame:
    return alerts.violation_to_alert(violations)


def dashboard_counts(log: DataFrame, by, ts="ts", width="1 hour", slide=None, late="10 minutes") -> DataFrame:
    """Counts per tumbling or sliding window and key."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return (
        log.withWatermark(ts, late)
        .groupBy(window.alias("w"), *by)
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n")
    )


def cache_sessions(accesses: DataFrame, key="fingerprint", ts="ts", ttl_seconds=C.CACHE_TTL_SECONDS,
                   late="10 minutes") -> DataFrame:
    """Runs of accesses no further apart than the ttl: all but the first of a run are hits."""
    # merge a key's accesses before the shuffle, so a hot key does not arrive row by row
    accesses.sparkSession.conf.set(
        "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true"
    )
    return (
        accesses.withWatermark(ts, late)
        .groupBy(F.session_window(ts, f"{ttl_seconds} seconds").alias("w"), key)
        .agg(F.count("*").alias("accesses"))
        .select(
            key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"),
            "accesses", (F.col("accesses") - 1).alias("hits"),
        )
    )


def open_sessions(spark: SparkSession, work: str, key="fingerprint") -> DataFrame:
    """The sessions that a stream of ``cache_sessions`` has not closed yet, read from its state as last committed."""
    held = spark.read.format("statestore").load(f"{work}/checkpoint")
    return held.select(
        F.col(f"value.{key}").alias(key), F.col("value.session_window.start").alias("session_start"),
        F.col("value.session_window.end").alias("session_end"), F.col("value.count").alias("accesses"),
        (F.col("value.count") - 1).alias("hits"),
    )


def with_open_sessions(closed: DataFrame, work: str, key="fingerprint") -> DataFrame:
    """What a stream has closed, and the sessions still open in its state; the input is not read again."""
    return union(closed, open_sessions(closed.sparkSession, work, key).select(*closed.columns))


def redaction(documents: DataFrame, terms=None) -> DataFrame:
    """Access filter, term flags and masking of arriving documents; needs a role per row."""
    return access.validate_documents(documents, terms=terms)


def deduplicated(log: DataFrame, key, ts="recorded_at", late="1 hour") -> DataFrame:
    """Each record once, even if its producer sends it again within the lateness bound."""
    return log.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def latency_histogram(requests: DataFrame, keys, seconds="seconds", ts="ts", width="1 hour",
                      late="10 minutes") -> DataFrame:
    """Cumulative latency buckets per window and key."""
    windowed = requests.withWatermark(ts, late).withColumn("w", F.window(ts, width))
    return analytics.latency_histogram(windowed, ["w", *keys], seconds).withColumn(
        "window_start", F.col("w.start")
    ).drop("w")

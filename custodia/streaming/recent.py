"""Live limits: each micro-batch is judged together with the recent past, kept as a table.

The batch operators do the counting, so a hot user or a burst is spread over tasks as there; no
user's state sits in one task. Every path is derived from the batch id, so a batch that is run
again overwrites its own output; state that no batch can ask for any more is removed."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custodia import constants as C
from custodia.operators import alerts, guardrails
from custodia.session import remove, scratch, union

_SECOND = 1_000_000


def judge_with_recent(stream: DataFrame, judge, out: str, work: str, keep_seconds: int,
                      micros="micros", **trigger):
    """Start a query that writes ``judge(recent and new rows)``, new rows only, to ``out``.

    ``judge`` must keep the column ``is_new``. ``keep_seconds`` is the past it needs."""

    def run(batch, batch_id):
        spark = batch.sparkSession
        known = batch.withColumn("is_new", F.lit(True))
        if batch_id > 0:
            past = spark.read.schema(batch.schema).parquet(f"{work}/recent/{batch_id - 1}")
            known = union(known, past.withColumn("is_new", F.lit(False)))
        with scratch(spark):
            # the batch feeds three jobs: write it once
            known.write.mode("overwrite").parquet(f"{work}/known/{batch_id}")
            known = spark.read.schema(known.schema).parquet(f"{work}/known/{batch_id}")
            judge(known).filter("is_new").drop("is_new").write.mode("overwrite").parquet(
                f"{out}/batch={batch_id}"
            )
            newest = known.agg(F.max(micros)).first()[0]
            oldest = 0 if newest is None else newest - keep_seconds * _SECOND
            known.filter(F.col(micros) > oldest).drop("is_new").write.mode("overwrite").parquet(
                f"{work}/recent/{batch_id}"
            )
        # a batch that is run again reads the past of the batch before it, and nothing older
        remove(spark, f"{work}/known/{batch_id}")
        if batch_id > 1:
            remove(spark, f"{work}/recent/{batch_id - 2}")

    return (
        stream.writeStream.foreachBatch(run)
        .option("checkpointLocation", f"{work}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_rate_limit(requests: DataFrame, out: str, work: str,
                      per_minute=C.MAX_REQUESTS_PER_MINUTE,
                      per_user_hour=C.MAX_REQUESTS_PER_USER_HOUR, lateness_seconds=600, **trigger):
    """Both rate limits on a request stream; late requests are judged at their own time."""
    # an hour of passed requests, and the minute that decided whether the first of them passed
    keep = 3600 + 60 + lateness_seconds
    return judge_with_recent(
        requests,
        lambda known: guardrails.rate_limits(known, per_minute, per_user_hour),
        out, work, keep, **trigger,
    )


def stream_excessive_denials(denials: DataFrame, out: str, work: str,
                             limit=C.MAX_DENIALS_PER_HOUR, lateness_seconds=600, **trigger):
    """An alert for every denial, and one more for each beyond the hourly limit."""

    def judge(known):
        new = known.filter("is_new")
        every = alerts.denial_to_alert(new)
        counted = guardrails.trailing_counts(
            known, ["username"], "micros", "request_id", 3600, "n_recent"
        ).filter("is_new")
        return alerts.union_alerts(
            every, alerts.excessive_alerts(counted, limit)
        ).withColumn("is_new", F.lit(True))

    return judge_with_recent(denials, judge, out, work, 3600 + lateness_seconds, **trigger)

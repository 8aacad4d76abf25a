"""Live limits: trailing counts of a stream with keyed state.

A key's time is cut into slices, some widths long, and a slice is dealt to some places. A row is remembered in
one place of its slice, by its hash, and asks all places of it, and of the slice before where its width reaches
back so far, how many rows of its key came before it within the width; the answers are summed per micro-batch.
So no place holds more than its share of a slice of a hot key, nor meets more rows than those of two slices at
once, however long the log of a micro-batch is. A micro-batch reads and writes the state of its own slices only,
and the rest stays in the state store. A place forgets rows that no row within the lateness can ask for, and
itself when the watermark has passed the last of them.

A late row is judged at its own time, by what is remembered then; the watermark only clears state, no row
is dropped for it.

``recent`` gives the same answers from a stored past; it is quicker where a whole log is replayed in few
large micro-batches, this one where small ones arrive all day."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from custodia import constants as C
from custodia.operators import alerts
from custodia.session import materialize, scratch

PLACES, SLICE_WIDTHS = 4, 120  # of a slice of a key that all rows share; the length of a slice
USER_PLACES, USER_SLICE_WIDTHS = 1, 720  # a place costs more than its rows, and most users have few
_SECOND = 1_000_000
_AHEAD_DAYS = 36_500  # the event time that Spark sees lies ahead, and its delay is longer by as much: no row is late
_SENT = ["t", "untied", "tie", "rid", "counted", "own", "row"]
_STAMP = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def _rows(stream, keys, micros, tie, counted, kind):
    known = F.col(tie).cast(kind)
    return stream.select(
        F.to_json(F.struct(*stream.columns), _STAMP).alias("row"),
        F.to_json(F.struct(F.lit(0), *[F.col(k) for k in keys])).alias("key"),
        F.col(micros).alias("t"), F.coalesce(known, F.lit(0 if kind == "long" else "")).alias("tie"), known.isNull().alias("untied"),
        (F.lit(True) if counted is None else F.coalesce(counted, F.lit(False))).alias("counted"),
    ).withColumn("rid", F.xxhash64("row"))


def _asked(rows, places, width, length, lateness_seconds):
    """One message per row, slice asked and place; the row itself travels to its own place only."""
    ahead = F.timestamp_micros("t") + F.make_dt_interval(F.lit(_AHEAD_DAYS))
    rows = rows.withColumn("seen", ahead).withWatermark("seen", f"{_AHEAD_DAYS * 86_400 + lateness_seconds} seconds")
    into = F.pmod("t", F.lit(length))
    here = F.col("t") - into
    asked = F.when(into < width - 1, F.array(here, here - length)).otherwise(F.array(here))
    sent = rows.withColumn("slice", F.explode(asked))
    sent = sent.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(places - 1))))
    own = (F.col("place") == F.pmod("rid", F.lit(places))) & (F.col("slice") == here)
    return sent.select(
        "key", "slice", "place", "t", "tie", "untied", "rid", "counted", "seen", own.alias("own"), F.when(own, F.col("row")).alias("row"))


def _ranked(t, untied, tie, rid):
    """The ranks of rows by time, tie (null first) and hash, equal rows sharing one; and the first row of each rank."""
    if tie.dtype == object:
        tie = np.unique(tie, return_inverse=True)[1]
    order = np.lexsort((rid, tie, ~untied, t))
    new = np.ones(len(t), bool)
    new[1:] = False
    for column in (t, untied, tie, rid):
        ordered = column[order]
        new[1:] |= ordered[1:] != ordered[:-1]
    ranks = np.empty(len(t), np.int64)
    ranks[order] = np.cumsum(new) - 1
    return ranks, order[new]


def _answers(width, keep, whole):
    """The function of a place: answers to a micro-batch's messages, and what is remembered afterwards."""
    kinds = np.int64, bool, np.int64 if whole else object, np.int64

    def run(key, parts, state):
        if state.hasTimedOut:
            state.remove()
            return
        parts = [[part[c].to_numpy() for c in _SENT] for part in parts]
        *sent, counted, own, row = (np.concatenate(c) for c in zip(*parts))
        held = [np.array(list(c), kind) for c, kind in zip(state.get, kinds)] if state.exists else [c[:0] for c in sent]
        placed = [np.concatenate(c).astype(kind) for c, kind in zip(zip(held, sent), kinds)]
        ranks, at = _ranked(*placed)
        times, known = placed[0][at], np.sort(ranks[: len(held[0])])
        asking, first, copies = np.unique(ranks[len(held[0]) :], return_index=True, return_counts=True)
        own, counted = own[first].astype(bool), counted[first].astype(bool)
        # copies of a row that came in an earlier micro-batch lie before it
        again = np.searchsorted(known, asking, "right") - np.searchsorted(known, asking)
        new = np.where(own & counted, copies, 0)
        known = np.sort(np.concatenate([known, np.repeat(asking, new)]))
        within = np.searchsorted(times[known], times[asking] - width + 1)
        before = np.searchsorted(known, asking) + again - within
        yield pd.DataFrame({
            "rid": placed[3][at[asking]], "before": before, "copies": np.where(own, copies, 0), "counted": counted,
            "row": pd.Series(np.where(own, row[first], None), dtype=object)})
        # what a row within the lateness may still ask for
        newest = times[max(known[-1:].max(initial=0), asking[-1])]
        known = known[np.searchsorted(times[known], newest - keep) :]
        if not len(known):
            if state.exists:
                state.remove()
            return
        state.update(tuple(c[at[known]].tolist() for c in placed))
        state.setTimeoutTimestamp(max(int(times[known[-1]] + keep) // 1000 + 1, state.getCurrentWatermarkMs() + 1))

    return run


def trailing_answers(stream: DataFrame, keys, width_seconds: int, lateness_seconds: int, micros="micros", tie="request_id",
                     counted=None, places=PLACES, slice_widths=SLICE_WIDTHS) -> DataFrame:
    """A stream of answers, to be summed by ``summed`` in each micro-batch."""
    kind = "long" if isinstance(stream.schema[tie].dataType, T.IntegralType) else "string"
    rows = _rows(stream, keys, micros, tie, counted, kind)
    width = width_seconds * _SECOND
    asked = _asked(rows.filter(F.col("t").isNotNull()), places, width, slice_widths * width, lateness_seconds)
    answers = asked.groupBy("key", "slice", "place").applyInPandasWithState(
        _answers(width, (width_seconds + lateness_seconds) * _SECOND, kind == "long"),
        "rid long, before long, copies long, counted boolean, row string",
        f"times array<long>, nulls array<boolean>, ties array<{kind}>, rids array<long>",
        "append", GroupStateTimeout.EventTimeTimeout,
    )
    untimed = rows.filter(F.col("t").isNull())
    return answers.unionByName(untimed.select(
        "rid", F.lit(None).cast("long").alias("before"), F.lit(1).cast("long").alias("copies"), F.lit(False).alias("counted"), "row"))


def summed(answers: DataFrame, schema: T.StructType, out="n_recent") -> DataFrame:
    """The rows of a micro-batch with their count: those before them, and themselves where they count; null
    without a time."""
    rows = answers.groupBy("rid").agg(
        F.sum("before").alias("before"), F.sum("copies").alias("copies"), F.max("row").alias("row"), F.max("counted").alias("counted"))
    each = rows.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    n = F.col("before") + F.when(F.col("counted"), F.col("copy")).otherwise(0)
    return each.select(F.from_json("row", schema, _STAMP).alias("r"), n.alias("_n")).select("r.*", F.col("_n").alias(out))


def _per_batch(stream, write, out, work, **trigger):
    """``write`` makes a table of each micro-batch, which appears whole at ``out/batch=<id>``, once."""

    def run(batch, batch_id):
        spark = batch.sparkSession
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        done, making = place(f"{out}/batch={batch_id}"), place(f"{out}/_making-{batch_id}")
        files = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if files.exists(done):  # the batch is run again, and its result was complete
            return
        with scratch(spark):
            write(batch).write.mode("overwrite").parquet(making.toString())
        files.rename(making, done)

    return (
        stream.writeStream.foreachBatch(run)
        .option("checkpointLocation", work)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


class Chain:
    """Queries of which each reads what the one before it writes."""

    def __init__(self, *starts, wait):
        self.running = []
        for start in starts:
            self.running.append(start())
            if wait:
                self.running[-1].awaitTermination()

    def awaitTermination(self):
        for query in self.running:
            query.awaitTermination()

    def stop(self):
        for query in self.running:
            query.stop()


def stream_rate_limit(requests: DataFrame, out: str, work: str, per_minute=C.MAX_REQUESTS_PER_MINUTE,
                      per_user_hour=C.MAX_REQUESTS_PER_USER_HOUR, lateness_seconds=600, places=PLACES, user_places=USER_PLACES, **trigger) -> Chain:
    """Both rate limits on a request stream: requests with n_global, blocked_global, n_user, blocked_user.

    Two queries: the first judges the global limit, the second reads its result and counts the requests that
    passed for their user. A request without a time counts nowhere and passes."""
    spark = requests.sparkSession
    judged = T.StructType(list(requests.schema.fields)).add("n_global", "long").add("blocked_global", "boolean")

    def first():
        answers = trailing_answers(requests, [], 60, lateness_seconds, places=places)

        def write(batch):
            counted = summed(batch, requests.schema, "n_global")
            return counted.withColumn("blocked_global", F.col("n_global") > per_minute)

        return _per_batch(answers, write, f"{work}/global", f"{work}/checkpoint-global", **trigger)

    def second():
        passed = spark.readStream.schema(judged).parquet(f"{work}/global").select(judged.names)
        recorded = ~F.col("blocked_global")
        answers = trailing_answers(passed, ["username"], 3600, lateness_seconds, counted=recorded, places=user_places, slice_widths=USER_SLICE_WIDTHS)

        def write(batch):
            counted = summed(batch, judged, "n_user").withColumn("n_user", F.when(recorded, F.col("n_user")))
            return counted.withColumn("blocked_user", F.col("n_user") > per_user_hour)

        return _per_batch(answers, write, out, f"{work}/checkpoint-user", **trigger)

    return Chain(first, second, wait=not trigger or "availableNow" in trigger)


def stream_excessive_denials(denials: DataFrame, out: str, work: str, limit=C.MAX_DENIALS_PER_HOUR,
                             lateness_seconds=600, places=USER_PLACES, **trigger):
    """An alert for every denial, and one more for each beyond the hourly limit."""
    schema = denials.schema
    answers = trailing_answers(denials, ["username"], 3600, lateness_seconds, places=places, slice_widths=USER_SLICE_WIDTHS)

    def write(batch):
        counted = materialize(summed(batch, schema), "denials")  # read twice, the stream once
        return alerts.union_alerts(alerts.denial_to_alert(counted), alerts.excessive_alerts(counted, limit))

    return _per_batch(answers, write, out, f"{work}/checkpoint", **trigger)

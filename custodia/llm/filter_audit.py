"""Filter interaction audit: what every filter removes in every order of application.

A document's failures are a set of filters, so all orders walk one lattice: a state is the set of
filters applied so far, an edge applies one more. Documents are counted once per (part, set of
failures); each edge's removals follow from these counts. Forward and backward path counts say how
many orders reach an edge's start and leave its end: their product weighs the edge's removals in the
Shapley sum, and each step of each order reads its figures from its edge.

All of it is built-in expressions. Texts never leave their task: a digest, the failures and the
document's id go on, one row per document, and the lattice sees one row per part and set."""

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custodia.llm.common import text_of
from custodia.llm.quality_rules import words_of
from custodia.rules import local_table
from custodia.session import materialize, union

DUPLICATE = "E"  # the filter that compares documents; the others look at one text


def text_failures(text: str, words: str) -> dict[str, Column]:
    """Failure conditions of the filters that look at one text."""
    t, w = F.col(text), F.col(words)
    return {
        "A": F.size(w) < 200,
        "B": 100 * F.size(F.array_distinct(w)).cast("long") < 50 * F.size(w).cast("long"),
        "C": 100 * F.regexp_count(t, F.lit("[A-Z]")).cast("long") > 2 * F.length(t).cast("long"),
        "D": t.rlike("[#$%&*|]"),
    }


def failure_counts(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", part_col="source") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the set of filters they fail, in bits of A to E.

    Null texts are empty, a null part is the empty string. A text is a duplicate where the same text
    has a smaller id anywhere; rows without an id are neither duplicates nor originals and have no
    label. Repeated rows count each; of repeated labels any 1 counts. Texts of any length are judged
    whole. Empty tables give no rows."""
    bit = {letter: 1 << i for i, letter in enumerate("ABCDE")}
    judged = docs.select(
        F.col(id_col).alias("_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        text_of(text_col).alias("_text"),
    ).withColumn("_words", words_of(F.col("_text")))
    failed = text_failures("_text", "_words")
    rows = judged.select(
        "_id", "part", F.unhex(F.sha2("_text", 256)).alias("_digest"),
        sum((F.when(c, bit[k]).otherwise(0) for k, c in failed.items()), F.lit(0)).alias("mask"),
    )
    # one pass over the texts; the row counts collapse repeated rows
    rows = materialize(rows.groupBy("_id", "part", "_digest", "mask").agg(F.count("*").alias("n")), "failures")
    known, unknown = rows.filter(F.col("_id").isNotNull()), rows.filter(F.col("_id").isNull())

    marks = (
        labels.select(F.col(id_col).alias("_label_id"), (F.col("quality") == 1).alias("g"), (F.col("toxic") == 1).alias("t"))
        .filter(F.col("_label_id").isNotNull())
        .groupBy("_label_id")
        .agg(F.max("g").alias("_good"), F.max("t").alias("_toxic"))
    )
    firsts = known.groupBy("_digest").agg(F.min("_id").alias("_first")).withColumnRenamed("_digest", "_same")
    original = (F.col("_digest") == F.col("_same")) & (F.col("_id") == F.col("_first"))
    known = (
        known.join(marks, F.col("_id") == F.col("_label_id"), "left")
        .join(firsts, original, "left")
        .withColumn("mask", F.col("mask") + F.when(F.col("_first").isNull(), bit[DUPLICATE]).otherwise(0))
    )
    columns = ["part", "mask", "n"]
    lost = {"good": F.coalesce("_good", F.lit(False)), "toxic": F.coalesce("_toxic", F.lit(False))}
    none = F.lit(0).cast("long")
    all_rows = union(
        known.select(*columns, *(F.when(c, F.col("n")).otherwise(none).alias(k) for k, c in lost.items())),
        unknown.select(*columns, *(none.alias(k) for k in lost)),
    )
    return all_rows.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def lattice(filters: int) -> list[tuple[int, int, int, int]]:
    """(state, filter, reach, leave) of every edge: the orders that lead to its start, and on from its end."""
    full = (1 << filters) - 1
    reach, leave = {0: 1}, {full: 1}
    for state in range(full + 1):
        for i in range(filters):
            if not state >> i & 1:
                reach[state | 1 << i] = reach.get(state | 1 << i, 0) + reach[state]
    for state in range(full, -1, -1):
        for i in range(filters):
            if state >> i & 1:
                leave[state ^ 1 << i] = leave.get(state ^ 1 << i, 0) + leave[state]
    return [(s, i, reach[s], leave[s | 1 << i]) for s in range(full + 1) for i in range(filters) if not s >> i & 1]


def audit(counts: DataFrame, letters="ABCDE") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)
    of all orders, from ``failure_counts``. ``letters`` are few: the result has a row per order and step."""
    spark = counts.sparkSession
    edges = lattice(len(letters))
    # how a document of each set of failures fares on each edge
    fates = []
    for mask in range(1 << len(letters)):
        for state, i, reach, leave in edges:
            fails, out = mask >> i & 1, mask & state != 0
            alone = int(mask == 1 << i)
            fates.append((mask, state, i, reach * leave, int(not out and not fails), int(fails and not out),
                          int(fails and out), alone))
    fate = local_table(spark, fates, "mask", "state", "filter", "paths", "kept", "removed", "redundant", "alone")
    on_edges = (
        counts.join(fate, "mask")
        .groupBy("part", "state", "filter", "paths")
        .agg(
            F.sum(F.col("n") * F.col("kept")).alias("kept"),
            F.sum(F.col("n") * F.col("removed")).alias("removed"),
            F.sum(F.col("n") * F.col("redundant")).alias("redundant"),
            F.sum(F.col("n") * F.col("alone")).alias("unique_fails"),
            F.sum(F.col("good") * F.col("removed")).alias("good_lost"),
            F.sum(F.col("toxic") * F.col("removed")).alias("toxic_lost"),
        )
    )
    on_edges = materialize(on_edges, "edges")  # asked for twice, a few rows per part
    shapley = on_edges.groupBy("part", "filter").agg(F.sum(F.col("paths") * F.col("removed")).alias("shapley"))
    steps = []
    for order in itertools.permutations(range(len(letters))):
        name, state = "".join(letters[i] for i in order), 0
        for step, i in enumerate(order, 1):
            steps.append((name, step, state, i))
            state |= 1 << i
    walked = local_table(spark, steps, "filter_order", "step", "state", "filter")
    return (
        on_edges.join(shapley, ["part", "filter"])
        .join(walked, ["state", "filter"])
        .select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost",
                "toxic_lost", "shapley")
    )

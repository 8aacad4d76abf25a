"""Quality rules: plain counts of a text, and a hashed n-gram log-likelihood ratio.

Words and pairs of neighbouring words fall into a fixed number of hash buckets. Two multinomials
over the buckets are counted, one of all trusted texts, one of the whole corpus; a text's score is the
mean of log p(trusted) - log p(corpus) over its n-grams, so length does not matter. Every text at or
above the threshold is kept, always the same ones; the threshold follows the trusted texts' scores.

All of it is built-in expressions. The bucket weights are broadcast: their number is a parameter. The
texts meet the trusted ids by a shuffle; when judged, a text's n-grams are summed where the text is,
so one row per text is shuffled."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custodia.llm.common import SPACE, text_of
from custodia.session import materialize, union

BUCKETS = 1 << 16
SMOOTHING = 10.0  # counts at least added to a bucket on both sides: rare n-grams weigh little
SMOOTHING_SHARE = 0.25  # of the target's mean count per bucket, added where that is more
THRESHOLD = -0.07  # where no trusted text passes the plain rules
LOW, LOWEST = 0.01, 0.001  # shares of the trusted texts whose scores place the threshold
SCORE_DIGITS = 3  # trusted scores are counted at
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{SPACE}]"))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def _hashes(words: str) -> Column:
    return F.transform(words, lambda x: F.xxhash64(x))


def _next(hashes: Column, i: Column, n: int) -> Column:
    return F.get(hashes, i + n)


def _first(column: str, without: int) -> Column:
    """The array but its last elements."""
    return F.slice(column, 1, F.greatest(F.size(column) - without, F.lit(0)))


def _threes(hashes: str) -> Column:
    """A hash of every run of three words."""
    h = F.col(hashes)
    return F.transform(_first(hashes, 2), lambda x, i: F.xxhash64(x, _next(h, i, 1), _next(h, i, 2)))


def _sorted_if_any_repeats(threes: str) -> Column:
    """(hash, position) of the runs, sorted; nothing where all differ, as in most texts."""
    t = F.col(threes)
    pairs = F.sort_array(F.transform(t, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(t)) < F.size(t), pairs)


def _repeated(windows: str) -> Column:
    """Sorted positions of the windows that occur twice or more."""
    s = F.col(windows)
    at = F.transform(
        s,
        lambda x, k: F.when(
            (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"]
        ),
    )
    return F.sort_array(F.array_compact(at))


def _union_of_threes(positions: str) -> Column:
    """Words covered by runs of three at the given sorted positions."""
    p = F.col(positions)
    added = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
    return F.aggregate(added, F.lit(0).cast("long"), lambda total, n: total + n)


def ngram_buckets(hashes: str, buckets=BUCKETS) -> Column:
    """Buckets of all words and all pairs of neighbours, from the words' hashes."""
    h, size = F.col(hashes), F.lit(buckets)
    one = F.transform(h, lambda x: F.pmod(x, size).cast("int"))
    two = F.transform(_first(hashes, 1), lambda x, i: F.pmod(F.xxhash64(x, _next(h, i, 1)), size).cast("int"))
    return F.concat(one, two)


def trusted_ids(labels: DataFrame, id_col: str, trusted: Column) -> DataFrame:
    """Ids of all trusted texts."""
    return labels.filter(trusted & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_trusted")).distinct()


def fit(docs: DataFrame, trusted: DataFrame, id_col="doc_id", text_col="text", buckets=BUCKETS) -> DataFrame:
    """(bucket, weight) of all buckets that occur: log p(trusted) - log p(corpus), both smoothed.

    ``docs`` are counted whole; ids in ``trusted``, a table of any size, mark the trusted texts. Both
    sides are smoothed alike, by a count that grows with the target."""
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    # rows without an id are never trusted and would all meet in one task
    # by a shuffle at every size: the ids grow with the corpus
    known = rows.filter(F.col("_id").isNotNull()).join(trusted.hint("merge"), F.col("_id") == F.col("_trusted"), "left")
    unknown = rows.filter(F.col("_id").isNull()).withColumn("_trusted", F.lit(None).cast(trusted.schema["_trusted"].dataType))
    marked = union(known, unknown)
    hashed = marked.withColumn("_w", words_of(F.col("_text"))).withColumn("_h", _hashes("_w"))
    counts = (
        hashed.select(F.col("_trusted").isNotNull().cast("long").alias("t"), ngram_buckets("_h", buckets).alias("_b"))
        .select("t", F.explode_outer("_b").alias("bucket"))  # a plain explode would test the array again at the scan
        .filter(F.col("bucket").isNotNull())
        .groupBy("bucket")
        .agg(F.sum("t").cast("double").alias("t"), F.count("*").cast("double").alias("r"))
    )
    counts = materialize(counts, "buckets")  # asked for twice, and at most ``buckets`` rows
    totals = counts.agg(F.sum("t"), F.sum("r")).first()
    share = (totals[0] or 0.0) / (totals[1] or 1.0)
    expected = F.col("r") * share  # of trusted texts that are like the corpus
    added = max(SMOOTHING, SMOOTHING_SHARE * (totals[0] or 0.0) / buckets)
    return counts.select("bucket", F.log((F.col("t") + added) / (expected + added)).alias("weight"))


def trusted_threshold(judged: DataFrame, trusted: DataFrame, id_col="doc_id") -> float:
    """The score that trusted texts hardly ever miss: as far below their lowest scores as those lie
    below their low ones.

    Trusted texts that fail the plain rules do not count. The scores are counted at ``SCORE_DIGITS``
    digits, so the driver gets one number for each different one."""
    passed = judged.filter(~F.col("base_failed")).join(trusted, F.col(id_col) == F.col("_trusted"))
    counts = passed.groupBy(F.round("score", SCORE_DIGITS).alias("s")).count().orderBy("s").collect()
    total = sum(r["count"] for r in counts)
    if not total:
        return THRESHOLD
    places, seen = {}, 0
    for r in counts:
        seen += r["count"]
        for share in (LOW, LOWEST):
            if seen > share * (total - 1):
                places.setdefault(share, r["s"])
    return places[LOWEST] - (places[LOW] - places[LOWEST])


def judge_by_trusted(docs: DataFrame, trusted: DataFrame, id_col="doc_id", text_col="text", **rules) -> DataFrame:
    """``judge`` with weights and threshold of the trusted texts; every text is scored once."""
    weights = fit(docs, trusted, id_col, text_col, rules.get("buckets", BUCKETS))
    judged = materialize(judge(docs, weights, id_col, text_col, **rules), "judged")
    limit = trusted_threshold(judged, trusted, id_col)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= limit))


def judge(docs: DataFrame, weights: DataFrame, id_col="doc_id", text_col="text", threshold=THRESHOLD,
          buckets=BUCKETS, min_words=50, max_repeated_percent=50) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, base_failed, kept).

    Null texts count as empty; a text without n-grams scores 0 and fails the plain rules, as every
    text below ``min_words`` does. Repeated rows and rows without an id stay."""
    text = F.col("_text")
    counted = (
        docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
        .withColumn("_w", words_of(text))
        .withColumn("_h", _hashes("_w"))
        .withColumn("_t", _threes("_h"))
        .withColumn("_s", _sorted_if_any_repeats("_t"))
        .withColumn("_p", _repeated("_s"))
    )
    # the row number, last, also keeps later filters above these steps, which would repeat them
    base = counted.select(
        "_id", F.monotonically_increasing_id().alias("_row"),
        F.size("_h").cast("long").alias("n_words"),
        (F.length(text) - F.regexp_count(text, F.lit(f"[{SPACE}]"))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        duplicate_lines(text).alias("n_dup_lines"),
        F.coalesce(_union_of_threes("_p"), F.lit(0).cast("long")).alias("n_repeat_words"),
        ngram_buckets("_h", buckets).alias("_b"),
    )
    base = base.withColumn("bucket", F.explode_outer("_b")).drop("_b")
    # at most ``buckets`` rows
    weighed = base.join(F.broadcast(weights), "bucket", "left")
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    scored = weighed.groupBy("_row", "_id", *columns).agg(F.coalesce(F.avg("weight"), F.lit(0.0)).alias("score"))
    failed = (F.col("n_words") < min_words) | (
        100 * F.col("n_repeat_words") > max_repeated_percent * F.col("n_words")
    )
    return scored.select(
        F.col("_id").alias(id_col), *columns, "score", failed.alias("base_failed"),
        (~failed & (F.col("score") >= threshold)).alias("kept"),
    )

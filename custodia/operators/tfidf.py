"""TF-IDF over unigrams and bigrams, fitted and applied as Spark aggregations.

Tokens are lower-cased runs of two or more word characters; stop words go out before
bigrams are formed. Terms in more than ``max_df`` of the documents are dropped, then the
``max_features`` terms of highest corpus count are kept (ties by term)."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custodia import constants as C
from custodia.functions.once import bind
from custodia.operators import postings
from custodia.operators.topk import id_type
from custodia.operators.words import Splitter
from custodia.session import materialize, union

_TERMS_PER_STEP = 1_000_000  # of the texts that a task counts at a time
_COUNTS_KEPT = 2_000_000  # of terms that a task adds up before it hands them on
_ROWS_OUT = 200_000  # of a batch of counts
_INLINE_WORDS = 5000  # a word set up to this size is held by every task

TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def tokens(text, stop_words=None) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))
    stops = C.STOP_WORDS if stop_words is None else stop_words
    if not stops:
        return words
    return F.filter(words, lambda w: ~w.isin(*stops))


def bigrams(words: Column) -> Column:
    return bind(
        words,
        lambda w: F.when(
            F.size(w) > 1,
            F.filter(
                F.zip_with(w, F.slice(w, 2, F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b)),
                lambda pair: pair.isNotNull(),
            ),
        ).otherwise(F.array().cast("array<string>")),
    )


def _listed_terms(batches, column):
    """Parts of some batches with a column of term lists: the part, the row of every term, and the terms dictionary-encoded."""
    for batch in batches:
        ends = np.cumsum(batch.column(column).value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + _TERMS_PER_STEP, side="right")))
            if ends[to - 1] > before:
                part = batch.slice(at, to - at)
                rows = np.repeat(np.arange(to - at), np.diff(ends[at:to], prepend=before))
                terms = part.column(column).flatten()
                # those that are encoded already keep their dictionary
                yield part, rows, terms if pa.types.is_dictionary(terms.type) else terms.dictionary_encode()
            at = to


def _distinct(codes):
    """The distinct codes in order; sorting takes less than the hashing of ``np.unique``."""
    codes = np.sort(codes)
    return codes[np.r_[True, codes[1:] != codes[:-1]]] if len(codes) else codes


def _added_up(counted):
    """Batches of (term, cf, df) with the counts of a term added up, as far as a bounded number of terms goes.

    Most words are rare: adding up here what many steps have met spares a row of every step."""
    waiting, rows = [], 0

    def merged():
        table = pa.Table.from_batches(waiting).group_by("term", use_threads=False).aggregate([("cf", "sum"), ("df", "sum")])
        return table.select(["term", "cf_sum", "df_sum"]).rename_columns(["term", "cf", "df"]).combine_chunks().to_batches()

    for batch in counted:
        waiting.append(batch)
        rows += batch.num_rows
        if rows > _COUNTS_KEPT:
            waiting = merged()
            rows = sum(b.num_rows for b in waiting)
            if 2 * rows > _COUNTS_KEPT:
                yield from _cut_rows(waiting)
                waiting, rows = [], 0
    if waiting:
        yield from _cut_rows(merged())


def _cut_rows(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS_OUT):
            yield batch.slice(at, _ROWS_OUT)


def _counts(listed: DataFrame, splitter=None) -> DataFrame:
    """(term, cf, df): how often the terms of one column of lists occur, and in how many rows, for some rows at a time.

    With a splitter the column has texts in lower case."""

    def run(batches):
        for _, rows, encoded in _listed_terms(splitter.lists(batches, 0) if splitter else batches, 0):
            terms, codes = len(encoded.dictionary), encoded.indices.to_numpy()
            once = _distinct(rows * terms + codes)
            cf, df = np.bincount(codes, minlength=terms), np.bincount(once % terms, minlength=terms)
            met = cf > 0
            yield pa.RecordBatch.from_arrays(
                [encoded.dictionary.filter(pa.array(met)), pa.array(cf[met]), pa.array(df[met])], ["term", "cf", "df"])

    return listed.mapInArrow(lambda batches: _added_up(run(batches)), "term string, cf long, df long")


def _stats(counted: DataFrame) -> DataFrame:
    return counted.groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))


def _splitter(df: DataFrame, stop_words) -> Splitter:
    return Splitter(df.sparkSession, C.STOP_WORDS if stop_words is None else stop_words)


def _pairs(rows, numbers, size):
    """Row and number of the pairs of neighbours in a row; numbers below zero stand for words that make none."""
    at = np.flatnonzero((rows[1:] == rows[:-1]) & (numbers[1:] >= 0) & (numbers[:-1] >= 0))
    return rows[at], numbers[at] * np.int64(size) + numbers[at + 1]


def _looked_up(encoded, terms, numbers):
    """The numbers of terms, -1 for those that are not listed."""
    place = pa.compute.index_in(encoded.dictionary, value_set=terms).fill_null(len(terms)).to_numpy()
    return np.append(numbers, -1)[place][encoded.indices.to_numpy()]


def _pair_counts(docs, text, stop_words, frequent):
    """Counts of the bigrams of frequent words."""
    head = [row[0] for row in frequent.limit(_INLINE_WORDS + 1).collect()]
    inline = len(head) <= _INLINE_WORDS
    splitter = _splitter(docs, stop_words)

    def run(batches):
        for _, rows, encoded in _listed_terms(splitter.lists(batches, 0), 0):
            words = pa.array(head, pa.string()) if inline else encoded.dictionary
            numbers = _looked_up(encoded, words, np.arange(len(words)))
            size = max(1, len(words))
            rows, pairs = _pairs(rows, numbers, size)
            found, code, cf = np.unique(pairs, return_inverse=True, return_counts=True)
            df = np.bincount(_distinct(rows * np.int64(max(1, len(found))) + code) % max(1, len(found)), minlength=len(found))
            terms = pa.compute.binary_join_element_wise(words.take(pa.array(found // size)), words.take(pa.array(found % size)), " ")
            yield pa.RecordBatch.from_arrays([terms, pa.array(cf), pa.array(df)], ["term", "cf", "df"])

    counted = docs.select(F.lower(text)).mapInArrow(lambda batches: _added_up(run(batches)), "term string, cf long, df long")
    if inline:
        return counted
    # many words tie at the cut: filter by joins, the strategy is left to the optimizer
    first, second = frequent.toDF("_a"), frequent.toDF("_b")
    return (
        counted
        .withColumn("words", F.split("term", " "))
        .join(first, F.col("words")[0] == F.col("_a"), "left_semi")
        .join(second, F.col("words")[1] == F.col("_b"), "left_semi")
    )


def vocabulary(docs: DataFrame, text="content", max_features=1000, max_df=0.95,
               stop_words=None) -> DataFrame:
    """The fitted terms: (term, term_id, cf, df, idf). At most ``max_features`` rows.

    A bigram is never more frequent than either of its words. So the words are counted first,
    and only bigrams of words that reach the provisional cut are counted at all; the long tail
    of rare bigrams never enters a shuffle. The result is the same as counting everything."""
    total = docs.count()
    limit = max_df * total
    words = materialize(_stats(_counts(docs.select(F.lower(text)), _splitter(docs, stop_words))), "tfidf-words")
    ranked = words.filter(F.col("df") <= limit).orderBy(F.col("cf").desc()).limit(max_features)
    cut = ranked.agg(F.min("cf").alias("cut"), F.count("*").alias("n")).first()
    floor = cut["cut"] if cut["n"] == max_features else 1
    reaching = words.filter(F.col("cf") >= floor)
    pairs = _stats(_pair_counts(docs, text, stop_words, reaching.select("term")))
    kept = (
        union(reaching, pairs.filter(F.col("cf") >= floor))
        .filter(F.col("df") <= limit)
        .orderBy(F.col("cf").desc(), "term")
        .limit(max_features)
    )
    return materialize(
        kept.agg(F.sort_array(F.collect_list(F.struct("term", "cf", "df"))).alias("t"))
        .select(F.posexplode("t").alias("term_id", "s"))
        .select(
            "s.term", "term_id", "s.cf", "s.df",
            (F.log((1.0 + total) / (1.0 + F.col("s.df"))) + 1.0).alias("idf"),
        ),
        "tfidf-vocabulary",
    )


def weigh(texts: DataFrame, vocab: DataFrame, key: str, text: str, stop_words=None) -> DataFrame:
    """Per text with a known term: its unit-length sparse vector, array<struct<i,w>>.

    The vocabulary has at most ``max_features`` rows, so each task holds it: nothing is
    shuffled. Tasks find terms, count them and look up weights, batch-wise."""
    rows = vocab.select("term", "term_id", "idf").collect()
    number = {row["term"]: row["term_id"] for row in rows}
    size = max(number.values(), default=0) + 1
    idf = np.zeros(size)
    for row in rows:
        idf[row["term_id"]] = row["idf"]
    # words have their number, those that only stand in pairs one behind all
    every = dict(number)
    for word in sorted({word for term in number if " " in term for word in term.split(" ")}):
        every.setdefault(word, len(every) + size)
    most = max(every.values(), default=0) + 1
    pairs = sorted((every[a] * most + every[b], number[f"{a} {b}"]) for a, b in (t.split(" ") for t in number if " " in t))
    pair_codes, pair_terms = np.array(pairs, np.int64).reshape(-1, 2).T
    splitter, kind = _splitter(texts, stop_words), id_type(texts, key)
    words, numbers = list(every), np.array(list(every.values()), np.int64)

    def run(batches):
        # texts without a known term are left out
        known = pa.array(words, pa.string())
        for part, row, encoded in _listed_terms(splitter.lists(batches, 1), 1):
            found = _looked_up(encoded, known, numbers)
            single = (found >= 0) & (found < size)
            pair_row, code = _pairs(row, found, most)
            place = np.minimum(np.searchsorted(pair_codes, code), max(0, len(pair_codes) - 1))
            hit = pair_codes[place] == code if len(pair_codes) else np.zeros(len(code), bool)
            entries = np.r_[row[single] * size + found[single], pair_row[hit] * size + pair_terms[place[hit]]]
            if not len(entries):
                continue
            entries, tf = np.unique(entries, return_counts=True)
            row, term = np.divmod(entries, size)
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            weights = tf * idf[term]
            norms = np.sqrt(np.add.reduceat(weights * weights, starts))
            starts = np.r_[starts, len(row)].astype(np.int32)
            weights = weights / np.repeat(norms, np.diff(starts))
            entries = pa.StructArray.from_arrays([pa.array(term.astype(np.int32)), pa.array(weights)], ["i", "w"])
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(row[starts[:-1]])), pa.ListArray.from_arrays(pa.array(starts), entries)], [key, "vec"]
            )

    known = texts.select(F.col(key).cast(kind).alias(key), F.lower(text))
    return known.mapInArrow(run, f"{key} {kind}, vec array<struct<i:int,w:double>>")


@dataclass
class KeywordIndex:
    """A fitted model, the vectors of the corpus it was fitted on, and their inverted index."""

    vocab: DataFrame
    vectors: DataFrame
    dim: int
    stop_words: list | None
    segments: DataFrame
    champions: dict  # of at most ``dim`` terms


def fit(docs: DataFrame, key="id", text="content", max_features=1000, max_df=0.95,
        stop_words=None) -> KeywordIndex:
    vocab = vocabulary(docs, text, max_features, max_df, stop_words)
    vectors = materialize(weigh(docs, vocab, key, text, stop_words), "tfidf-vectors")
    vectors = vectors.withColumnRenamed(key, "id")
    segments = materialize(postings.build(vectors), "tfidf-postings")
    champions = postings.champions(segments)
    return KeywordIndex(vocab, vectors, max_features, stop_words, segments, champions)


def keyword_top_k(index: KeywordIndex, queries: DataFrame, k: int, query="query",
                  query_key="query_id", **options) -> DataFrame:
    """The k best documents per query by TF-IDF similarity, those without any dropped.

    The work follows the postings of the queries' terms, not the size of the corpus."""
    weighed = weigh(queries, index.vocab, query_key, query, index.stop_words)
    return postings.top_k(index.segments, index.champions, weighed, k, index.dim, query_key=query_key, **options)

"""Semantic, keyword and hybrid retrieval for many queries at once."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from custodia import constants as C
from custodia.operators import tfidf
from custodia.operators.topk import SCORE_DIGITS, top_k
from custodia.session import union

_BROADCAST_BYTES = 64 << 20


def semantic_top_k(vectors: DataFrame, queries: DataFrame, k: int, dim: int, metric="cosine",
                   **options) -> DataFrame:
    return top_k(vectors, queries, k, dim, metric=metric, **options)


def hits_union(semantic: DataFrame, keyword: DataFrame, metric="cosine",
               semantic_weight=C.SEMANTIC_WEIGHT, keyword_weight=C.KEYWORD_WEIGHT) -> DataFrame:
    """Both hit lists as one bag, weighted; ``position`` keeps semantic before keyword.

    The distance index exposes no similarity, so with ``l2`` each hit scores the flat weight."""
    total = semantic_weight + keyword_weight
    if total == 0:
        raise ValueError("the weights must not sum to zero")
    ws, wk = semantic_weight / total, keyword_weight / total
    score = F.lit(ws) if metric == "l2" else F.col("score") * ws
    first = semantic.select(
        "query_id", "item_id",
        F.lit(C.SEMANTIC_METHODS[metric]).alias("method"),
        score.alias("relevance_score"),
        F.col("rank").cast("long").alias("position"),
    )
    second = keyword.select(
        "query_id", "item_id",
        F.lit(C.KEYWORD_METHOD).alias("method"),
        (F.col("score") * wk).alias("relevance_score"),
        (F.col("rank") + 1_000_000).cast("long").alias("position"),
    )
    return union(first, second)


def merge_hits(hits: DataFrame) -> DataFrame:
    """One row per query and document: scores added, ``hybrid`` when found both ways.
    At most two rows meet in a group."""
    return hits.groupBy("query_id", "item_id").agg(
        F.sum("relevance_score").alias("relevance_score"),
        F.when(F.count("*") > 1, C.HYBRID_METHOD).otherwise(F.min("method")).alias("retrieval_method"),
        F.min("position").alias("position"),
    )


def cut_ranked(merged: DataFrame, k: int) -> DataFrame:
    """The k best per query; equal scores keep the order of the hit lists."""
    order = Window.partitionBy("query_id").orderBy(
        F.round("relevance_score", SCORE_DIGITS).desc(), "position"
    )
    return merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("position")


def hybrid_retrieve(vectors: DataFrame, index: tfidf.KeywordIndex, queries: DataFrame, k=5, dim=64,
                    metric="cosine", semantic_weight=C.SEMANTIC_WEIGHT,
                    keyword_weight=C.KEYWORD_WEIGHT) -> DataFrame:
    """(query_id, item_id, relevance_score, retrieval_method, rank).

    ``queries`` has query_id, query and embedding; each branch is cut to k before the merge."""
    semantic = semantic_top_k(vectors, queries, k, dim, metric)
    keyword = tfidf.keyword_top_k(index, queries.select("query_id", "query"), k)
    return cut_ranked(
        merge_hits(hits_union(semantic, keyword, metric, semantic_weight, keyword_weight)), k
    )


def with_documents(hits: DataFrame, corpus: DataFrame, *columns, long=("content",)) -> DataFrame:
    """Join ranked hits to columns of their documents.

    ``hits`` should be a stored table: its ids are measured first. Up to a checked size of them the
    corpus is filtered where it is read, so that nothing unwanted is shuffled; beyond that it is a
    plain join. Of documents that share an id one is taken, the smallest by its short columns and
    then by the ``long`` ones, so that separate joins agree on it."""
    ids = hits.select(F.col("item_id").alias("id")).distinct()
    size = ids.agg(F.sum(F.octet_length(F.col("id").cast("string")) + 16)).first()[0] or 0
    if size <= _BROADCAST_BYTES:
        corpus = corpus.join(F.broadcast(ids), "id", "left_semi")
    short = sorted(c for c in corpus.columns if c != "id" and c not in long)
    texts = [c for c in long if c in corpus.columns]
    if all(isinstance(c, str) for c in columns):
        texts = [c for c in texts if c in columns]
    docs = corpus.groupBy(F.col("id").alias("_id")).agg(F.min(F.struct(*short, *texts)).alias("_doc"))
    docs = docs.select("_id", F.col("_id").alias("id"), "_doc.*").select("_id", *columns)
    return hits.join(docs, F.col("item_id") == F.col("_id")).drop("_id")


def first_by_id(corpus: DataFrame, key="id", position="position") -> DataFrame:
    """The first document per id. The minimum combines before the shuffle, so copies are cheap."""
    others = [c for c in corpus.columns if c not in (key, position)]
    first = F.min_by(F.struct(*others), position)
    return corpus.groupBy(key).agg(F.min(position).alias(position), first.alias("d")).select(
        key, position, "d.*"
    )


def hits_by_position(hits: DataFrame, corpus: DataFrame, doc_index="doc_index",
                     position="position") -> DataFrame:
    """Join on the stored position; non-numeric and unknown positions are skipped."""
    where = F.col(doc_index).cast("string").try_cast("double").try_cast("long")
    return hits.withColumn("_at", where).join(
        corpus.withColumnRenamed(position, "_at"), "_at"
    ).withColumnRenamed("_at", position)


def domain_postfilter(ranked: DataFrame, domain, k: int) -> DataFrame:
    """Keep the domain's rows of an over-fetched ranking, then the first k of them."""
    order = Window.partitionBy("query_id").orderBy("rank")
    return (
        ranked.filter(F.col("domain") == domain)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
    )


def domain_or_public(ranked: DataFrame, wanted="wanted_domain") -> DataFrame:
    """The wanted domain's rows; a query without any keeps its public rows."""
    mine = F.col("domain") == F.col(wanted)
    has = F.max(F.coalesce(mine, F.lit(False))).over(Window.partitionBy("query_id"))
    return (
        ranked.withColumn("_has", has)
        .filter(F.when(F.col("_has"), mine).otherwise(F.col("domain") == "public"))
        .drop("_has")
    )


def query_similar(vectors: DataFrame, queries: DataFrame, k: int, dim: int, metric="cosine",
                  **equals) -> DataFrame:
    """Top k among the vectors whose metadata match: the filter runs before the ranking."""
    kept = vectors
    for column, value in equals.items():
        kept = kept.filter(F.col(column) == value)
    return semantic_top_k(kept, queries, k, dim, metric)


def route_queries(queries: DataFrame, topics: DataFrame, query="query") -> DataFrame:
    """The domain with most topic words in the query; ties go to the first topic, else none."""
    words = queries.select(
        "query_id", F.explode(tfidf.tokens(F.col(query), [])).alias("word")
    )
    votes = words.join(topics, "word").groupBy("query_id", "topic_pos", "topic").agg(
        F.count("*").alias("votes")
    )
    best = votes.groupBy("query_id").agg(
        F.max_by(F.struct("topic", "votes"), F.struct("votes", -F.col("topic_pos"))).alias("b")
    )
    return queries.join(best, "query_id", "left").select(
        *queries.columns,
        F.coalesce("b.topic", F.lit("none")).alias("routed_domain"),
        F.coalesce("b.votes", F.lit(0)).alias("votes"),
    )


def _ordered_docs(documents):
    ordered = F.sort_array(F.collect_list(F.struct("rank", "id", "title", "domain", "content")))
    return documents.groupBy("query_id").agg(ordered.alias("docs"))


def assemble_context(documents: DataFrame, numbered=True) -> DataFrame:
    """Per query: the context text, the cited sources and the document count.

    ``documents`` has at most k rows per query: query_id, rank, id, title, domain, content."""

    def block(doc, i):
        title = F.coalesce(doc["title"], F.lit("Untitled"))
        head = (
            F.concat(F.lit("[Document "), (i + 1).cast("string"), F.lit(": "), title)
            if numbered
            else F.concat(F.lit("["), title)
        )
        return F.concat(head, F.lit("]\n"), F.coalesce(doc["content"], F.lit("")), F.lit("\n"))

    return _ordered_docs(documents).select(
        "query_id",
        F.array_join(F.transform("docs", block), "\n").alias("context"),
        F.transform(
            "docs",
            lambda d: F.struct(
                F.coalesce(d["title"], F.lit("Untitled")).alias("title"),
                d["id"].alias("id"),
                F.coalesce(d["domain"], F.lit("unknown")).alias("domain"),
            ),
        ).alias("sources"),
        F.size("docs").cast("long").alias("document_count"),
    )

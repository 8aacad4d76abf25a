"""Vector store, retrieval and governed pipelines over every question of the conversations."""

from pyspark.sql import functions as F

from custodia import constants as C
from custodia import rules
from custodia.functions import text
from custodia.operators import access, analytics, governed, retrieval, tfidf
from custodia.plans.registry import query
from custodia.plans.sql_views import hybrid, role_mask, rows, with_views, words
from custodia.plans.sql_views import text as lit
from custodia.sources import tables as T
from custodia.sources import vector_store
from custodia.session import materialize, new_path, union

DIM = 64
K = 5
_fitted = {}


def keyword_index(spark, sf_dir):
    """The fitted index of a corpus; fitted once per application, as retrieval does."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _fitted:
        _fitted[key] = tfidf.fit(T.corpus(spark, sf_dir).select("id", "content"))
    return _fitted[key]


def _stored(spark, sf_dir):
    stored = T.table(spark, sf_dir, "embeddings")
    return stored.select(F.col("vec_id").alias("id"), "embedding")


def _vectors(spark, sf_dir):
    """The vectors of documents that exist; tables bucketed by id join without a shuffle."""
    ids = T.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return _stored(spark, sf_dir).join(ids, "id", "left_semi")


def _rounded(ranked, score="score"):
    return ranked.withColumn(score, F.round(score, 6)).withColumn("rank", F.col("rank").cast("long"))


def _hybrid(spark, sf_dir, k, metric="cosine", questions=None):
    asked = T.question_vectors(spark, sf_dir) if questions is None else questions
    return retrieval.hybrid_retrieve(
        _vectors(spark, sf_dir), keyword_index(spark, sf_dir),
        asked.select("query_id", "query", "embedding"), k, DIM, metric,
    )


# --- vector store ----------------------------------------------------------------------


def _store(spark, sf_dir):
    return vector_store.with_key(
        T.vectors(spark, sf_dir).select("id", "namespace", "title", "domain", "embedding")
    ).withColumn("version", F.lit(1))


def _updates(spark, sf_dir):
    """Labelled documents come again, twice, with a new title each time."""
    good = T.table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("id"))
    docs = T.corpus(spark, sf_dir).select("id", "domain").join(good, "id")
    again = docs.withColumn("version", F.explode(F.array(F.lit(2), F.lit(3))))
    # the new vector is a fixed one: only the merge is under test
    return again.select(
        "id", F.lit("ns0").alias("namespace"),
        F.concat(F.lit("Revision "), F.col("version").cast("string")).alias("title"),
        "domain", F.array_repeat(F.lit(0.125).cast("float"), DIM).alias("embedding"), "version",
    )


_STORE = """store AS (SELECT id || '_' || namespace AS vector_id, id, namespace, title, domain, 1 AS version,
      round(list_sum(embedding), 4) AS total FROM vectors)"""


def _shown(store):
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return store.select(
        "vector_id", "id", "namespace", "title", "domain", "version", F.round(total, 4).alias("total")
    )


@query("vector_upsert", with_views("vectors", """
    SELECT * FROM store WHERE vector_id NOT IN (SELECT id || '_ns0' FROM changed) UNION ALL
    SELECT id || '_ns0', id, 'ns0', 'Revision 3', domain, 3, 8.0 FROM changed""", _STORE, """
    changed AS (SELECT id, domain FROM corpus JOIN labels ON doc_id = id WHERE quality = 1)"""))
def vector_upsert(spark, sf_dir):
    changes = vector_store.with_key(_updates(spark, sf_dir))
    path = new_path(spark, "vector-store")
    vector_store.write_store(_store(spark, sf_dir), path, buckets=4)
    vector_store.merge_into(changes, path, buckets=4)
    return _shown(spark.read.parquet(path))


@query("vector_delete_ids", with_views("vectors", """
    SELECT * FROM store WHERE vector_id NOT IN (SELECT doc_id || '_ns1' FROM labels WHERE toxic = 1)""", _STORE))
def vector_delete_ids(spark, sf_dir):
    toxic = T.table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    return _shown(vector_store.delete_ids(_store(spark, sf_dir), toxic, "ns1"))


@query("vector_delete_namespace", with_views("vectors", "SELECT * FROM store WHERE namespace <> 'ns1'", _STORE))
def vector_delete_namespace(spark, sf_dir):
    return _shown(vector_store.delete_namespace(_store(spark, sf_dir), "ns1"))


@query("ensure_index", with_views("corpus", """
    SELECT id, coalesce(len(embedding), -1) = 64 AS usable FROM corpus LEFT JOIN embeddings ON vec_id = id"""))
def ensure_index(spark, sf_dir):
    docs = T.corpus(spark, sf_dir).select("id").join(_stored(spark, sf_dir), "id", "left")
    good, bad = vector_store.ensure_dimension(docs, DIM)
    return union(
        good.select("id", F.lit(True).alias("usable")), bad.select("id", F.lit(False).alias("usable"))
    )


@query("index_stats", with_views("vectors", """
    SELECT false AS is_total, namespace, count(*) AS vectors, max(len(embedding)) AS dimension FROM vectors GROUP BY namespace
    UNION ALL SELECT true, NULL, count(*), max(len(embedding)) FROM vectors"""))
def index_stats(spark, sf_dir):
    return analytics.index_stats(T.vectors(spark, sf_dir))


def _too_long(texts):
    """Stands in for an embedding model: it takes no text above 20,000 characters."""
    if (texts.str.len() > 20_000).any():
        raise ValueError("a text is too long")
    return [[len(t), t.count(" ") + 1, t.count("e")] for t in texts]


def _load(spark, sf_dir):
    """A store of every second document, into which the whole corpus is then loaded batch by batch."""
    path = new_path(spark, "vector-store")
    docs = T.corpus(spark, sf_dir)
    first = docs.filter("id % 2 = 0").select("id", *text.vector_metadata()).withColumns(
        {"embedding": F.array(*[F.lit(0.0).cast("float")] * 3), "namespace": F.lit("ns0"), "version": F.lit(0)})
    vector_store.write_store(vector_store.with_key(first), path, buckets=4)
    return path, vector_store.load_into(docs, path, _too_long, "ns0", dim=3, position="id", buckets=4)


_LOADED = """batches AS (SELECT id // 100 AS batch, count(*) AS documents, max(length(content)) > 20000 AS failed
      FROM corpus GROUP BY 1)"""


@query("indexing_stats", with_views("corpus", """
    SELECT sum(documents)::BIGINT AS total_documents, sum(CASE WHEN failed THEN 0 ELSE documents END)::BIGINT AS successfully_indexed,
      sum(CASE WHEN failed THEN documents ELSE 0 END)::BIGINT AS failed, true AS timed FROM batches""", _LOADED))
def indexing_stats(spark, sf_dir):
    """Totals of a real load; its seconds and its rate are whatever they were."""
    stats = analytics.indexing_stats(_load(spark, sf_dir)[1])
    timed = (F.col("duration_seconds") >= 0) & (F.col("docs_per_second") >= 0)
    return stats.select("total_documents", "successfully_indexed", "failed", timed.alias("timed"))


@query("load_batches", with_views("corpus", """
    SELECT batch, documents, failed, CASE WHEN failed THEN 'ValueError: a text is too long' END AS error FROM batches""", _LOADED))
def load_batches(spark, sf_dir):
    return _load(spark, sf_dir)[1].select("batch", "documents", "failed", "error")


@query("vector_load", with_views("corpus", """
    SELECT id || '_ns0' AS vector_id, title, CASE WHEN failed THEN 0 ELSE 1 END AS version, length(content) AS content_length,
      CASE WHEN failed THEN 0 ELSE length(content) END::DOUBLE AS first_value
    FROM corpus JOIN batches ON batch = id // 100 WHERE NOT failed OR id % 2 = 0""", _LOADED))
def vector_load(spark, sf_dir):
    """The store after the load: a failed batch leaves what was there, all others are new."""
    path, _ = _load(spark, sf_dir)
    return spark.read.parquet(path).select(
        "vector_id", "title", "version", "content_length", F.col("embedding")[0].cast("double").alias("first_value"))


# --- semantic --------------------------------------------------------------------------


def _semantic(spark, sf_dir, k, metric="cosine", **options):
    return retrieval.semantic_top_k(
        _vectors(spark, sf_dir), T.question_vectors(spark, sf_dir), k, DIM, metric, **options
    )


_TOP = "SELECT query_id, item_id, round(score, 6) AS score, rank FROM"


@query("semantic_topk_cosine", with_views("cos_ranked", f"{_TOP} cos_ranked WHERE rank <= 5"))
def semantic_topk_cosine(spark, sf_dir):
    return _rounded(_semantic(spark, sf_dir, K))


@query("semantic_topk_l2", with_views("l2_ranked", f"""
    SELECT query_id, item_id, rank, 0.7::DOUBLE AS relevance_score, 'semantic-faiss' AS retrieval_method,
      round(-score, 6) AS distance FROM l2_ranked WHERE rank <= 5"""))
def semantic_topk_l2(spark, sf_dir):
    ranked = _rounded(_semantic(spark, sf_dir, K, "l2"))
    return ranked.select(
        "query_id", "item_id", "rank", F.lit(C.SEMANTIC_WEIGHT).alias("relevance_score"),
        F.lit(C.SEMANTIC_METHODS["l2"]).alias("retrieval_method"), (-F.col("score")).alias("distance"),
    )


@query("semantic_topk_dot", with_views("question_vectors vectors", f"""{_TOP}
    (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM
      (SELECT q.query_id, v.id AS item_id, round(list_inner_product(q.embedding, v.embedding), 9) AS score
       FROM question_vectors q, vectors v)) WHERE rank <= 5"""))
def semantic_topk_dot(spark, sf_dir):
    return _rounded(_semantic(spark, sf_dir, K, "dot"))


@query("query_x_document", with_views("cos_ranked", f"{_TOP} cos_ranked WHERE rank <= 3"))
def query_x_document(spark, sf_dir):
    return _rounded(_semantic(spark, sf_dir, 3, least_blocks=4))


@query("query_similar_filtered", with_views("cos_scores", """
    SELECT query_id, item_id AS id, round(score, 6) AS score, rank, 'Document ' || item_id AS title, domain, substr(content, 1, 1000)
      AS content_preview FROM (SELECT s.*, c.content, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank
      FROM cos_scores s JOIN corpus c ON c.id = s.item_id WHERE s.namespace = 'ns0' AND s.domain = 'finance') WHERE rank <= 5"""))
def query_similar_filtered(spark, sf_dir):
    hits = retrieval.query_similar(
        T.vectors(spark, sf_dir), T.question_vectors(spark, sf_dir), K, DIM, namespace="ns0", domain="finance"
    )
    docs = T.corpus(spark, sf_dir)
    shown = retrieval.with_documents(
        materialize(hits, "hits"), docs, "title", "domain", F.substring("content", 1, 1000).alias("content_preview")
    )
    return _rounded(shown.withColumnRenamed("item_id", "id"))


@query("hits_to_documents", with_views("cos_ranked corpus", """
    SELECT query_id, rank, h.item_id, f.first_id, c2.title, c2.domain FROM cos_ranked h JOIN corpus c ON c.id = h.item_id
    JOIN (SELECT content, min(id) AS first_id FROM corpus GROUP BY content) f ON f.content = c.content
    JOIN corpus c2 ON c2.id = f.first_id WHERE rank <= 5"""))
def hits_to_documents(spark, sf_dir):
    """Copies of a text share an id (its hash): a hit resolves to the first of them."""
    corpus = T.corpus(spark, sf_dir)
    named = corpus.select("id", F.md5("content").alias("copy_id"))
    first = retrieval.first_by_id(
        corpus.select(F.md5("content").alias("copy_id"), F.col("id").alias("first_id"), "title", "domain"),
        "copy_id", "first_id",
    )
    hits = _semantic(spark, sf_dir, K).join(named, F.col("item_id") == F.col("id")).drop("id", "score")
    return hits.join(first, "copy_id").select(
        "query_id", F.col("rank").cast("long").alias("rank"), "item_id", "first_id", "title", "domain"
    )


@query("hits_by_position", with_views("cos_ranked corpus", """
    SELECT query_id, rank, item_id AS position, title FROM cos_ranked JOIN corpus ON id = item_id
    WHERE rank <= 5 AND NOT item_id % 7 = 0 AND NOT item_id % 11 = 0"""))
def hits_by_position(spark, sf_dir):
    """Stored positions as a service returns them: as floats, sometimes broken or out of range."""
    item = F.col("item_id")
    index = (
        F.when(item % 7 == 0, "none")
        .when(item % 11 == 0, (-item - 1).cast("string"))
        .otherwise(item.cast("double").cast("string"))
    )
    hits = _semantic(spark, sf_dir, K).select("query_id", "rank", index.alias("doc_index"))
    corpus = T.corpus(spark, sf_dir).select(F.col("id").alias("position"), "title")
    return retrieval.hits_by_position(hits, corpus).select(
        "query_id", F.col("rank").cast("long").alias("rank"), "position", "title"
    )


# --- keyword ---------------------------------------------------------------------------


@query("tfidf_fit", with_views("vocab", "SELECT term, cf, df, round(idf, 6) AS idf FROM vocab"))
def tfidf_fit(spark, sf_dir):
    fitted = tfidf.vocabulary(T.corpus(spark, sf_dir).select("content"))
    return fitted.select("term", "cf", "df", F.round("idf", 6).alias("idf"))


@query("tfidf_weights", with_views("doc_w", "SELECT id, term, round(w, 6) AS weight FROM doc_w"))
def tfidf_weights(spark, sf_dir):
    index = keyword_index(spark, sf_dir)
    flat = index.vectors.select("id", F.inline("vec")).join(
        F.broadcast(index.vocab.select("term", F.col("term_id").alias("i"))), "i"
    )
    return flat.select("id", "term", F.round("w", 6).alias("weight"))


def _keyword(spark, sf_dir, k):
    asked = T.questions(spark, sf_dir).select("query_id", "query")
    return tfidf.keyword_top_k(keyword_index(spark, sf_dir), asked, k)


@query("keyword_topk", with_views("kw_ranked", "SELECT query_id, item_id, round(score * 0.3::DOUBLE, 6) AS score, rank FROM kw_ranked WHERE rank <= 5"))
def keyword_topk(spark, sf_dir):
    ranked = _keyword(spark, sf_dir, K)
    return _rounded(ranked.withColumn("score", F.col("score") * C.KEYWORD_WEIGHT))


# --- hybrid ----------------------------------------------------------------------------

_BOTH = "cos_ranked kw_ranked"
_RANKED = "SELECT query_id, item_id, round(relevance_score, 6) AS relevance_score, retrieval_method, rank FROM"


def _hits_stored(ranked):
    """A ranking, written once: ``with_documents`` reads it for its ids, their size and the join."""
    return materialize(ranked, "hits")


def _hits(spark, sf_dir, k):
    return retrieval.hits_union(_semantic(spark, sf_dir, k), _keyword(spark, sf_dir, k))


@query("hits_union", with_views(_BOTH, """
    SELECT query_id, item_id, method, round(s, 6) AS relevance_score, position FROM hits_5""", hybrid(K)))
def hits_union(spark, sf_dir):
    return _hits(spark, sf_dir, K).withColumn("relevance_score", F.round("relevance_score", 6))


@query("hybrid_full_outer", with_views(_BOTH, """
    SELECT query_id, item_id, round(relevance_score, 6) AS relevance_score, retrieval_method, position FROM merged_5""", hybrid(K)))
def hybrid_full_outer(spark, sf_dir):
    merged = retrieval.merge_hits(_hits(spark, sf_dir, K))
    return merged.withColumn("relevance_score", F.round("relevance_score", 6))


@query("dedup_by_id", with_views(_BOTH, """
    SELECT query_id, count(*) AS hits, count(DISTINCT item_id) AS documents FROM hits_5 GROUP BY query_id""", hybrid(K)))
def dedup_by_id(spark, sf_dir):
    hits = _hits(spark, sf_dir, K).withColumn("n", F.lit(1))
    once = hits.groupBy("query_id", "item_id").agg(F.sum("n").alias("n"))
    return once.groupBy("query_id").agg(F.sum("n").alias("hits"), F.count("*").alias("documents"))


@query("hybrid_retrieve", with_views(_BOTH, f"{_RANKED} hybrid_5", hybrid(K)))
def hybrid_retrieve(spark, sf_dir):
    return _rounded(_hybrid(spark, sf_dir, K), "relevance_score")


@query("hybrid_retrieve_l2", with_views("l2_ranked kw_ranked", f"{_RANKED} hybrid_5", hybrid(K, "l2_ranked", True)))
def hybrid_retrieve_l2(spark, sf_dir):
    return _rounded(_hybrid(spark, sf_dir, K, "l2"), "relevance_score")


@query("topk_per_query", with_views(_BOTH, f"{_RANKED} hybrid_5 WHERE rank <= 3", hybrid(K)))
def topk_per_query(spark, sf_dir):
    merged = retrieval.merge_hits(_hits(spark, sf_dir, K))
    return _rounded(retrieval.cut_ranked(merged, 3), "relevance_score")


_DOMAIN_CUT = """SELECT query_id, item_id, domain, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank"""


@query("retrieve_by_domain", with_views(f"{_BOTH} corpus", f"""
    SELECT * FROM ({_DOMAIN_CUT} FROM hybrid_15 h JOIN corpus c ON c.id = h.item_id WHERE domain = 'hr') WHERE rank <= 5""", hybrid(3 * K)))
def retrieve_by_domain(spark, sf_dir):
    ranked = retrieval.with_documents(_hits_stored(_hybrid(spark, sf_dir, 3 * K)), T.corpus(spark, sf_dir), "domain")
    kept = retrieval.domain_postfilter(ranked, F.lit("hr"), K)
    return kept.select("query_id", "item_id", "domain", F.col("rank").cast("long").alias("rank"))


@query("domain_postfilter", with_views("cos_ranked corpus questions", f"""
    SELECT * FROM (SELECT h.query_id, item_id, c.domain, row_number() OVER (PARTITION BY h.query_id ORDER BY h.rank) AS rank
      FROM cos_ranked h JOIN corpus c ON c.id = h.item_id JOIN questions q ON q.query_id = h.query_id
      WHERE h.rank <= 15 AND c.domain = q.domain) WHERE rank <= 5"""))
def domain_postfilter(spark, sf_dir):
    wanted = T.questions(spark, sf_dir).select("query_id", F.col("domain").alias("wanted"))
    ranked = retrieval.with_documents(_hits_stored(_semantic(spark, sf_dir, 3 * K)), T.corpus(spark, sf_dir), "domain")
    kept = retrieval.domain_postfilter(ranked.join(wanted, "query_id"), F.col("wanted"), K)
    return kept.select("query_id", "item_id", "domain", F.col("rank").cast("long").alias("rank"))


@query("domain_or_public", with_views(f"{_BOTH} corpus questions", """
    SELECT query_id, item_id, domain, rank FROM (SELECT h.*, c.domain, q.domain AS wanted,
      bool_or(c.domain = q.domain) OVER (PARTITION BY h.query_id) AS has FROM hybrid_10 h JOIN corpus c ON c.id = h.item_id
      JOIN questions q ON q.query_id = h.query_id) WHERE CASE WHEN has THEN domain = wanted ELSE domain = 'public' END""", hybrid(2 * K)))
def domain_or_public(spark, sf_dir):
    wanted = T.questions(spark, sf_dir).select("query_id", F.col("domain").alias("wanted_domain"))
    ranked = retrieval.with_documents(_hits_stored(_hybrid(spark, sf_dir, 2 * K)), T.corpus(spark, sf_dir), "domain")
    kept = retrieval.domain_or_public(ranked.join(wanted, "query_id"))
    return kept.select("query_id", "item_id", "domain", F.col("rank").cast("long").alias("rank"))


@query("retriever_stats", with_views("corpus", """
    SELECT count(*) AS total_documents, string_agg(DISTINCT domain, ',' ORDER BY domain) AS domains FROM corpus"""))
def retriever_stats(spark, sf_dir):
    return analytics.retriever_stats(T.corpus(spark, sf_dir))


@query("sources_distinct", with_views("corpus", "SELECT DISTINCT domain FROM corpus"))
def sources_distinct(spark, sf_dir):
    return T.corpus(spark, sf_dir).select("domain").distinct()


# --- governed pipelines ----------------------------------------------------------------

_JOINED = """found AS (SELECT h.query_id, h.rank, q.query, q.role, q.framework, c.id, c.title, c.domain, c.content,
      EXISTS (SELECT 1 FROM role_access a WHERE a.r_role = q.role AND a.r_domain = c.domain) AS ok,
      EXISTS (SELECT 1 FROM fw_domains f WHERE f_domain = c.domain AND f_fw =
        CASE WHEN q.framework IN ('hipaa', 'gdpr', 'sox') THEN q.framework ELSE 'general' END) AS compliant
      FROM hybrid_5 h JOIN questions q USING (query_id) JOIN corpus c ON c.id = h.item_id)"""
_GOV = f"{_BOTH} corpus questions role_access fw_domains"


@query("validation_counts", with_views(_GOV, """
    SELECT query_id, count(*) AS documents_retrieved, count_if(ok) AS documents_validated, count_if(NOT ok) AS documents_denied,
      count_if(ok AND compliant) AS documents_compliant FROM found GROUP BY query_id""", hybrid(K), _JOINED))
def validation_counts(spark, sf_dir):
    asked = T.questions(spark, sf_dir).select("query_id", "role", "framework")
    docs = retrieval.with_documents(
        _hits_stored(_hybrid(spark, sf_dir, K).join(asked, "query_id")), T.corpus(spark, sf_dir), "domain"
    )
    return access.validation_counts(docs, ["query_id"], framework="framework")


def _answers_sql(keep, refusal, extra):
    return f"""{hybrid(K)}, {_JOINED}, kept AS (SELECT *, {role_mask()} AS masked FROM found WHERE {keep}),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM kept),
    context AS (SELECT query_id, count(*) AS n, string_agg('[Document ' || i || ': ' || title || ']' || chr(10) || masked || chr(10),
      chr(10) ORDER BY i) AS context, string_agg(id || '|' || title || '|' || domain, ';' ORDER BY i) AS sources FROM numbered GROUP BY query_id),
    answers AS (SELECT q.query_id, q.role, {extra} coalesce(r.n, 0) AS documents_retrieved, coalesce(x.n, 0) AS documents_after_validation,
      coalesce(r.n, 0) - coalesce(x.n, 0) AS documents_denied, x.n IS NULL AS refused,
      CASE WHEN x.n IS NULL THEN {refusal} END AS refusal, x.context, x.sources, q.query
      FROM questions q LEFT JOIN (SELECT query_id, count(*) AS n FROM hybrid_5 GROUP BY query_id) r USING (query_id)
      LEFT JOIN context x USING (query_id))"""


_PROMPT = f"""{lit(C.USER_PROMPT_HEAD)} || context || {lit(C.USER_PROMPT_MIDDLE)} || query || {lit(C.USER_PROMPT_TAIL)}"""
_SECURE = _answers_sql("ok", lit(C.REFUSAL_TEXT), "")
_COMPLIANT = _answers_sql(
    "ok AND compliant",
    "'No documents available that comply with ' || upper(q.framework) || ' requirements for your access level.'",
    "q.framework,",
)


def _flat_sources(df):
    return df.withColumn(
        "sources",
        F.array_join(
            F.transform("sources", lambda s: F.concat_ws("|", s["id"], s["title"], s["domain"])), ";"
        ),
    )


def _answers(spark, sf_dir, framework=None):
    extra = [framework] if framework else []
    asked = T.questions(spark, sf_dir).select("query_id", "query", "role", *extra)
    return governed.secure_answer_inputs(
        _hybrid(spark, sf_dir, K), T.corpus(spark, sf_dir), asked, framework
    )


@query("secure_answer_inputs", with_views(_GOV, f"""
    SELECT query_id, role, documents_retrieved, documents_after_validation, documents_denied, refused, refusal, sources,
      {_PROMPT} AS user_prompt FROM answers""", _SECURE))
def secure_answer_inputs(spark, sf_dir):
    return _flat_sources(_answers(spark, sf_dir).drop("system_prompt", "query"))


@query("compliance_answer_inputs", with_views(_GOV, f"""
    SELECT query_id, role, framework, documents_retrieved, documents_after_validation, documents_denied, refused, refusal, sources,
      {_PROMPT} AS user_prompt FROM answers""", _COMPLIANT))
def compliance_answer_inputs(spark, sf_dir):
    return _flat_sources(_answers(spark, sf_dir, "framework").drop("system_prompt", "query"))


def _validated(spark, sf_dir):
    asked = T.questions(spark, sf_dir).select("query_id", "query", "role")
    corpus = T.corpus(spark, sf_dir)
    hits = _hits_stored(_hybrid(spark, sf_dir, K).join(asked, "query_id"))
    found = materialize(retrieval.with_documents(hits, corpus, "domain"), "found")
    return access.annotate(
        retrieval.with_documents(access.access_filter(found), corpus, "id", "title", "content")
    )


@query("build_context", with_views(_GOV, """
    SELECT query_id, context AS numbered, (SELECT string_agg('[' || title || ']' || chr(10) || masked || chr(10), chr(10) ORDER BY i)
      FROM numbered n WHERE n.query_id = context.query_id) AS plain FROM context""", _SECURE))
def build_context(spark, sf_dir):
    docs = _validated(spark, sf_dir)
    numbered = retrieval.assemble_context(docs).select("query_id", F.col("context").alias("numbered"))
    plain = retrieval.assemble_context(docs, numbered=False).select("query_id", F.col("context").alias("plain"))
    return numbered.join(plain, "query_id")


@query("extract_sources", with_views(_GOV, """
    SELECT query_id, i AS position, id, title, domain FROM numbered""", _SECURE))
def extract_sources(spark, sf_dir):
    cited = retrieval.assemble_context(_validated(spark, sf_dir)).select("query_id", F.posexplode("sources").alias("at", "s"))
    return cited.select("query_id", (F.col("at") + 1).cast("long").alias("position"), "s.id", "s.title", "s.domain")


@query("assemble_prompt", with_views(_GOV, f"""
    SELECT query_id, {lit(C.SYSTEM_PROMPT)} AS system_prompt, {_PROMPT} AS user_prompt FROM answers WHERE NOT refused""", _SECURE))
def assemble_prompt(spark, sf_dir):
    return _answers(spark, sf_dir).filter(~F.col("refused")).select("query_id", "system_prompt", "user_prompt")


def tool_run(spark, sf_dir):
    asked = T.question_vectors(spark, sf_dir).select(
        "query_id", "conv_id", "query", "username", "session_id", "department_role", "domain", "ts", "micros", "embedding"
    )
    verdicts = T.verdicts(spark, sf_dir).withColumnRenamed("verdict_id", "conv_id")
    return governed.retrieve_and_validate(
        asked,
        lambda questions, n: _hybrid(spark, sf_dir, n, questions=questions),
        T.corpus(spark, sf_dir), verdicts, "conv_id", K, T.PER_MINUTE, T.PER_USER_HOUR,
    )


_TOOL = f"""asked AS (SELECT q.* EXCLUDE (role), coalesce(d_general, 'guest') AS role, epoch_us(ts) AS micros FROM questions q
      LEFT JOIN dep_roles ON d_dep = domain AND d_role = lower(department_role)),
    open AS (SELECT * FROM asked q WHERE EXISTS (SELECT 1 FROM role_access a WHERE a.r_role = q.role AND a.r_domain = q.domain)),
    og AS (SELECT *, count(*) OVER (ORDER BY micros RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS n_global FROM open),
    ou AS (SELECT query_id AS u_id, count(*) OVER (PARTITION BY username ORDER BY micros RANGE BETWEEN 3599999999 PRECEDING
      AND CURRENT ROW) AS n_user FROM og WHERE n_global <= {T.PER_MINUTE}),
    gate AS (SELECT og.*, n_global > {T.PER_MINUTE} AS bg, n_user, coalesce(n_user > {T.PER_USER_HOUR}, false) AS bu,
      coalesce((SELECT max(toxic) FROM labels l WHERE l.doc_id = conv_id), 0) = 1 AS unsafe
      FROM og LEFT JOIN ou ON u_id = query_id),
    safe AS (SELECT * FROM gate WHERE NOT bg AND NOT bu AND NOT unsafe),
    tool_found AS (SELECT h.query_id, h.rank, s.role, s.department_role, s.username, s.session_id, s.ts, s.query,
      s.domain AS wanted, c.id, c.title, c.domain, c.content, bool_or(c.domain = s.domain) OVER (PARTITION BY h.query_id) AS has
      FROM hybrid_10 h JOIN safe s USING (query_id) JOIN corpus c ON c.id = h.item_id),
    in_domain AS (SELECT *, EXISTS (SELECT 1 FROM role_access a WHERE a.r_role = role AND a.r_domain = domain) AS ok
      FROM tool_found WHERE CASE WHEN has THEN domain = wanted ELSE domain = 'public' END)"""
_TOOL_VIEWS = f"{_BOTH} corpus questions role_access dep_roles"


@query("retrieve_and_validate", with_views(_TOOL_VIEWS, f"""
    SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, id, title, domain, role, content,
      CASE WHEN content <> original THEN true END AS pii_masked FROM
      (SELECT * EXCLUDE (content), content AS original, {role_mask()} AS content FROM in_domain WHERE ok)) WHERE rank <= 5""", hybrid(2 * K), _TOOL))
def retrieve_and_validate(spark, sf_dir):
    return tool_run(spark, sf_dir).documents.select(
        "query_id", F.col("rank").cast("long").alias("rank"), "id", "title", "domain", "role", "content", "pii_masked"
    )


_STAMP = "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')"


@query("retrieve_and_validate_audit", with_views(_TOOL_VIEWS, f"""
    SELECT 'access_control' AS event_type, {_STAMP} AS "timestamp", username AS "user", role AS user_role, domain, 'denied' AS decision,
      NULL AS query, NULL::BIGINT AS documents_retrieved, NULL::BIGINT AS documents_validated
    FROM asked WHERE query_id NOT IN (SELECT query_id FROM open)
    UNION ALL SELECT 'access_control', {_STAMP}, username, role, domain, 'denied', NULL, NULL, NULL FROM in_domain WHERE NOT ok
    UNION ALL SELECT 'query', {_STAMP}, username, role, domain, NULL, query, (SELECT count(*) FROM hybrid_10 h WHERE h.query_id = s.query_id),
      (SELECT count(*) FROM in_domain d WHERE d.query_id = s.query_id AND ok) FROM safe s""", hybrid(2 * K), _TOOL))
def retrieve_and_validate_audit(spark, sf_dir):
    out = tool_run(spark, sf_dir).audit
    return out.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


_ALERT_TEXT = "'Access denied: Role ''' || role || ''' attempted to access ''' || domain || ''' domain'"
_FROM_ROLE = "'Role ''' || role || ''' (from department role ''' || department_role || ''') "


@query("retrieve_and_validate_alerts", with_views(_TOOL_VIEWS, f"""
    , v AS (SELECT *, CASE WHEN bg OR bu THEN 'rate_limit_exceeded' ELSE 'toxic_content' END AS kind,
      CASE WHEN bg THEN 'Global rate limit exceeded: ' || n_global || ' requests per minute' ELSE {lit(C.TOXIC_DESCRIPTION)} END AS what
      FROM gate WHERE bg OR (unsafe AND NOT bu))
    SELECT 'access_denied' AS alert_type, 'ACCESS_DENIED' AS type, {_STAMP} AS "timestamp", username AS "user", session_id,
      {_ALERT_TEXT} AS message, {_FROM_ROLE}does not have access to ''' || domain || ''' domain' AS description, 'MEDIUM' AS severity,
      domain, role, substr(query, 1, 200) AS query, NULL AS violation_type FROM asked WHERE query_id NOT IN (SELECT query_id FROM open)
    UNION ALL SELECT 'access_denied', 'ACCESS_DENIED', {_STAMP}, username, session_id, {_ALERT_TEXT},
      {_FROM_ROLE}attempted to access document in ''' || domain || ''' domain', 'MEDIUM', domain, role, substr(query, 1, 200), NULL
      FROM in_domain WHERE NOT ok
    UNION ALL SELECT 'guardrail_' || kind, kind, {_STAMP}, username, session_id, 'Guardrail violation: ' || what, what, 'HIGH', NULL, NULL,
      substr(query, 1, 200), kind FROM v""".lstrip(), hybrid(2 * K), _TOOL))
def retrieve_and_validate_alerts(spark, sf_dir):
    out = tool_run(spark, sf_dir).alerts
    return out.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


# --- routing and task plans ------------------------------------------------------------

# the questions are invented prose, so frequent short words of each language stand in for topics
TOPICS = {
    "finance": [*C.ROUTING_TOPICS["finance"], "the", "and"],
    "hr": [*C.ROUTING_TOPICS["hr"], "le", "et"],
    "health": [*C.ROUTING_TOPICS["health"], "der", "und"],
    "legal": [*C.ROUTING_TOPICS["legal"], "el", "la"],
}


@query("route_query", with_views("questions", f"""
    , topics AS (SELECT * FROM (VALUES {rows([(i, d, w) for i, (d, ws) in enumerate(TOPICS.items()) for w in ws])}) t(pos, topic, word)),
    votes AS (SELECT query_id, topic, pos, count(*) AS n FROM (SELECT query_id,
      unnest(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS word FROM questions) JOIN topics USING (word) GROUP BY ALL),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, pos) AS r FROM votes) WHERE r = 1)
    SELECT query_id, coalesce(topic, 'none') AS routed_domain, coalesce(n, 0) AS votes FROM questions LEFT JOIN best USING (query_id)""".lstrip()))
def route_query(spark, sf_dir):
    asked = T.questions(spark, sf_dir).select("query_id", "query")
    return retrieval.route_queries(asked, rules.routing_topics(spark, TOPICS)).drop("query")


def _plans(spark, sf_dir):
    """Model answers built from the conversations: fenced, bare and broken task lists."""
    conv = F.col("conv_id")
    task = F.struct(
        T.pick([*C.AGENTS, "poet"], conv).alias("agent"),
        F.substring("query", 1, 30).alias("task"),
        F.when(conv % 3 != 0, (conv % 4).cast("int")).alias("priority"),
    )
    second = F.struct(
        T.pick(C.AGENTS, F.col("query_id")).alias("agent"), F.lit("check").alias("task"),
        F.lit(2).alias("priority"),
    )
    body = F.to_json(F.array(task, second))
    response = (
        F.when(conv % 4 == 0, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nDone.")))
        .when(conv % 4 == 1, F.concat(F.lit("```"), body, F.lit("```")))
        .when(conv % 4 == 2, body)
        .otherwise(F.concat(F.lit("I would fetch "), "query"))
    )
    asked = T.questions(spark, sf_dir).select("query_id", "query", response.alias("response"))
    return asked.select("query_id", text.task_plan("response", "query").alias("plan"))


_PLAN_SQL = f"""tasks AS (
    SELECT query_id, 0 AS pos, {words([*C.AGENTS, 'poet'])}[conv_id % 6 + 1] AS agent, substr(query, 1, 30) AS task,
      CASE WHEN conv_id % 3 <> 0 THEN conv_id % 4 END AS priority FROM questions WHERE conv_id % 4 <> 3
    UNION ALL SELECT query_id, 1, {words(C.AGENTS)}[query_id % 5 + 1], 'check', 2 FROM questions WHERE conv_id % 4 <> 3
    UNION ALL SELECT query_id, 0, 'retriever', query, 1 FROM questions WHERE conv_id % 4 = 3)"""


@query("parse_task_plan", with_views("questions", "SELECT * FROM tasks", _PLAN_SQL))
def parse_task_plan(spark, sf_dir):
    plans = _plans(spark, sf_dir).select("query_id", F.posexplode("plan").alias("pos", "t"))
    return plans.select("query_id", "pos", "t.agent", "t.task", "t.priority")


@query("plan_order", with_views("questions", """
    SELECT query_id, agent, task, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(priority, 999), pos) AS step FROM tasks""", _PLAN_SQL))
def plan_order(spark, sf_dir):
    return governed.plan_steps(_plans(spark, sf_dir)).select("query_id", "agent", "task", "step")


_TOOLS = [("retriever", "retrieve_documents"), ("validator", "check_access")]
_TOOLS_SQL = f"tools AS (SELECT * FROM (VALUES {rows(_TOOLS)}) t(agent, tool))"
_KNOWN = f"CASE WHEN agent IN ({', '.join(map(lit, C.AGENTS))}) THEN agent ELSE 'retriever' END"


def _tools(spark):
    return rules.local_table(spark, _TOOLS, "agent", "tool")


@query("task_to_agent", with_views("questions", f"""
    SELECT query_id, pos, t.agent, task, coalesce(priority, 999) AS priority, tool FROM
      (SELECT * EXCLUDE (agent), {_KNOWN} AS agent FROM tasks) t JOIN tools USING (agent)""", _PLAN_SQL, _TOOLS_SQL))
def task_to_agent(spark, sf_dir):
    return governed.assigned_tasks(_plans(spark, sf_dir), _tools(spark))


@query("agent_plan_results", with_views("questions", f"""
    SELECT query_id, agent, tool, task, priority FROM (SELECT query_id, t.agent, tool, task, coalesce(priority, 999) AS priority,
      row_number() OVER (PARTITION BY query_id, t.agent ORDER BY coalesce(priority, 999) DESC, pos DESC) AS r FROM
      (SELECT * EXCLUDE (agent), {_KNOWN} AS agent FROM tasks) t JOIN tools USING (agent)) WHERE r = 1""", _PLAN_SQL, _TOOLS_SQL))
def agent_plan_results(spark, sf_dir):
    return governed.run_task_plan(_plans(spark, sf_dir), _tools(spark))

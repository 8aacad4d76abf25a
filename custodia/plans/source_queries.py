"""Sources, sinks, registered functions and plug-in contracts, by round trip."""

from pyspark.sql import functions as F

from custodia import constants as C
from custodia.functions import masking, plugins
from custodia.functions.once import filter_computed
from custodia.operators import analytics, guardrails
from custodia.plans.log_queries import _alerts, _interactions, sql_stamp, stamp
from custodia.plans.registry import query
from custodia.plans.span_sql import visible_spans
from custodia.plans.sql_views import mask, terms, with_views
from custodia.session import new_path
from custodia.sources import documents, logs
from custodia.sources import tables as T


@query("scan_documents", with_views("corpus", """
    SELECT id::VARCHAR AS id, title, content, domain, author, date::VARCHAR AS date, classification FROM corpus"""))
def scan_documents(spark, sf_dir):
    path = new_path(spark, "documents-json")
    T.corpus(spark, sf_dir).withColumn("id", F.col("id").cast("string")).write.json(path)
    out = documents.scan_documents(spark, path, array_files=False)
    return out.withColumn("date", F.col("date").cast("string"))


def _records(spark, sf_dir):
    found = T.violations(spark, sf_dir).withColumn("ts", F.col("recorded_at"))
    return guardrails.violation_record(found, query="query", data=F.create_map(F.lit("id"), F.col("violation_id")))


@query("scan_violations", with_views("violations", f"""
    SELECT violation_type, severity, description, {sql_stamp('recorded_at')} AS recorded_at, username, query, violation_id
    FROM violations"""))
def scan_violations(spark, sf_dir):
    path = new_path(spark, "violations-json")
    _records(spark, sf_dir).write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)
    log = logs.scan_violations(spark, path, array_files=False)
    return log.select(
        "violation_type", "severity", "description", stamp("recorded_at").alias("recorded_at"),
        "username", "query", F.col("additional_data")["id"].alias("violation_id"),
    )


@query("scan_alerts", with_views("denial_alerts excessive violations", f"""
    SELECT alert_type, {sql_stamp('t')} AS "timestamp", "user", message, severity, denial_count FROM (
      SELECT alert_type, ts AS t, "user", message, severity, NULL::BIGINT AS denial_count FROM denial_alerts UNION ALL
      SELECT alert_type, ts, "user", message, severity, denial_count FROM excessive UNION ALL
      SELECT 'guardrail_' || violation_type, recorded_at, "user", 'Guardrail violation: ' || description, severity, NULL
        FROM violations WHERE severity IN ('CRITICAL', 'HIGH'))"""))
def scan_alerts(spark, sf_dir):
    path = new_path(spark, "alerts-json")
    _alerts(spark, sf_dir).write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)
    log = logs.scan_alerts(spark, path, array_files=False)
    return log.select(
        "alert_type", stamp("timestamp").alias("timestamp"), "user", "message", "severity", "denial_count"
    )


@query("sink_interactions", "SELECT count(*) AS interactions, count(DISTINCT conv_id) AS conversations, "
       "sum(length(text))::BIGINT AS query_chars FROM conversations WHERE role = 'user'")
def sink_interactions(spark, sf_dir):
    path = new_path(spark, "interactions")
    logs.export_interactions(_interactions(spark, sf_dir), path)
    back = spark.read.schema("conv_id long, query string").json(path)
    return back.agg(
        F.count("*").alias("interactions"),
        F.count_distinct("conv_id").alias("conversations"),
        F.sum(F.length("query")).alias("query_chars"),
    )


@query("sink_metrics", with_views("query_metrics", """
    SELECT count(*) AS total_queries, (SELECT least(100, count(*)) FROM query_metrics) AS recent_queries,
      (SELECT count(DISTINCT event_type) FROM requests) AS event_types,
      round(epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6, 3) AS uptime_seconds FROM query_metrics"""))
def sink_metrics(spark, sf_dir):
    path = new_path(spark, "metrics")
    timed = analytics.stage_times(T.query_metrics(spark, sf_dir))
    logs.export_metrics(timed, T.requests(spark, sf_dir), path)

    def part(name, schema, *aggregates):
        return spark.read.schema(schema).json(f"{path}/{name}").agg(*aggregates)

    from custodia.session import union

    parts = union(
        part("system_metrics", "total_queries long", F.max("total_queries").alias("total_queries")),
        part("recent_queries", "query_id long", F.count("query_id").alias("recent_queries")),
        part("security_events", "event_type string", F.count("event_type").alias("event_types")),
        part("uptime", "uptime_seconds double", F.round(F.max("uptime_seconds"), 3).alias("uptime_seconds")),
        allow_missing=True,
    )
    return parts.agg(*[F.max(c).alias(c) for c in parts.columns])


@query("sink_append_log", with_views("violations", """
    SELECT recorded_at::DATE::VARCHAR AS log_date, violation_type, severity, count(*) AS n FROM violations GROUP BY ALL"""))
def sink_append_log(spark, sf_dir):
    path = new_path(spark, "violation-log")
    found = T.violations(spark, sf_dir)
    logs.append_log(found.filter("severity = 'CRITICAL'"), path)
    logs.append_log(found.filter("severity <> 'CRITICAL'"), path)
    back = spark.read.parquet(path)
    return analytics.counts_by(
        back.withColumn("log_date", F.col("log_date").cast("string")), "log_date", "violation_type", "severity"
    )


_LINES = f"""lines AS (
    SELECT request_id AS n, 'ACCESS ' || CASE WHEN allowed THEN 'GRANTED' ELSE 'DENIED' END || ' | User: ' || username
      || ' | Role: ' || role || ' | Domain: ' || domain AS line FROM flagged
    UNION ALL SELECT -1 - id, 'PII DETECTED | Doc: ' || id || ' | Types: ' || replace({terms(values=["License", "the", "Une", "Password"])}, ',', ', ')
      FROM corpus WHERE {terms(values=["License", "the", "Une", "Password"])} IS NOT NULL
    UNION ALL SELECT 1000000000 + conv_id * 100 + turn, 'QUERY | User: user_' || conv_id || ' | Query: '
      || regexp_replace(substr(text, 1, 50), '[\\r\\n]', ' ', 'g') || '... | Docs: ' || (conv_id % 6) || ' | Duration: '
      || printf('%.2f', length(text) / 64.0) || 's' FROM conversations WHERE role = 'user')"""


def _audit_lines(spark, sf_dir):
    from custodia.operators.access import with_access_flag
    from custodia.plans.corpus_queries import EXTRA_TERMS
    from custodia.session import union

    flagged = with_access_flag(T.requests(spark, sf_dir)).select(
        F.col("request_id").alias("n"), "ts",
        logs.access_line(F.col("username"), F.col("role"), F.col("domain"), F.col("allowed")).alias("line"),
    )
    found = masking.sensitive_terms(F.col("content"), EXTRA_TERMS)
    start = F.lit("2024-03-01 00:00:00").cast("timestamp")
    flagged_docs = filter_computed(
        T.corpus(spark, sf_dir).select("id", found.alias("found")), F.col("found").isNotNull()
    )
    pii = flagged_docs.select(
        (F.lit(-1) - F.col("id")).alias("n"), start.alias("ts"),
        logs.pii_line(F.col("id").cast("string"), F.col("found")).alias("line"),
    )
    asked = T.questions(spark, sf_dir).select(
        (F.lit(1000000000) + F.col("query_id")).alias("n"), "ts",
        logs.query_line(
            F.col("username"), F.col("query"), F.col("conv_id") % 6, F.length("query") / 64
        ).alias("line"),
    )
    return union(flagged, pii, asked)


@query("audit_line", with_views("flagged corpus", "SELECT n, line FROM lines", _LINES))
def audit_line(spark, sf_dir):
    return _audit_lines(spark, sf_dir).select("n", "line")


@query("parse_audit_log", with_views("flagged corpus", """
    SELECT kind, count(*) AS n, count(DISTINCT "user") AS users, count_if(status = 'DENIED') AS denied,
      count(DISTINCT doc_id) AS docs, sum(documents)::BIGINT AS documents, round(sum(seconds), 4) AS seconds FROM (
      SELECT CASE WHEN line LIKE 'ACCESS%' THEN 'access' WHEN line LIKE 'PII%' THEN 'pii' ELSE 'query' END AS kind,
        nullif(regexp_extract(line, 'User: ([^|]*) \\|', 1), '') AS "user", regexp_extract(line, '^ACCESS ([A-Z]+)', 1) AS status,
        nullif(regexp_extract(line, 'Doc: ([^|]*) \\|', 1), '') AS doc_id, try_cast(regexp_extract(line, 'Docs: ([0-9]+)', 1) AS BIGINT) AS documents,
        try_cast(regexp_extract(line, 'Duration: ([0-9.]+)s', 1) AS DOUBLE) AS seconds FROM lines) GROUP BY kind""", _LINES))
def parse_audit_log(spark, sf_dir):
    path = new_path(spark, "audit-text")
    lines = _audit_lines(spark, sf_dir).select(logs.log_file_line("ts", F.col("line")).alias("line"))
    logs.write_text_log(lines, path)
    parsed = logs.read_audit_log(spark, path)
    return parsed.groupBy("kind").agg(
        F.count("*").alias("n"),
        F.count_distinct("user").alias("users"),
        F.count_if(F.col("status") == "DENIED").alias("denied"),
        F.count_distinct("doc_id").alias("docs"),
        F.sum("documents").alias("documents"),
        F.round(F.sum("duration_seconds"), 4).alias("seconds"),
    )


@query("register_functions", with_views("corpus", f"""
    SELECT id, {mask('content', C.BASIC_PII)} AS basic, {mask('content', C.ALL_PII)} AS aggressive,
      coalesce({terms()}, '') AS found FROM corpus"""))
def register_functions(spark, sf_dir):
    masking.register_functions(spark)
    return T.corpus(spark, sf_dir).selectExpr(
        "id", "mask_pii_basic(content) AS basic", "mask_pii_aggressive(content) AS aggressive",
        "array_join(detect_sensitive_terms(content), ',') AS found",
    )


@query("rag_functions", with_views("requests dep_roles role_access", """
    SELECT request_id, general_role, EXISTS (SELECT 1 FROM role_access WHERE r_role = general_role AND r_domain = 'finance') AS allowed
    FROM (SELECT request_id, coalesce(d_general, 'guest') AS general_role FROM requests
      LEFT JOIN dep_roles ON d_dep = 'finance' AND d_role = lower(department_role))"""))
def rag_functions(spark, sf_dir):
    tools = plugins.DomainTools("finance")
    return T.requests(spark, sf_dir).transform(tools.check_access).select("request_id", "general_role", "allowed")


def _shape(texts):
    """Stands in for an embedding model: length, words and question marks of each text."""
    return [[len(t), t.count(" ") + 1, t.count("?")] for t in texts]


@query("embedder", with_views("question_vectors", """
    SELECT query_id, len(embedding) AS dim, round(list_sum(embedding), 4) AS total, 3 AS model_dim,
      (length(query) + len(string_split(query, ' ')) + length(query) - length(replace(query, '?', '')))::DOUBLE AS model_total
    FROM question_vectors"""))
def embedder(spark, sf_dir):
    """Both contracts: vectors of a stored table, and of a model that is called on the texts."""
    def total(name):
        return F.aggregate(name, F.lit(0.0), lambda a, x: a + x.cast("double"))

    stored = T.question_vectors(spark, sf_dir).select("query_id", "query", F.col("embedding").alias("stored"))
    both = plugins.with_embeddings(stored, "query", embed=plugins.embedder(_shape))
    return both.select(
        "query_id", F.size("stored").cast("long").alias("dim"), F.round(total("stored"), 4).alias("total"),
        F.size("embedding").cast("long").alias("model_dim"), total("embedding").alias("model_total"),
    )


def _flags(texts):
    """Stands in for a moderation model: flags mentions of a credential."""
    return texts.str.lower().str.contains("password", regex=False)


@query("moderator", """
    SELECT doc_id AS id, contains(lower(text), 'password') AS unsafe,
      CASE WHEN contains(lower(text), 'password') THEN 'toxic_content' END AS violation_type FROM documents""")
def moderator(spark, sf_dir):
    docs = T.corpus(spark, sf_dir).select("id", "content")
    verdicts = plugins.verdict_table(docs, "id", "content", plugins.moderator(_flags))
    judged = guardrails.moderation_gate(docs, verdicts, "id", "verdict_id")
    return judged.select("id", "unsafe", F.when(F.col("unsafe"), C.TOXIC_CONTENT).alias("violation_type"))


@query("entity_recognizer", with_views("corpus", f"""
    SELECT id, count(k) AS entity_count, count(k) FILTER (kind = 'PERSON') AS persons FROM corpus LEFT JOIN
      ({visible_spans('corpus', 'id', 'content', [('PERSON', 0.85, '[A-Z][a-z]+ [A-Z][a-z]+')])}) ON k = id GROUP BY id"""))
def entity_recognizer(spark, sf_dir):
    docs = T.corpus(spark, sf_dir).select("id", F.col("content").alias("response"), F.lit("guest").alias("role"))
    gated = guardrails.pii_output_gate(docs, recognizer=plugins.entity_recognizer(plugins.capitalised_pairs))
    persons = F.size(F.filter("entities", lambda e: e == "PERSON"))
    return gated.select("id", "entity_count", persons.cast("long").alias("persons"))

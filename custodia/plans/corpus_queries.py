"""Redaction, roles and access over the corpus and the request log."""

from pyspark.sql import functions as F

from custodia import constants as C
from custodia import rules
from custodia.functions import masking, plugins, roles, text
from custodia.functions.once import filter_computed
from custodia.operators import access, guardrails
from custodia.functions import entities as E
from custodia.plans.registry import query
from custodia.plans.span_sql import masked, visible_spans
from custodia.plans.sql_views import kinds_of, mask, role_mask, terms, with_views, words
from custodia.plans.sql_views import text as lit
from custodia.sources import tables as T
from custodia.session import union

# words that do occur in the shared documents, besides the rule terms
EXTRA_TERMS = ["License", "the", "Une", "Password"]


def _by_role(spark, sf_dir):
    """Each document once per role."""
    return T.corpus(spark, sf_dir).withColumn("role", F.explode(F.array(*map(F.lit, C.ROLES))))


@query("mask_pii_basic", with_views("corpus", f"SELECT id, {mask('content', C.BASIC_PII)} AS content FROM corpus"))
def mask_pii_basic(spark, sf_dir):
    return masking.mask_column(T.corpus(spark, sf_dir).select("id", "content"))


@query("mask_pii_aggressive", with_views("corpus", f"SELECT id, {mask('content', C.ALL_PII)} AS content FROM corpus"))
def mask_pii_aggressive(spark, sf_dir):
    return masking.mask_column(T.corpus(spark, sf_dir).select("id", "content"), aggressive=True)


@query("mask_pii_by_role", with_views("doc_role", f"""
    SELECT id, role, domain, masked AS content, CASE WHEN masked <> content THEN true END AS pii_masked
    FROM (SELECT *, {role_mask()} AS masked FROM doc_role)"""))
def mask_pii_by_role(spark, sf_dir):
    docs = _by_role(spark, sf_dir).select("id", "role", "domain", "content")
    return masking.mask_by_role(docs)


@query("mask_pii_for_role", with_views("corpus dep_roles", f"""
    SELECT id, department_role, CASE WHEN coalesce(d_general, 'guest') IN ('admin', 'analyst')
      THEN {mask('content', C.BASIC_PII)} ELSE {mask('content', C.ALL_PII)} END AS content
    FROM (SELECT *, {words(T.DEPARTMENT_ROLE_NAMES)}[(id % 7) + 1] AS department_role FROM corpus) c
    LEFT JOIN dep_roles ON d_dep = domain AND d_role = lower(department_role)"""))
def mask_pii_for_role(spark, sf_dir):
    docs = T.corpus(spark, sf_dir).withColumn("department_role", T.pick(T.DEPARTMENT_ROLE_NAMES, F.col("id")))
    with_role = roles.with_general_role(docs, "domain")
    few = F.col("general_role").isin("admin", "analyst")
    masked = masking.mask_where(
        with_role, "content",
        lambda name: F.lit(True) if name in C.BASIC_PII else ~few,
    )
    return masked.select("id", "department_role", "content")


@query("detect_sensitive_terms", with_views("corpus", f"""
    SELECT id, {terms()} AS rule_terms, {terms(values=EXTRA_TERMS)} AS extra_terms FROM corpus"""))
def detect_sensitive_terms(spark, sf_dir):
    content = F.col("content")
    return T.corpus(spark, sf_dir).select(
        "id",
        F.array_join(masking.sensitive_terms(content), ",").alias("rule_terms"),
        F.array_join(masking.sensitive_terms(content, EXTRA_TERMS), ",").alias("extra_terms"),
    )


@query("vector_metadata", with_views("vectors", """
    SELECT id || '_' || namespace AS vector_id, id, substr(title, 1, 500) AS title, domain, classification,
      substr(author, 1, 200) AS author, date::VARCHAR AS date, substr(content, 1, 1000) AS content_preview,
      length(content) AS content_length FROM vectors"""))
def vector_metadata(spark, sf_dir):
    content = T.corpus(spark, sf_dir).select("id", "content")
    docs = T.vectors(spark, sf_dir).join(content, "id")
    return docs.select(text.vector_key().alias("vector_id"), "id", *text.vector_metadata())


@query("response_preview", """
    SELECT conv_id, turn, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS response_preview,
      substr(text, 1, 200) AS alert_query FROM conversations""")
def response_preview(spark, sf_dir):
    return T.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", text.preview("text").alias("response_preview"), text.cut("text").alias("alert_query")
    )


@query("request_fingerprint", with_views("requests", """
    SELECT request_id, md5('{"function":"answer","kwargs":{"kind":' || to_json(event_type) || ',"query":'
      || to_json(query) || ',"role":' || to_json(role) || '}}') AS fingerprint FROM requests"""))
def request_fingerprint(spark, sf_dir):
    return T.requests(spark, sf_dir).select(
        "request_id",
        text.fingerprint("answer", role="role", query="query", kind="event_type").alias("fingerprint"),
    )


@query("map_department_role", with_views("requests dep_roles", """
    SELECT request_id, department, department_role, coalesce(d_general, 'guest') AS general_role FROM requests
    LEFT JOIN dep_roles ON d_dep = department AND d_role = lower(department_role)"""))
def map_department_role(spark, sf_dir):
    return roles.with_general_role(T.requests(spark, sf_dir)).select(
        "request_id", "department", "department_role", "general_role"
    )


_ROLE_TEXT = "CASE g " + " ".join(
    f"WHEN {lit(r)} THEN {lit(d)}" for r, d in C.ROLE_DESCRIPTIONS.items()
) + f" ELSE {lit(C.DEFAULT_ROLE_DESCRIPTION)} END"


_ROLE_LINES = f"""lines AS (SELECT d_dep, string_agg(d_role, ',' ORDER BY d_pos) AS roles,
      string_agg('     - `' || d_role || '` - Maps to ' || g || ' role (' || {_ROLE_TEXT} || ')', chr(10) ORDER BY d_pos)
      AS options FROM (SELECT *, d_general AS g FROM dep_roles) GROUP BY d_dep)"""


@query("describe_roles", with_views("requests dep_roles", f"""
    SELECT department, department_role, count(*) AS requests, {_ROLE_TEXT} AS description, roles, options
    FROM (SELECT q.*, coalesce(d.d_general, 'guest') AS g FROM requests q LEFT JOIN dep_roles d
      ON d.d_dep = q.department AND d.d_role = lower(q.department_role))
    JOIN lines ON lines.d_dep = department GROUP BY department, department_role, g, roles, options""", _ROLE_LINES))
def describe_roles(spark, sf_dir):
    options = roles.department_options(spark).select(
        "department", F.array_join("roles", ",").alias("roles"), "options"
    )
    used = (
        roles.with_general_role(T.requests(spark, sf_dir))
        .groupBy("department", "department_role", "general_role")
        .agg(F.count("*").alias("requests"))
    )
    return used.join(F.broadcast(options), "department").select(
        "department", "department_role", "requests",
        roles.role_description("general_role").alias("description"), "roles", "options",
    )


_RULE_LISTS = """allowed_list AS (SELECT r_role, string_agg(r_domain, ', ' ORDER BY domain_pos) AS allowed_domains
      FROM role_access GROUP BY r_role),
    alternatives AS (SELECT r_domain, string_agg(r_role, ', ' ORDER BY role_pos) AS alternative_roles
      FROM role_access GROUP BY r_domain)"""


@query("explain_access", with_views("flagged", """
    SELECT request_id, CASE WHEN allowed THEN 'Access GRANTED: Role ''' || role || ''' has access to ''' || domain || ''' domain.'
      ELSE 'Access DENIED: Role ''' || role || ''' cannot access ''' || domain || ''' domain. Your role allows: '
      || allowed_domains || '. To access this domain, you need one of: ' || alternative_roles END AS explanation
    FROM flagged q JOIN allowed_list a ON a.r_role = q.role JOIN alternatives b ON b.r_domain = q.domain""", _RULE_LISTS))
def explain_access(spark, sf_dir):
    return roles.explain_access(T.requests(spark, sf_dir)).select("request_id", "explanation")


_DENIED_TEXT = """'Access DENIED for query: ''' || query || '''' || chr(10) || 'Your role ''' || role
      || ''' can only access: ' || allowed_domains || chr(10) || 'To access ' || domain || ' domain, you need: '
      || alternative_roles"""


@query("explain_denied_query", with_views("denials", f"""
    SELECT request_id, {_DENIED_TEXT} AS explanation
    FROM denials q JOIN allowed_list a ON a.r_role = q.role JOIN alternatives b ON b.r_domain = q.domain""", _RULE_LISTS))
def explain_denied_query(spark, sf_dir):
    return roles.explain_denied_query(T.denials(spark, sf_dir)).select("request_id", "explanation")


_RETRIEVAL_TEXT = """'Query: ''' || query || '''' || chr(10) || 'Found ' || documents_retrieved || ' documents, validated '
      || documents_validated || ', denied ' || (documents_retrieved - documents_validated)
      || ' based on your role permissions.'"""


@query("explain_retrieval", with_views("query_metrics", f"SELECT query_id, {_RETRIEVAL_TEXT} AS explanation FROM query_metrics"))
def explain_retrieval(spark, sf_dir):
    return T.query_metrics(spark, sf_dir).select(
        "query_id",
        roles.explain_retrieval("query", "documents_retrieved", "documents_validated").alias("explanation"),
    )


@query("explain_decision", with_views("query_metrics requests role_access", f"""
    SELECT query_id, CASE kind WHEN 'access' THEN {_DENIED_TEXT} WHEN 'retrieval' THEN {_RETRIEVAL_TEXT}
      ELSE 'Decision explanation for ' || kind END AS explanation
    FROM (SELECT m.query_id, m.query, r.role, r.domain, m.documents_retrieved, m.documents_validated,
        CASE r.event_type WHEN 'view' THEN 'access' WHEN 'click' THEN 'retrieval' ELSE r.event_type END AS kind
      FROM query_metrics m JOIN requests r ON r.request_id = m.query_id) q
    JOIN allowed_list a ON a.r_role = q.role JOIN alternatives b ON b.r_domain = q.domain""", _RULE_LISTS))
def explain_decision(spark, sf_dir):
    kind = F.col("event_type")
    asked = T.requests(spark, sf_dir).select(
        F.col("request_id").alias("query_id"), "role", "domain",
        F.when(kind == "view", "access").when(kind == "click", "retrieval").otherwise(kind).alias("decision_type"),
    )
    rows = T.query_metrics(spark, sf_dir).join(asked, "query_id")
    return roles.explain_decision(
        rows, found="documents_retrieved", shown="documents_validated"
    ).select("query_id", "explanation")


@query("access_filter", with_views("doc_role role_access", """
    SELECT id, role, domain FROM doc_role d WHERE EXISTS
      (SELECT 1 FROM role_access a WHERE a.r_role = d.role AND a.r_domain = d.domain)"""))
def access_filter(spark, sf_dir):
    return access.access_filter(_by_role(spark, sf_dir)).select("id", "role", "domain")


@query("access_denied", with_views("doc_role role_access", """
    SELECT id, role, domain, 'access_control' AS event_type, 'denied' AS decision,
      'Role ''' || role || ''' cannot access ''' || domain || '''' AS reason FROM doc_role d WHERE NOT EXISTS
      (SELECT 1 FROM role_access a WHERE a.r_role = d.role AND a.r_domain = d.domain)"""))
def access_denied(spark, sf_dir):
    return access.access_denied(_by_role(spark, sf_dir)).select(
        "id", "role", "domain",
        F.lit("access_control").alias("event_type"),
        F.lit("denied").alias("decision"),
        F.concat(F.lit("Role '"), "role", F.lit("' cannot access '"), "domain", F.lit("'")).alias("reason"),
    )


@query("check_access", with_views("requests dep_roles role_access", """
    SELECT request_id, g AS general_role, ok AS allowed, CASE WHEN ok THEN 'granted' ELSE 'denied' END AS decision,
      CASE WHEN NOT ok THEN 'Role ''' || g || ''' (from department role ''' || department_role
        || ''') does not have access to ''' || domain || ''' domain' END AS reason
    FROM (SELECT *, EXISTS (SELECT 1 FROM role_access a WHERE a.r_role = g AND a.r_domain = domain) AS ok
      FROM (SELECT q.*, coalesce(d.d_general, 'guest') AS g FROM requests q LEFT JOIN dep_roles d
        ON d.d_dep = q.domain AND d.d_role = lower(q.department_role)))"""))
def check_access(spark, sf_dir):
    asked = roles.with_general_role(T.requests(spark, sf_dir), "domain")
    flagged = access.with_access_flag(asked, "general_role")
    reason = F.concat(
        F.lit("Role '"), "general_role", F.lit("' (from department role '"), "department_role",
        F.lit("') does not have access to '"), "domain", F.lit("' domain"),
    )
    return flagged.select(
        "request_id", "general_role", "allowed",
        F.when(F.col("allowed"), "granted").otherwise("denied").alias("decision"),
        F.when(~F.col("allowed"), reason).alias("reason"),
    )


_VALIDATED = f"""SELECT id, role, domain, CASE WHEN masked <> content THEN true END AS pii_masked, masked AS content,
      {terms(values=EXTRA_TERMS)} AS sensitive_terms, true AS validated, '1.0' AS validator_version"""


@query("validate_documents", with_views("doc_role role_access", f"""{_VALIDATED}
    FROM (SELECT *, {role_mask()} AS masked FROM doc_role d WHERE EXISTS
      (SELECT 1 FROM role_access a WHERE a.r_role = d.role AND a.r_domain = d.domain))"""))
def validate_documents(spark, sf_dir):
    docs = _by_role(spark, sf_dir).select("id", "role", "domain", "content")
    return _flat(access.validate_documents(docs, terms=EXTRA_TERMS))


def _flat(validated):
    return validated.withColumn(
        "sensitive_terms", F.array_join("sensitive_terms_detected", ",")
    ).drop("sensitive_terms_detected")


@query("batch_validate", with_views("doc_role role_access", """
    SELECT role, count(*) AS documents_retrieved, count_if(ok) AS documents_validated,
      count_if(NOT ok) AS documents_denied
    FROM (SELECT *, EXISTS (SELECT 1 FROM role_access a WHERE a.r_role = d.role AND a.r_domain = d.domain) AS ok
      FROM doc_role d) GROUP BY role"""))
def batch_validate(spark, sf_dir):
    return access.validation_counts(_by_role(spark, sf_dir), ["role"])


@query("compliance_filter", with_views("doc_role role_access fw_domains", f"""{_VALIDATED}, framework
    FROM (SELECT *, {role_mask()} AS masked FROM (SELECT *, {words(T.REQUESTED_FRAMEWORKS)}[(id // 5) % 5 + 1] AS framework
      FROM doc_role) d WHERE EXISTS (SELECT 1 FROM role_access a WHERE a.r_role = d.role AND a.r_domain = d.domain)
      AND EXISTS (SELECT 1 FROM fw_domains f WHERE f_domain = d.domain AND f_fw =
        CASE WHEN d.framework IN ('hipaa', 'gdpr', 'sox') THEN d.framework ELSE 'general' END))"""))
def compliance_filter(spark, sf_dir):
    docs = (
        _by_role(spark, sf_dir)
        .select("id", "role", "domain", "content")
        .withColumn("framework", T.pick(T.REQUESTED_FRAMEWORKS, F.floor(F.col("id") / 5)))
    )
    return _flat(access.compliance_filter(docs, terms=EXTRA_TERMS))


@query("role_domain_join", with_views("corpus role_access", """
    SELECT r_role AS role, domain, count(*) AS documents FROM corpus JOIN role_access ON r_domain = domain
    GROUP BY r_role, domain"""))
def role_domain_join(spark, sf_dir):
    pairs = rules.role_access(spark).select("role", "domain")
    per_domain = T.corpus(spark, sf_dir).groupBy("domain").agg(F.count("*").alias("documents"))
    return per_domain.join(pairs, "domain").select("role", "domain", "documents")


@query("alternative_roles", with_views("denials role_access", """
    SELECT domain, denied_requests, alternative_roles FROM (SELECT domain, count(*) AS denied_requests
      FROM denials GROUP BY domain) JOIN (SELECT r_domain, string_agg(r_role, ',' ORDER BY role_pos)
      AS alternative_roles FROM role_access GROUP BY r_domain) ON r_domain = domain"""))
def alternative_roles(spark, sf_dir):
    refused = T.denials(spark, sf_dir).groupBy("domain").agg(F.count("*").alias("denied_requests"))
    others = rules.roles_by_domain(spark)
    return refused.join(others, "domain").select(
        "domain", "denied_requests", F.array_join("roles", ",").alias("alternative_roles")
    )


_RESPONSES = """responses AS (SELECT conv_id * 100 + turn AS rid, conv_id, text AS response,
      CASE conv_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'visitor' ELSE ['admin','analyst','manager','employee','guest'][(conv_id % 5) + 1] END
      AS role FROM conversations WHERE role = 'assistant'
      UNION ALL SELECT -1 - doc_id, doc_id, text, ['admin','analyst','manager','employee','guest'][((doc_id // 2) % 5) + 1]
      FROM documents)"""


def _responses(spark, sf_dir):
    conv = F.col("conv_id")
    turns = T.table(spark, sf_dir, "conversations").filter("role = 'assistant'").select(
        (conv * 100 + F.col("turn")).alias("rid"), "conv_id", F.col("text").alias("response"),
        F.when(conv % 7 == 1, "visitor").when(conv % 7 > 1, T.pick(C.ROLES, conv)).alias("role"),
    )
    doc = F.col("doc_id")
    docs = T.table(spark, sf_dir, "documents").select(
        (F.lit(-1) - doc).alias("rid"), doc.alias("conv_id"), F.col("text").alias("response"),
        T.pick(C.ROLES, F.floor(doc / 2)).alias("role"),
    )
    return union(turns, docs)


_GATED = f"""found_spans AS ({visible_spans('responses', 'rid', 'response')}),
    gated AS (SELECT r.*, CASE WHEN role IN ('admin', 'analyst') THEN [] ELSE coalesce(f.found, []) END AS found,
      coalesce((SELECT max(toxic) FROM labels l WHERE l.doc_id = conv_id), 0) = 1 AS unsafe
      FROM responses r LEFT JOIN {kinds_of('found_spans')} f ON f.k = rid)"""


@query("pii_output_gate", f"""WITH {_RESPONSES}, {_GATED}
    SELECT rid, role, nullif(array_to_string(list_sort(found), ','), '') AS entities, len(found) AS entity_count,
      len(found) > 0 AS blocked_pii FROM gated""")
def pii_output_gate(spark, sf_dir):
    gated = guardrails.pii_output_gate(_responses(spark, sf_dir))
    joined = F.array_join(F.array_sort("entities"), ",")
    return gated.select(
        "rid", "role", F.when(joined != "", joined).alias("entities"), "entity_count", "blocked_pii"
    )


@query("distinct_entities", f"""WITH {_RESPONSES}, {_GATED}
    SELECT rid, array_to_string(list_sort(list_distinct(found)), ',') AS kinds, len(list_distinct(found)) AS n_kinds
    FROM gated WHERE len(found) > 0""")
def distinct_entities(spark, sf_dir):
    gated = guardrails.pii_output_gate(_responses(spark, sf_dir))
    gated = filter_computed(gated, F.col("blocked_pii"))
    return gated.select(
        "rid", F.array_join("entity_kinds", ",").alias("kinds"), F.size("entity_kinds").cast("long").alias("n_kinds")
    )


_OUTPUT = """CASE WHEN len(found) > 0 THEN 'pii_detected' WHEN unsafe THEN 'toxic_content' END AS violation_type,
      CASE WHEN len(found) > 0 THEN 'CRITICAL' WHEN unsafe THEN 'HIGH' END AS severity,
      NOT (len(found) > 0 OR unsafe) AS is_safe"""
_OUTPUT_TEXT = f"""CASE WHEN len(found) > 0 THEN 'PII detected: ' || array_to_string(list_sort(list_distinct(found)), ', ')
      WHEN unsafe THEN {lit(C.TOXIC_DESCRIPTION)} END"""


@query("output_gate", f"""WITH {_RESPONSES}, {_GATED} SELECT rid, {_OUTPUT}, {_OUTPUT_TEXT} AS description FROM gated""")
def output_gate(spark, sf_dir):
    gated = guardrails.output_gate(_responses(spark, sf_dir), T.verdicts(spark, sf_dir), "conv_id", "verdict_id")
    return gated.select("rid", "violation_type", "severity", "is_safe", "description")


_NAMES = ("PERSON", 0.85, "[A-Z][a-z]+ [A-Z][a-z]+")
_MARKED = """marked AS (SELECT id, content || ' (DE89 3704 0044 0532 0130 00) card 3782 822463 10005 ' || id || ', ' || id
      || '.20.30.40@mail' || id || '.example' AS content FROM corpus)"""


def _marked(spark, sf_dir):
    """The corpus, each text with a line of a reference, a card and an address made of its id."""
    number = F.col("id").cast("string")
    line = F.concat(F.col("content"), F.lit(" (DE89 3704 0044 0532 0130 00) card 3782 822463 10005 "), number, F.lit(", "), number,
                    F.lit(".20.30.40@mail"), number, F.lit(".example"))
    return T.corpus(spark, sf_dir).select("id", line.alias("content"))


@query("mask_entities", with_views("corpus", f"""SELECT k AS id, masked AS content FROM
    ({masked('marked', 'id', 'content', 'found')})""", _MARKED, f"found AS ({visible_spans('marked', 'id', 'content')})"))
def mask_entities(spark, sf_dir):
    return E.mask_entities(_marked(spark, sf_dir))


@query("entity_spans", with_views("corpus", f"""SELECT k AS id, s::INT AS start, e::INT AS "end", kind AS entity FROM
    ({visible_spans('marked', 'id', 'content')})""", _MARKED))
def entity_spans(spark, sf_dir):
    """Every finding with its place; an address hides the numbers inside it."""
    return E.span_table(_marked(spark, sf_dir), "id").select("id", "start", "end", "entity")


@query("entity_table", with_views("corpus", f"""SELECT k AS id, s::INT AS start, e::INT AS "end", kind AS entity FROM
    ({visible_spans('marked', 'id', 'content', [_NAMES])})""", _MARKED))
def entity_table(spark, sf_dir):
    """The spans of rules and a model by a SQL call of the table function."""
    plugins.register_entity_table(spark, plugins.capitalised_pairs)
    return spark.sql(
        "SELECT id, s.start, s.end, s.entity FROM {docs}, LATERAL entity_spans(content) AS s",
        docs=_marked(spark, sf_dir))


@query("mask_recognized", with_views("corpus", f"""SELECT k AS id, masked AS content FROM
    ({masked('marked', 'id', 'content', 'found')})""", _MARKED,
    f"found AS ({visible_spans('marked', 'id', 'content', [_NAMES])})"))
def mask_recognized(spark, sf_dir):
    """What rules and a model find, masked together."""
    return E.mask_entities(_marked(spark, sf_dir), recognizer=plugins.entity_recognizer(plugins.capitalised_pairs))

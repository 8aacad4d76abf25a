"""The same views as ``sources.tables`` in SQL, for side-by-side checks."""

from custodia import constants as C
from custodia.plans.span_sql import visible_spans
from custodia.sources import tables as T


def text(value):
    return "'" + str(value).replace("'", "''") + "'"


def words(values):
    return "[" + ", ".join(map(text, values)) + "]"


def pick(values, number):
    n = len(values)
    return f"{words(values)}[((({number}) % {n} + {n}) % {n}) + 1]"


def rows(values):
    return ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else text(v) for v in r) + ")" for r in values)


def mask(column, names):
    out = column
    for name, pattern, tag in C.PII_PATTERNS:
        if name in names:
            out = f"regexp_replace({out}, {text(pattern)}, {text(tag)}, 'g')"
    return out


ROLE_ACCESS_ROWS = [
    (role, rp, domain, dp)
    for rp, (role, domains) in enumerate(C.ROLE_ACCESS.items())
    for dp, domain in enumerate(domains)
]
DEPARTMENT_ROWS = [
    (dep, pos, name, general)
    for dep, m in C.DEPARTMENT_ROLES.items()
    for pos, (name, general) in enumerate(m.items())
]
FRAMEWORK_ROWS = [(fw, d) for fw, ds in C.FRAMEWORK_DOMAINS.items() for d in ds]


def role_mask(content="content", role="role", domain="domain"):
    return f"""CASE WHEN {role} = 'admin' THEN {mask(content, C.BASIC_PII)}
      WHEN {role} = 'analyst' AND {domain} IN ('finance', 'hr') THEN {mask(content, ['ssn', 'ssn_no_dash', 'credit_card'])}
      WHEN {role} = 'manager' AND {domain} = 'hr' THEN {mask(content, ['ssn', 'ssn_no_dash', 'credit_card', 'salary'])}
      ELSE {mask(content, C.ALL_PII)} END"""


def terms(content="content", values=None):
    cases = ", ".join(
        f"CASE WHEN contains(lower({content}), {text(t.lower())}) THEN {text(t)} END"
        for t in values or C.SENSITIVE_TERMS
    )
    return f"nullif(array_to_string([{cases}], ','), '')"


def kinds_of(spans):
    """(k, found): the kinds of each key's spans, as a list."""
    return f"(SELECT k, list(kind) AS found FROM {spans} GROUP BY k)"


VIEWS = {
    "role_access": f"SELECT * FROM (VALUES {rows(ROLE_ACCESS_ROWS)}) t(r_role, role_pos, r_domain, domain_pos)",
    "dep_roles": f"SELECT * FROM (VALUES {rows(DEPARTMENT_ROWS)}) t(d_dep, d_pos, d_role, d_general)",
    "fw_domains": f"SELECT * FROM (VALUES {rows(FRAMEWORK_ROWS)}) t(f_fw, f_domain)",
    "corpus": f"""SELECT doc_id AS id, 'Document ' || doc_id AS title, text AS content,
        {pick(T.DOMAINS, 'doc_id')} AS domain, {pick(T.CLASSIFICATIONS, 'doc_id')} AS classification,
        source AS author, DATE '2024-01-01' + (doc_id % 365)::INT AS date FROM documents""",
    "roles5": f"SELECT unnest({words(C.ROLES)}) AS role",
    "doc_role": "SELECT c.*, r.role FROM corpus c, roles5 r",
    "requests": f"""SELECT event_id AS request_id, ts, epoch_us(ts) AS micros, coalesce(user_id, -1) AS user_id,
        'user_' || coalesce(user_id, -1) AS username, 's' || coalesce(user_id, -1) AS session_id,
        {pick(C.ROLES, 'coalesce(user_id, -1)')} AS role, {pick(T.DOMAINS, 'event_id')} AS domain,
        {pick(T.DEPARTMENTS, 'event_id')} AS department,
        {pick(T.DEPARTMENT_ROLE_NAMES, 'coalesce(user_id, -1)')} AS department_role,
        event_type, props AS query, value AS latency_ms, event_type <> 'error' AS success FROM events""",
    "flagged": """SELECT q.*, EXISTS (SELECT 1 FROM role_access a WHERE a.r_role = q.role AND a.r_domain = q.domain)
        AS allowed FROM requests q""",
    "denials": """SELECT * EXCLUDE (allowed), CASE WHEN event_type = 'click' THEN 'policy' END AS reason
        FROM flagged WHERE NOT allowed""",
    "query_metrics": """SELECT request_id AS query_id, ts, query, success, username AS "user", role AS user_role,
        latency_ms / 1000 AS retrieval_time, latency_ms / 1000 / 4 AS validation_time,
        latency_ms / 1000 * 2 AS generation_time, 5::BIGINT AS documents_retrieved,
        5 - (user_id % 3 + 3) % 3 AS documents_validated, (user_id % 3 + 3) % 3 AS documents_denied,
        (latency_ms / 1000 + latency_ms / 1000 / 4 + latency_ms / 1000 * 2) * 1000 AS total_time_ms
        FROM requests""",
    "questions": f"""SELECT conv_id * 100 + turn AS query_id, conv_id, text AS query, 'user_' || conv_id AS username,
        's' || conv_id AS session_id, {pick(C.ROLES, 'conv_id')} AS role,
        {pick(T.DOMAINS, 'conv_id + turn')} AS domain,
        {pick(T.DEPARTMENT_ROLE_NAMES, 'conv_id')} AS department_role,
        {pick(T.REQUESTED_FRAMEWORKS, 'conv_id')} AS framework,
        make_timestamp((1704067200 + (conv_id * 100 + turn) * 10) * 1000000) AS ts
        FROM conversations WHERE role = 'user'""",
    "vectors": """SELECT e.vec_id AS id, e.embedding::DOUBLE[] AS embedding, 'ns' || (e.label % 2) AS namespace,
        c.title, c.domain, c.classification, c.author, c.date, c.content
        FROM embeddings e JOIN corpus c ON c.id = e.vec_id""",
    "question_vectors": """SELECT q.*, e.embedding::DOUBLE[] AS embedding FROM questions q
        JOIN embeddings e ON e.vec_id = q.query_id % (SELECT count(*) FROM embeddings)""",
    "rate_global": """SELECT *, count(*) OVER (ORDER BY micros RANGE BETWEEN 59999999 PRECEDING
        AND CURRENT ROW) AS n_global FROM requests""",
    "rate_user": f"""SELECT request_id AS u_id, count(*) OVER (PARTITION BY username ORDER BY micros
        RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS n_user
        FROM rate_global WHERE n_global <= {T.PER_MINUTE}""",
    "limited": f"""SELECT g.*, g.n_global > {T.PER_MINUTE} AS blocked_global, u.n_user,
        u.n_user > {T.PER_USER_HOUR} AS blocked_user
        FROM rate_global g LEFT JOIN rate_user u ON u.u_id = g.request_id""",
    "rate_violations": f"""SELECT *, '{C.RATE_LIMIT_EXCEEDED}' AS violation_type,
        CASE WHEN blocked_global THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
        CASE WHEN blocked_global THEN 'Global rate limit exceeded: ' || n_global || ' requests per minute'
        ELSE 'User rate limit exceeded: ' || n_user || ' requests per hour' END AS description
        FROM limited WHERE blocked_global OR coalesce(blocked_user, false)""",
    "doc_spans": visible_spans("corpus", "id", "content"),
    "doc_verdicts": f"""SELECT c.id, c.author AS username, c.content, coalesce(f.found, []) AS found,
        coalesce((SELECT max(toxic) FROM labels l WHERE l.doc_id = c.id), 0) = 1 AS unsafe
        FROM corpus c LEFT JOIN {kinds_of('doc_spans')} f ON f.k = c.id""",
    "doc_violations": f"""SELECT id, username,
        CASE WHEN len(found) > 0 THEN '{C.PII_DETECTED}' ELSE '{C.TOXIC_CONTENT}' END AS violation_type,
        CASE WHEN len(found) > 0 THEN 'CRITICAL' ELSE 'HIGH' END AS severity,
        CASE WHEN len(found) > 0 THEN 'PII detected: ' || array_to_string(list_sort(list_distinct(found)), ', ')
        ELSE {text(C.TOXIC_DESCRIPTION)} END AS description,
        make_timestamp((1704067200 + id * 60) * 1000000) AS ts
        FROM doc_verdicts WHERE len(found) > 0 OR unsafe""",
    "violations": """SELECT 'r' || request_id AS violation_id, violation_type, severity, description,
        ts AS recorded_at, username AS "user", username, session_id, query, query AS user_message
        FROM rate_violations UNION ALL
        SELECT 'd' || id, violation_type, severity, description, ts, username, username, NULL, NULL, NULL
        FROM doc_violations""",
    "denial_alerts": """SELECT 'access_denied' AS alert_type, 'ACCESS_DENIED' AS type, ts, request_id,
        username AS "user", session_id,
        'Access denied: Role ''' || role || ''' attempted to access ''' || domain || ''' domain' AS message,
        coalesce(reason, 'Access denied for role ''' || role || ''' to domain ''' || domain || '''') AS description,
        'MEDIUM' AS severity, domain, role, substr(query, 1, 200) AS query FROM denials""",
    "denial_counts": """SELECT *, count(*) OVER (PARTITION BY username ORDER BY micros
        RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS n FROM denials""",
    "excessive": f"""SELECT 'excessive_denials' AS alert_type, 'EXCESSIVE_DENIALS' AS type, ts, request_id,
        username AS "user", session_id, 'Excessive access denials detected: ' || n || ' denials in last hour' AS message,
        n || ' denials in last hour for user ' || username AS description, 'HIGH' AS severity, n AS denial_count
        FROM denial_counts WHERE n >= {T.DENIALS_PER_HOUR}""",
    # keyword index
    "doc_tokens": f"""SELECT id, list_filter(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
        lambda w: NOT list_contains({words(C.STOP_WORDS)}, w)) AS w FROM corpus""",
    "q_tokens": f"""SELECT query_id, list_filter(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
        lambda w: NOT list_contains({words(C.STOP_WORDS)}, w)) AS w FROM questions""",
    "doc_tf": """SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(list_concat(w,
        list_transform(range(1, greatest(len(w), 1)::BIGINT), lambda i: w[i] || ' ' || w[i + 1]))) AS term
        FROM doc_tokens) GROUP BY ALL""",
    "q_tf": """SELECT query_id, term, count(*) AS tf FROM (SELECT query_id, unnest(list_concat(w,
        list_transform(range(1, greatest(len(w), 1)::BIGINT), lambda i: w[i] || ' ' || w[i + 1]))) AS term
        FROM q_tokens) GROUP BY ALL""",
    "vocab": """SELECT term, sum(tf)::BIGINT AS cf, count(*) AS df,
        ln((1.0::DOUBLE + (SELECT count(*) FROM corpus)) / (1.0::DOUBLE + count(*))) + 1.0::DOUBLE AS idf
        FROM doc_tf GROUP BY term HAVING count(*) <= 0.95::DOUBLE * (SELECT count(*) FROM corpus)
        ORDER BY cf DESC, term LIMIT 1000""",
    "doc_w": """SELECT id, term, tf * idf / sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY id)) AS w
        FROM doc_tf JOIN vocab USING (term)""",
    "q_w": """SELECT query_id, term, tf * idf / sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY query_id)) AS w
        FROM q_tf JOIN vocab USING (term)""",
    "kw_scores": """SELECT query_id, id AS item_id, round(sum(q_w.w * doc_w.w), 9) AS score
        FROM q_w JOIN doc_w USING (term) GROUP BY ALL""",
    "kw_ranked": """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank
        FROM kw_scores WHERE score > 0""",
    "cos_scores": """SELECT q.query_id, v.id AS item_id, round(list_inner_product(q.embedding, v.embedding)
        / sqrt(list_inner_product(q.embedding, q.embedding)) / sqrt(list_inner_product(v.embedding, v.embedding)), 9)
        AS score, v.namespace, v.domain FROM question_vectors q, vectors v""",
    "cos_ranked": """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank
        FROM cos_scores""",
    "l2_ranked": """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM
        (SELECT q.query_id, v.id AS item_id, round(-list_sum(list_transform(list_zip(q.embedding, v.embedding),
        lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9) AS score FROM question_vectors q, vectors v)""",
}

_NEEDS = {
    "doc_role": ["corpus", "roles5"],
    "flagged": ["requests", "role_access"],
    "denials": ["flagged"],
    "query_metrics": ["requests"],
    "vectors": ["corpus"],
    "question_vectors": ["questions"],
    "rate_global": ["requests"],
    "rate_user": ["rate_global"],
    "limited": ["rate_user"],
    "rate_violations": ["limited"],
    "doc_spans": ["corpus"],
    "doc_verdicts": ["doc_spans"],
    "doc_violations": ["doc_verdicts"],
    "violations": ["rate_violations", "doc_violations"],
    "denial_alerts": ["denials"],
    "denial_counts": ["denials"],
    "excessive": ["denial_counts"],
    "doc_tokens": ["corpus"],
    "q_tokens": ["questions"],
    "doc_tf": ["doc_tokens"],
    "q_tf": ["q_tokens"],
    "vocab": ["doc_tf", "corpus"],
    "doc_w": ["vocab"],
    "q_w": ["q_tf", "vocab"],
    "kw_scores": ["q_w", "doc_w"],
    "kw_ranked": ["kw_scores"],
    "cos_scores": ["question_vectors", "vectors"],
    "cos_ranked": ["cos_scores"],
    "l2_ranked": ["question_vectors", "vectors"],
}


def hybrid(k, semantic="cos_ranked", flat=False):
    """CTE text of a hybrid ranking cut to k, named hybrid_k."""
    score = "0.7::DOUBLE" if flat else "score * 0.7::DOUBLE"
    method = "semantic-faiss" if flat else "semantic-pinecone"
    return f"""hits_{k} AS (
        SELECT query_id, item_id, '{method}' AS method, {score} AS s, rank AS position FROM {semantic} WHERE rank <= {k}
        UNION ALL SELECT query_id, item_id, 'keyword-tfidf', score * 0.3::DOUBLE, rank + 1000000 FROM kw_ranked
        WHERE rank <= {k}),
      merged_{k} AS (SELECT query_id, item_id, sum(s) AS relevance_score,
        CASE WHEN count(*) > 1 THEN 'hybrid' ELSE min(method) END AS retrieval_method, min(position) AS position
        FROM hits_{k} GROUP BY ALL),
      hybrid_{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
        ORDER BY round(relevance_score, 9) DESC, position) AS rank FROM merged_{k}) WHERE rank <= {k})"""


def with_views(names, body, *extra):
    """``body`` below the named views, what they need, and further CTE texts."""
    ordered = []

    def add(name):
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    ctes = [f"{name} AS ({VIEWS[name]})" for name in ordered] + list(extra)
    return "WITH " + ",\n".join(ctes) + "\n" + body

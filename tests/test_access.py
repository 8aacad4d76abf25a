import pytest
from pyspark.sql import functions as F

from custodia import constants as C
from custodia.functions import roles, text
from custodia.operators import access

DOCS = [
    ("f1", "finance", "Revenue $45.2M, account AC847392"),
    ("h1", "hr", "Salary ranges from $65,000"),
    ("p1", "public", "Public announcement"),
    ("m1", "health", "PatientName Doe, MRN445566"),
]


@pytest.fixture
def docs(rows):
    return rows("id string, domain string, content string", *DOCS)


def _as(docs, role):
    return docs.withColumn("role", F.lit(role))


@pytest.mark.parametrize("role,n", [("admin", 4), ("analyst", 3), ("manager", 2), ("employee", 1), ("guest", 1), ("x", 0)])
def test_access_matrix(docs, role, n):
    granted = access.access_filter(_as(docs, role))
    denied = access.access_denied(_as(docs, role))
    assert granted.count() == n
    assert denied.count() == 4 - n
    counts = access.validation_counts(_as(docs, role), ["role"]).first()
    assert (counts["documents_retrieved"], counts["documents_validated"], counts["documents_denied"]) == (4, n, 4 - n)


def test_missing_domain_is_public_for_roles_but_not_for_frameworks(rows):
    df = rows(
        "id int, domain string, content string, role string, framework string",
        (1, None, "x", "guest", "gdpr"),
    )
    assert access.validate_documents(df).count() == 1
    assert access.compliance_filter(df).count() == 0


@pytest.mark.parametrize(
    "framework,kept",
    [("hipaa", {"m1", "p1"}), ("gdpr", {"p1"}), ("sox", {"f1", "p1"}), ("general", {"p1"}), ("other", {"p1"})],
)
def test_frameworks(docs, framework, kept):
    df = _as(docs, "admin").withColumn("framework", F.lit(framework))
    assert {r["id"] for r in access.compliance_filter(df).collect()} == kept


def test_validated_document(docs):
    out = {r["id"]: r for r in access.validate_documents(_as(docs, "analyst")).collect()}
    assert set(out) == {"f1", "h1", "p1"}
    # terms are found in the unmasked text; analysts see amounts of finance and hr
    assert out["h1"]["sensitive_terms_detected"] == ["Salary"]
    assert out["h1"]["content"] == DOCS[1][2] and out["h1"]["pii_masked"] is None
    assert out["p1"]["sensitive_terms_detected"] is None
    assert all(r["validated"] and r["validator_version"] == "1.0" for r in out.values())


def test_masking_can_be_left_out(docs):
    out = access.validate_documents(_as(docs, "admin"), mask_pii=False).collect()
    assert {r["id"]: r["content"] for r in out} == {i: c for i, _, c in DOCS}


def test_department_roles(rows):
    df = rows(
        "department string, department_role string",
        ("legal", "Manager"), ("health", "doctor"), ("hr", "unknown"), ("nowhere", "manager"), ("accounting", "accountant"),
    )
    out = {(r[0], r[1]): r[2] for r in roles.with_general_role(df).collect()}
    assert list(out.values()).count("guest") == 2
    assert out[("legal", "Manager")] == "admin"
    assert out[("health", "doctor")] == "analyst"
    assert out[("accounting", "accountant")] == "manager"


def test_explanations(rows):
    df = rows("role string, domain string", ("analyst", "health"), ("analyst", "hr"), ("x", "nowhere"))
    out = [r["explanation"] for r in roles.explain_access(df).collect()]
    assert (
        "Access DENIED: Role 'analyst' cannot access 'health' domain. Your role allows: finance, hr, public. "
        "To access this domain, you need one of: admin"
    ) in out
    assert "Access GRANTED: Role 'analyst' has access to 'hr' domain." in out
    assert any("Role 'x' cannot access 'nowhere'" in t and t.endswith("one of: ") for t in out)


def test_request_checks(rows):
    df = rows(
        "id int, username string, role string, query string, k int, framework string",
        (1, "u", "admin", "q", 1, "gdpr"),
        (2, "", "boss", "", 0, "pci"),
        (3, "u" * 101, "guest", "q" * 1001, 21, None),
        (4, "u" * 100, "guest", "q" * 1000, 20, "general"),
    )
    out = {r["id"]: r["reasons"] for r in text.with_reject_reasons(df).collect()}
    assert out[1] == [] and out[4] == []
    assert out[2] == ["username", "role", "query", "k", "framework"]
    assert out[3] == ["username", "query", "k", "framework"]


PLANS = [
    ('```json\n[{"agent": "analyst", "task": "t", "priority": 2}]\n```', [("analyst", "t", 2)]),
    ('text ```[{"agent": "a"}]``` more', [("a", None, None)]),
    ('[{"task": "x"}, {"agent": "b", "priority": 1}]', [(None, "x", None), ("b", None, 1)]),
    ("no plan at all", [("retriever", "ask", 1)]),
    ("[broken", [("retriever", "ask", 1)]),
    ("[]", []),
]


def test_task_plans(rows):
    df = rows("i int, response string", *[(i, p) for i, (p, _) in enumerate(PLANS)])
    out = df.select("i", text.task_plan("response", F.lit("ask")).alias("plan")).collect()
    for r in out:
        assert [tuple(t) for t in r["plan"]] == PLANS[r["i"]][1], PLANS[r["i"]][0]


def test_message_parts(rows):
    df = rows("i int, parts array<string>", (1, ["a", "", "b"]), (2, [""]), (3, []), (4, None))
    out = {r[0]: r[1] for r in df.select("i", text.message_text("parts")).collect()}
    assert out == {1: "a b", 2: None, 3: None, 4: None}


def test_blocked_message_and_preview(rows):
    df = rows("t string, d string", ("toxic_content", "x"), ("other", "why"), (None, None))
    out = [r[0] for r in df.select(text.blocked_message("t", "d")).collect()]
    assert C.BLOCKED_REASONS["TOXIC_CONTENT"] in out[0]
    assert "Reason: why" in out[1]
    assert C.BLOCKED_REASONS["POLICY_VIOLATION"] in out[2]
    shown = rows("t string", ("a" * 200,), ("a" * 201,)).select(text.preview("t")).collect()
    assert [len(r[0]) for r in shown] == [200, 203]

"""Cases in which a gap would let something pass."""

import pandas as pd
from pyspark.sql import functions as F

from custodia.functions import entities, plugins
from custodia.operators import alerts, governed, guardrails, retrieval
from custodia.sources import logs


def test_a_missing_or_unknown_role_is_searched(rows):
    df = rows("rid long, response string, role string", (1, "mail a@b.com", None), (2, "mail a@b.com", "visitor"),
              (3, "mail a@b.com", "admin"), (4, "nothing", None))
    out = {r["rid"]: r["blocked_pii"] for r in guardrails.pii_output_gate(df).collect()}
    assert out == {1: True, 2: True, 3: False, 4: False}
    verdicts = rows("verdict_id long, toxic int", (4, 0))
    safe = {r["rid"]: r["is_safe"] for r in guardrails.output_gate(df, verdicts, "rid", "verdict_id").collect()}
    assert safe == {1: False, 2: False, 3: True, 4: True}


def test_a_valid_card_inside_a_longer_number_stays(rows):
    text = "941111111111111110 and 4111111111111111."
    out = entities.mask_entities(rows("content string", (text,))).first()["content"]
    assert out == "941111111111111110 and <CREDIT_CARD>."


def test_only_the_failing_text_passes_the_moderator(rows):
    def model(texts: pd.Series):
        if (texts == "boom").any():
            raise ValueError("no verdict")
        return texts == "bad"

    df = rows("id long, text string", (1, "bad"), (2, "boom"), (3, "bad"), (4, "fine")).coalesce(1)
    table = plugins.verdict_table(df, "id", "text", plugins.moderator(model)).collect()
    assert {r["verdict_id"]: (r["toxic"], r["failed"]) for r in table} == {
        1: (1, False), 2: (0, True), 3: (1, False), 4: (0, False)
    }


def test_a_repeated_document_id_gives_one_row_per_hit(rows):
    corpus = rows("id long, domain string, title string, content string",
                  (1, "hr", "b", "x"), (1, "finance", "a", "y"), (1, "finance", "a", "w"), (2, "public", "c", "z"))
    hits = rows("query_id long, item_id long, rank int", (7, 1, 1), (7, 2, 2), (8, 1, 1))
    domains = retrieval.with_documents(hits, corpus, "domain").collect()
    assert sorted((r["query_id"], r["item_id"], r["domain"]) for r in domains) == [(7, 1, "finance"), (7, 2, "public"), (8, 1, "finance")]
    texts = retrieval.with_documents(hits, corpus, "domain", "content").collect()
    assert sorted((r["query_id"], r["domain"], r["content"]) for r in texts) == [(7, "finance", "w"), (7, "public", "z"), (8, "finance", "w")]


def test_denials_of_unknown_users_are_logged_and_told(rows):
    df = rows("username string, role string, domain string, request_id long, micros long, ts timestamp, session_id string, reason string,"
              "query string, n long, seconds double", (None, None, None, 1, 0, None, None, None, None, None, None), ("u", "guest", "hr", 2, 1, None, "s", "", "q", 2, 0.5))
    line = logs.access_line(F.col("username"), F.col("role"), F.col("domain"), F.lit(False))
    assert [r[0] for r in df.select(line).collect()] == [
        "ACCESS DENIED | User: None | Role: None | Domain: None", "ACCESS DENIED | User: u | Role: guest | Domain: hr"]
    asked = logs.query_line(F.col("username"), F.col("query"), F.col("n"), F.col("seconds"))
    assert [r[0] for r in df.select(asked).collect()] == [
        "QUERY | User: None | Query: None... | Docs: None | Duration: Nones", "QUERY | User: u | Query: q... | Docs: 2 | Duration: 0.50s"]
    told = {r["user"]: (r["message"], r["description"]) for r in alerts.denial_to_alert(df).collect()}
    assert told[None] == ("Access denied: Role 'None' attempted to access 'None' domain", "Access denied for role 'None' to domain 'None'")
    many = {r["user"]: r["description"] for r in alerts.excessive_denials(df, 1).collect()}
    assert many == {None: "1 denials in last hour for user None", "u": "1 denials in last hour for user u"}
    named = df.withColumn("department_role", F.lit(None).cast("string")).select(governed._reason("may not read", "domain").alias("r"))
    assert all(r["r"] for r in named.collect())


def test_a_parsed_line_keeps_an_unknown_user(rows):
    made = rows("user string, role string, domain string", (None, "guest", None))
    line = logs.log_file_line(F.timestamp_seconds(F.lit(0)), logs.access_line(F.col("user"), F.col("role"), F.col("domain"), F.lit(False)))
    parsed = logs.parse_audit_log(made.select(line.alias("value"))).first()
    assert (parsed["kind"], parsed["user"], parsed["role"], parsed["domain"]) == ("access", "None", "guest", "None")

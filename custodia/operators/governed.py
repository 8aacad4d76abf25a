"""The governed pipelines: retrieval, access, masking and prompt tables end to end."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from custodia import constants as C
from custodia.functions.roles import with_general_role
from custodia.functions.text import named, user_prompt
from custodia.operators import access, alerts, guardrails, retrieval
from custodia.session import materialize, union


def secure_answer_inputs(ranked: DataFrame, corpus: DataFrame, queries: DataFrame,
                         framework=None) -> DataFrame:
    """One row per query: prompt, cited sources and counts, or the refusal text.

    ``ranked`` is a retrieval result; ``queries`` has query_id, query, role (and the
    framework column named by ``framework``)."""
    extra = [framework] if framework else []
    hits = materialize(ranked.join(queries.select("query_id", "role", *extra), "query_id"), "hits")
    # domains first: counts need no more, and texts are read for permitted documents only
    found = materialize(retrieval.with_documents(hits, corpus, "domain"), "found")
    counts = access.validation_counts(found, ["query_id"], framework=framework)
    permitted = access.access_filter(found)
    if framework:
        permitted = access.compliance_pairs(permitted, framework)
        kept = F.col("documents_compliant")
        refusal = F.concat(
            F.lit("No documents available that comply with "), F.upper(framework),
            F.lit(" requirements for your access level."),
        )
    else:
        kept = F.col("documents_validated")
        refusal = F.lit(C.REFUSAL_TEXT)
    texts = retrieval.with_documents(permitted, corpus, "id", "title", "content")
    context = retrieval.assemble_context(access.annotate(texts))
    zero = F.lit(0).cast("long")
    # left joins: a refused query keeps its row
    return (
        queries.join(counts, "query_id", "left")
        .join(context, "query_id", "left")
        .select(
            "query_id", "query", "role", *extra,
            F.coalesce("documents_retrieved", zero).alias("documents_retrieved"),
            F.coalesce(kept, zero).alias("documents_after_validation"),
            (F.coalesce("documents_retrieved", zero) - F.coalesce(kept, zero)).alias("documents_denied"),
            F.col("context").isNull().alias("refused"),
            F.when(F.col("context").isNull(), refusal).alias("refusal"),
            F.when(F.col("context").isNotNull(), F.lit(C.SYSTEM_PROMPT)).alias("system_prompt"),
            user_prompt("context", "query").alias("user_prompt"),
            "sources",
        )
    )


@dataclass
class ToolRun:
    """What one run of the domain tool yields; each part is its own table."""

    documents: DataFrame
    audit: DataFrame
    alerts: DataFrame
    violations: DataFrame


def _reason(what, domain):
    return F.concat(
        F.lit("Role '"), named("role"), F.lit("' (from department role '"), named("department_role"),
        F.lit(f"') {what} '"), named(domain), F.lit("' domain"),
    )


def retrieve_and_validate(requests: DataFrame, retrieve, corpus: DataFrame, verdicts: DataFrame,
                          verdict_key: str, k=5, per_minute=C.MAX_REQUESTS_PER_MINUTE,
                          per_user_hour=C.MAX_REQUESTS_PER_USER_HOUR) -> ToolRun:
    """Role map, domain gate, input gate, over-fetched retrieval, domain filter, validation.

    ``requests``: query_id, query, username, session_id, department_role, domain, ts, micros and
    the verdict key. ``retrieve(queries, n)`` ranks n documents for the given queries. Refused
    requests never reach the retrieval."""
    asked = with_general_role(requests, "domain", "department_role", "role")
    gated = access.with_access_flag(asked)
    open_requests = gated.filter("allowed").drop("allowed")
    refused = gated.filter(~F.col("allowed")).withColumn(
        "reason", _reason("does not have access to", "domain")
    )

    # the gate and the ranking feed every output table: write them once (no texts but the query's)
    judged = materialize(
        guardrails.input_gate(
            open_requests, verdicts, verdict_key, verdict_key, per_minute, per_user_hour,
            order_id="query_id",
        ),
        "gate",
    )
    safe = judged.filter("is_safe")
    violations = guardrails.violation_record(judged.filter(~F.col("is_safe")), query="query")

    ranked = retrieve(safe.select("query_id", "query", "embedding"), 2 * k)
    wanted = safe.select(
        "query_id", "role", "department_role", "username", "session_id", "ts", "query",
        F.col("domain").alias("wanted_domain"),
    )
    hits = materialize(ranked.join(wanted, "query_id"), "hits")
    found = materialize(retrieval.with_documents(hits, corpus, "domain"), "found")
    in_domain = retrieval.domain_or_public(found)
    texts = retrieval.with_documents(access.access_filter(in_domain), corpus, "id", "title", "content")
    valid = access.annotate(texts)
    order = Window.partitionBy("query_id").orderBy("rank")  # at most 2k rows per query
    documents = valid.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    late = access.access_denied(in_domain).withColumn(
        "reason", _reason("attempted to access document in", "domain")
    )
    denial = ["ts", "username", "session_id", "role", "domain", "query", "reason"]
    denials = union(refused.select(*denial), late.select(*denial))

    denied_events = denials.select(
        F.lit("access_control").alias("event_type"),
        F.col("ts").alias("timestamp"), F.col("username").alias("user"),
        F.col("role").alias("user_role"), "domain", F.lit("denied").alias("decision"),
    )
    shown = access.validation_counts(in_domain, ["query_id"]).select("query_id", "documents_validated")
    totals = found.groupBy("query_id").agg(F.count("*").alias("documents_retrieved"))
    query_events = (
        wanted.join(totals, "query_id", "left").join(shown, "query_id", "left").select(
            F.lit("query").alias("event_type"),
            F.col("ts").alias("timestamp"), F.col("username").alias("user"),
            F.col("role").alias("user_role"), F.col("wanted_domain").alias("domain"), "query",
            F.coalesce("documents_retrieved", F.lit(0)).alias("documents_retrieved"),
            F.coalesce("documents_validated", F.lit(0)).alias("documents_validated"),
        )
    )
    raised = alerts.union_alerts(
        alerts.denial_to_alert(denials), alerts.violation_to_alert(violations)
    )
    return ToolRun(
        documents,
        union(denied_events, query_events, allow_missing=True),
        raised,
        violations,
    )


def _tasks(plans):
    return plans.select("query_id", F.posexplode("plan").alias("pos", "t")).select(
        "query_id", "pos",
        F.coalesce("t.agent", F.lit(C.DEFAULT_AGENT)).alias("agent"),
        F.coalesce("t.task", F.lit("")).alias("task"),
        F.coalesce("t.priority", F.lit(C.DEFAULT_PRIORITY)).alias("priority"),
    )


def plan_steps(plans: DataFrame) -> DataFrame:
    """The tasks of each plan with their step: by priority, then as listed."""
    order = Window.partitionBy("query_id").orderBy("priority", "pos")
    return _tasks(plans).withColumn("step", F.row_number().over(order).cast("long"))


def assigned_tasks(plans: DataFrame, tools: DataFrame) -> DataFrame:
    """Tasks with the tool of their agent; unknown names go to the retriever, agents without a
    tool yield nothing."""
    known = _tasks(plans).withColumn(
        "agent", F.when(F.col("agent").isin(*C.AGENTS), F.col("agent")).otherwise(C.DEFAULT_AGENT)
    )
    # one tool per known agent: a handful of rows, whatever is passed in
    usable = tools.filter(F.col("agent").isin(*C.AGENTS)).dropDuplicates(["agent"])
    return known.join(F.broadcast(usable), "agent")


def run_task_plan(plans: DataFrame, tools: DataFrame) -> DataFrame:
    """One result per agent of a plan, the last one in order of priority.

    ``plans``: query_id, plan (array of agent, task, priority); ``tools``: agent, tool, one row
    per agent."""
    return (
        assigned_tasks(plans, tools)
        .groupBy("query_id", "agent")
        .agg(F.max(F.struct("priority", "pos", "task", "tool")).alias("m"))
        .select("query_id", "agent", "m.tool", "m.task", "m.priority")
    )

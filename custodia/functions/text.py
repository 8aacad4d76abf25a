"""Small text columns: previews, fingerprints, prompts, messages, plans."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from custodia import constants as C


def _col(value):
    return F.col(value) if isinstance(value, str) else value


def named(value) -> Column:
    """A part of a message; a missing one is called None, so that the message survives."""
    return F.coalesce(_col(value).cast("string"), F.lit("None"))


def preview(text, length=200) -> Column:
    """The first characters, with dots when something was cut."""
    text = _col(text)
    return F.when(
        F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))
    ).otherwise(text)


def cut(text, length=200) -> Column:
    return F.substring(_col(text), 1, length)


def fingerprint(function_name, **arguments) -> Column:
    """md5 over the function name and its arguments as JSON with sorted keys."""
    fields = [_col(arguments[key]).alias(key) for key in sorted(arguments)]
    return F.md5(
        F.to_json(F.struct(F.lit(function_name).alias("function"), F.struct(*fields).alias("kwargs")))
    )


def vector_key(doc_id="id", namespace="namespace") -> Column:
    return F.concat_ws("_", _col(doc_id), _col(namespace))


def vector_metadata(preview_chars=1000) -> list:
    """Size-limited metadata columns of a document."""
    return [
        F.substring(F.coalesce("title", F.lit("")), 1, 500).alias("title"),
        F.coalesce("domain", F.lit("unknown")).alias("domain"),
        F.coalesce("classification", F.lit("internal")).alias("classification"),
        F.substring(F.coalesce("author", F.lit("")), 1, 200).alias("author"),
        F.coalesce(F.col("date").cast("string"), F.lit("")).alias("date"),
        F.substring("content", 1, preview_chars).alias("content_preview"),
        F.length("content").cast("long").alias("content_length"),
    ]


def user_prompt(context, query) -> Column:
    # plain concatenation: the texts may hold % and braces
    return F.concat(
        F.lit(C.USER_PROMPT_HEAD), _col(context),
        F.lit(C.USER_PROMPT_MIDDLE), _col(query),
        F.lit(C.USER_PROMPT_TAIL),
    )


def blocked_message(violation_type, description) -> Column:
    """Text for a blocked request. Types are matched in upper case, so the friendly text is found."""
    reasons = F.create_map(*[F.lit(x) for pair in C.BLOCKED_REASONS.items() for x in pair])
    reason = F.coalesce(
        F.try_element_at(reasons, F.upper(F.coalesce(_col(violation_type), F.lit("policy_violation")))),
        _col(description),
        F.lit(C.BLOCKED_REASONS["POLICY_VIOLATION"]),
    )
    return F.concat(F.lit(C.BLOCKED_HEAD), reason, F.lit(C.BLOCKED_TAIL))


def message_text(parts) -> Column:
    """Non-empty parts joined by a blank; null when no part has text."""
    kept = F.filter(_col(parts), lambda p: p.isNotNull() & (p != ""))
    return F.when(F.size(kept) > 0, F.array_join(kept, " "))


def type_label(violation_type) -> Column:
    return F.coalesce(F.initcap(F.replace(_col(violation_type), F.lit("_"), F.lit(" "))), F.lit("Unknown"))


PLAN_SCHEMA = "array<struct<agent:string,task:string,priority:int>>"


def task_plan(response, query) -> Column:
    """The task list of a model answer; a single retrieval task when it holds no valid list."""
    response = _col(response)
    fenced = F.regexp_extract(response, r"(?s)```json(.*?)(?:```|\z)", 1)
    plain = F.regexp_extract(response, r"(?s)```(.*?)(?:```|\z)", 1)
    body = (
        F.when(F.contains(response, F.lit("```json")), fenced)
        .when(F.contains(response, F.lit("```")), plain)
        .otherwise(response)
    )
    fallback = F.array(
        F.struct(
            F.lit(C.DEFAULT_AGENT).alias("agent"),
            _col(query).alias("task"),
            F.lit(1).alias("priority"),
        )
    )
    trimmed = F.regexp_replace(body, r"^\s+|\s+$", "")
    parsed = F.when(F.startswith(trimmed, F.lit("[")), F.from_json(trimmed, PLAN_SCHEMA))
    return F.coalesce(parsed, fallback)


def with_reject_reasons(df):
    """Add ``reasons``: the request fields outside their limits. An empty list means valid."""
    checks = {
        "username": F.length("username").between(1, 100),
        "role": F.col("role").isin(*C.ROLES),
        "query": F.length("query").between(1, 1000),
        "k": F.col("k").between(1, 20),
        "framework": F.col("framework").isin(*C.FRAMEWORK_DOMAINS),
    }
    failed = [
        F.when(~F.coalesce(ok, F.lit(False)), F.lit(field)) for field, ok in checks.items()
    ]
    return df.withColumn("reasons", F.array_compact(F.array(*failed)))

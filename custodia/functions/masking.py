"""Personal-data masking and sensitive-term detection as native column expressions.

Patterns carry the (?U) flag: digits and word boundaries are Unicode-aware, as the
rules require. No Python runs per row."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from custodia import constants as C
from custodia import rules
from custodia.functions.once import bind

_PATTERN = {name: (pattern, tag) for name, pattern, tag in C.PII_PATTERNS}

# A text without the given piece cannot match, and no replacement tag contains it, so a
# cheap substring test on the original text spares the regex on clean rows.
_REQUIRED_PIECE = {"email": "@", "salary": "$"}
_NEEDS_DIGITS = r"(?U)\d{3}-\d|\d{4}"


def _replace(text: Column, name: str) -> Column:
    pattern, tag = _PATTERN[name]
    return F.regexp_replace(text, F.lit("(?U)" + pattern), F.lit(tag))


def mask_patterns(text, names) -> Column:
    """Apply the named patterns in rule order to one column."""
    out = F.col(text) if isinstance(text, str) else text
    for name in C.ALL_PII:
        if name in names:
            out = _replace(out, name)
    return out


def mask_text(text, aggressive=False) -> Column:
    """Basic masking, or every pattern when ``aggressive``."""
    return mask_patterns(text, C.ALL_PII if aggressive else C.BASIC_PII)


def _may_match(text: Column, name: str) -> Column:
    piece = _REQUIRED_PIECE.get(name)
    return F.contains(text, F.lit(piece)) if piece else F.col("_digits")


def mask_where(df: DataFrame, column: str, selected) -> DataFrame:
    """Mask ``column`` in place; ``selected(name)`` is the row condition for a pattern.

    One projection per pattern keeps the plan linear in the number of patterns."""
    original = F.col("_original")
    out = df.withColumn("_original", F.col(column)).withColumn(
        "_digits", F.col(column).rlike(_NEEDS_DIGITS)
    )
    for name in C.ALL_PII:
        wanted = selected(name)
        if wanted is None:
            continue
        out = out.withColumn(
            column,
            F.when(
                wanted & _may_match(original, name), _replace(F.col(column), name)
            ).otherwise(F.col(column)),
        )
    return out.drop("_digits", "_original")


def mask_column(df: DataFrame, column="content", aggressive=False) -> DataFrame:
    """``mask_text`` over a table, skipping rows that cannot match."""
    names = C.ALL_PII if aggressive else C.BASIC_PII
    return mask_where(df, column, lambda name: F.lit(True) if name in names else None)


def with_role_patterns(df: DataFrame, role="role", domain="domain") -> DataFrame:
    """Add ``_patterns``: the pattern names that apply for the row's role and domain."""
    table = rules.masking_rules(df.sparkSession)
    return df.join(
        table,
        (F.col(role) == F.col("rule_role"))
        & ((F.col("rule_domain") == "*") | (F.col("rule_domain") == F.col(domain))),
        "left",
    ).select(
        *df.columns,
        F.coalesce("patterns", F.array(*map(F.lit, C.ALL_PII))).alias("_patterns"),
    )


def mask_by_role(df: DataFrame, column="content", role="role", domain="domain") -> DataFrame:
    """Role- and domain-dependent masking; ``pii_masked`` is true where the text changed, else null."""
    before = with_role_patterns(df, role, domain).withColumn("_before", F.col(column))
    masked = mask_where(before, column, lambda name: F.array_contains("_patterns", name))
    changed = ~F.col("_before").eqNullSafe(F.col(column))
    return masked.withColumn("pii_masked", F.when(changed, True)).drop("_before", "_patterns")


def sensitive_terms(text, terms=None) -> Column:
    """Terms contained in the text ignoring case, in list order; null when there is none."""
    def contained(lowered):
        hits = [F.when(F.contains(lowered, F.lit(t.lower())), F.lit(t)) for t in terms or C.SENSITIVE_TERMS]
        return F.array_compact(F.array(*hits))

    return bind(
        bind(F.lower(text), contained), lambda found: F.when(F.size(found) > 0, found)
    )


def register_functions(spark: SparkSession) -> None:
    """SQL-callable masking and detection, as temporary SQL functions (no Python in the plan)."""

    def body(names):
        out = "content"
        for name, pattern, tag in C.PII_PATTERNS:
            if name in names:
                out = f"regexp_replace({out}, r'(?U){pattern}', '{tag}')"
        return out

    terms = ", ".join(
        f"CASE WHEN contains(lower(content), '{t.lower()}') THEN '{t}' END" for t in C.SENSITIVE_TERMS
    )
    for name, expr, kind in [
        ("mask_pii_basic", body(C.BASIC_PII), "STRING"),
        ("mask_pii_aggressive", body(C.ALL_PII), "STRING"),
        ("detect_sensitive_terms", f"array_compact(array({terms}))", "ARRAY<STRING>"),
    ]:
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(content STRING) RETURNS {kind} RETURN {expr}"
        )

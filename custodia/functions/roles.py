"""Department roles, role descriptions and access explanations."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custodia import constants as C
from custodia import rules


def with_general_role(df: DataFrame, department="department", department_role="department_role",
                      out="general_role") -> DataFrame:
    """Add the access-control role behind a department's own role name; unknown ones are guests."""
    table = rules.department_roles(df.sparkSession).select(
        F.col("department").alias("_department"),
        F.col("department_role").alias("_department_role"),
        F.col("general_role").alias("_general_role"),
    )
    matched = (F.col(department) == F.col("_department")) & (
        F.lower(department_role) == F.col("_department_role")
    )
    kept = [c for c in df.columns if c != out]
    return df.join(F.broadcast(table), matched, "left").select(
        *kept, F.coalesce("_general_role", F.lit("guest")).alias(out)
    )


def role_description(role) -> Column:
    table = F.create_map(*[F.lit(x) for pair in C.ROLE_DESCRIPTIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.col(role)), F.lit(C.DEFAULT_ROLE_DESCRIPTION))


def role_option_line(department_role, general_role) -> Column:
    return F.concat(
        F.lit("     - `"), F.col(department_role), F.lit("` - Maps to "), F.col(general_role),
        F.lit(" role ("), role_description(general_role), F.lit(")"),
    )


def department_options(spark) -> DataFrame:
    """Per department: the role names in rule order and the option lines of a prompt."""
    ordered = F.sort_array(
        F.collect_list(
            F.struct("role_pos", "department_role",
                     role_option_line("department_role", "general_role").alias("line"))
        )
    )
    return (
        rules.department_roles(spark)
        .groupBy("department")
        .agg(ordered.alias("o"))
        .select(
            "department",
            F.transform("o", lambda s: s["department_role"]).alias("roles"),
            F.array_join(F.transform("o", lambda s: s["line"]), "\n").alias("options"),
        )
    )


def _with_rule_lists(df, role, domain):
    spark = df.sparkSession
    own = rules.domains_by_role(spark).select(
        F.col("role").alias("_r"), F.array_join("domains", ", ").alias("_allowed")
    )
    others = rules.roles_by_domain(spark).select(
        F.col("domain").alias("_d"),
        F.array_join("roles", ", ").alias("_alternatives"),
        F.col("roles").alias("_roles"),
    )
    return (
        df.join(F.broadcast(own), F.col(role) == F.col("_r"), "left")
        .join(F.broadcast(others), F.col(domain) == F.col("_d"), "left")
        .withColumn("_allowed", F.coalesce("_allowed", F.lit("")))
        .withColumn("_alternatives", F.coalesce("_alternatives", F.lit("")))
        .withColumn("_granted", F.coalesce(F.array_contains("_roles", F.col(role)), F.lit(False)))
    )


def explain_access(df: DataFrame, role="role", domain="domain", out="explanation") -> DataFrame:
    """Why a role may or may not read a domain."""
    granted = F.concat(
        F.lit("Access GRANTED: Role '"), F.col(role), F.lit("' has access to '"), F.col(domain),
        F.lit("' domain."),
    )
    denied = F.concat(
        F.lit("Access DENIED: Role '"), F.col(role), F.lit("' cannot access '"), F.col(domain),
        F.lit("' domain. Your role allows: "), F.col("_allowed"),
        F.lit(". To access this domain, you need one of: "), F.col("_alternatives"),
    )
    return _with_rule_lists(df, role, domain).select(
        *df.columns, F.when(F.col("_granted"), granted).otherwise(denied).alias(out)
    )


def explain_denied_query(df: DataFrame, query="query", role="role", domain="domain",
                         out="explanation") -> DataFrame:
    text = F.concat(
        F.lit("Access DENIED for query: '"), F.col(query), F.lit("'\nYour role '"), F.col(role),
        F.lit("' can only access: "), F.col("_allowed"), F.lit("\nTo access "), F.col(domain),
        F.lit(" domain, you need: "), F.col("_alternatives"),
    )
    return _with_rule_lists(df, role, domain).select(*df.columns, text.alias(out))


def explain_retrieval(query, found, shown) -> Column:
    return F.concat(
        F.lit("Query: '"), F.col(query), F.lit("'\nFound "), F.col(found).cast("string"),
        F.lit(" documents, validated "), F.col(shown).cast("string"), F.lit(", denied "),
        (F.col(found) - F.col(shown)).cast("string"), F.lit(" based on your role permissions."),
    )


def explain_decision(df: DataFrame, decision_type="decision_type", query="query", role="role",
                     domain="domain", found="documents_found", shown="documents_shown",
                     out="explanation") -> DataFrame:
    """Pick the explanation by decision type."""
    kind = F.col(decision_type)
    return (
        explain_denied_query(df, query, role, domain, "_denied")
        .withColumn(
            out,
            F.when(kind == "access", F.col("_denied"))
            .when(kind == "retrieval", explain_retrieval(query, found, shown))
            .otherwise(F.concat(F.lit("Decision explanation for "), kind)),
        )
        .drop("_denied")
    )

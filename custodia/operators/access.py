"""Access filtering and document validation as DataFrame transforms.

Every rule join is a broadcast of a fixed table: no transform here shuffles documents."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custodia import constants as C
from custodia import rules
from custodia.functions import masking


def _rule_pairs(df):
    return F.broadcast(
        rules.role_access(df.sparkSession).select(
            F.col("role").alias("_role"), F.col("domain").alias("_domain")
        )
    )


def _readable(role, domain):
    # a document without a domain counts as public
    return (F.col(role) == F.col("_role")) & (
        F.coalesce(F.col(domain), F.lit("public")) == F.col("_domain")
    )


def access_filter(df: DataFrame, role="role", domain="domain") -> DataFrame:
    """Rows the role may read."""
    return df.join(_rule_pairs(df), _readable(role, domain), "left_semi")


def access_denied(df: DataFrame, role="role", domain="domain") -> DataFrame:
    """Rows the role may not read."""
    return df.join(_rule_pairs(df), _readable(role, domain), "left_anti")


def with_access_flag(df: DataFrame, role="role", domain="domain", out="allowed") -> DataFrame:
    """All rows, with a flag whether the role may read the domain."""
    return df.join(_rule_pairs(df), _readable(role, domain), "left").select(
        *df.columns, F.col("_role").isNotNull().alias(out)
    )


def annotate(df: DataFrame, role="role", domain="domain", content="content", terms=None,
             mask_pii=True) -> DataFrame:
    """Sensitive terms of the unmasked text, then masking, then the validation marks."""
    out = df.withColumn(
        "sensitive_terms_detected", masking.sensitive_terms(F.col(content), terms)
    )
    if mask_pii:
        out = out.withColumn("_domain_or_public", F.coalesce(F.col(domain), F.lit("public")))
        out = masking.mask_by_role(out, content, role, "_domain_or_public").drop("_domain_or_public")
    else:
        out = out.withColumn("pii_masked", F.lit(None).cast("boolean"))
    return out.withColumns(
        {"validated": F.lit(True), "validator_version": F.lit(C.VALIDATOR_VERSION)}
    )


def validate_documents(df: DataFrame, role="role", domain="domain", content="content",
                       terms=None, mask_pii=True) -> DataFrame:
    """Readable documents only, flagged, masked and marked as validated."""
    return annotate(access_filter(df, role, domain), role, domain, content, terms, mask_pii)


def compliance_pairs(df: DataFrame, framework="framework", domain="domain") -> DataFrame:
    """Rows whose domain the framework permits; a missing domain is not permitted and an
    unknown framework means the general one."""
    table = F.broadcast(
        rules.framework_domains(df.sparkSession).select(
            F.col("framework").alias("_framework"), F.col("domain").alias("_domain")
        )
    )
    known = F.when(F.col(framework).isin(*C.FRAMEWORK_DOMAINS), F.col(framework)).otherwise("general")
    return df.join(
        table, (known == F.col("_framework")) & (F.col(domain) == F.col("_domain")), "left_semi"
    )


def compliance_filter(df: DataFrame, framework="framework", role="role", domain="domain",
                      content="content", terms=None) -> DataFrame:
    return validate_documents(compliance_pairs(df, framework, domain), role, domain, content, terms)


def validation_counts(df: DataFrame, keys, role="role", domain="domain", framework=None) -> DataFrame:
    """Retrieved, validated and denied rows per key (and compliant ones, given a framework)."""
    flagged = with_access_flag(df, role, domain)
    aggregates = [
        F.count("*").alias("documents_retrieved"),
        F.count_if("allowed").alias("documents_validated"),
        F.count_if(~F.col("allowed")).alias("documents_denied"),
    ]
    if framework is not None:
        table = F.broadcast(
            rules.framework_domains(df.sparkSession).select(
                F.col("framework").alias("_framework"), F.col("domain").alias("_fw_domain")
            )
        )
        known = F.when(F.col(framework).isin(*C.FRAMEWORK_DOMAINS), F.col(framework)).otherwise("general")
        flagged = flagged.join(
            table, (known == F.col("_framework")) & (F.col(domain) == F.col("_fw_domain")), "left"
        )
        aggregates.append(
            F.count_if(F.col("allowed") & F.col("_framework").isNotNull()).alias("documents_compliant")
        )
    return flagged.groupBy(*keys).agg(*aggregates)

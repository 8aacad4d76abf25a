"""Rule tables as DataFrames. All have a fixed number of rows, so broadcasting them is safe."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custodia import constants as C


def _literal(value) -> str:
    if isinstance(value, int):
        return str(value)
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(map(_literal, value)) + ")"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def local_table(spark: SparkSession, rows, *names) -> DataFrame:
    """A small constant table, planned as a local relation and broadcast."""
    values = ", ".join("(" + ", ".join(map(_literal, row)) + ")" for row in rows)
    return F.broadcast(spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})"))


def role_access(spark: SparkSession) -> DataFrame:
    rows = [(role, domain) for role, domains in C.ROLE_ACCESS.items() for domain in domains]
    return local_table(spark, rows, "role", "domain")


def roles_by_domain(spark: SparkSession) -> DataFrame:
    """domain -> roles that may read it, in rule order."""
    domains = dict.fromkeys(d for listed in C.ROLE_ACCESS.values() for d in listed)
    rows = [(d, [r for r, listed in C.ROLE_ACCESS.items() if d in listed]) for d in domains]
    return local_table(spark, rows, "domain", "roles")


def domains_by_role(spark: SparkSession) -> DataFrame:
    """role -> domains it may read, in rule order."""
    return local_table(spark, C.ROLE_ACCESS.items(), "role", "domains")


def masking_rules(spark: SparkSession) -> DataFrame:
    """(role, domain) pairs with an own pattern list; the domain ``*`` stands for any."""
    rows = [(role, domain or "*", names) for role, domain, names in C.MASKING_RULES if role]
    return local_table(spark, rows, "rule_role", "rule_domain", "patterns")


def department_roles(spark: SparkSession) -> DataFrame:
    rows = [
        (department, pos, name, general)
        for department, mapping in C.DEPARTMENT_ROLES.items()
        for pos, (name, general) in enumerate(mapping.items())
    ]
    return local_table(spark, rows, "department", "role_pos", "department_role", "general_role")


def framework_domains(spark: SparkSession) -> DataFrame:
    rows = [(fw, domain) for fw, domains in C.FRAMEWORK_DOMAINS.items() for domain in domains]
    return local_table(spark, rows, "framework", "domain")


def routing_topics(spark: SparkSession, topics=None) -> DataFrame:
    rows = [
        (pos, domain, word)
        for pos, (domain, words) in enumerate((topics or C.ROUTING_TOPICS).items())
        for word in words
    ]
    return local_table(spark, rows, "topic_pos", "topic", "word")

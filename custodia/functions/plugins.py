"""Contracts for models that run outside: embeddings, moderation, entity recognition.

A model is a Python function over a pandas Series of texts. It runs batch-wise inside Spark
tasks as a pandas UDF; without one, stored tables or rules stand in."""

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custodia import constants as C
from custodia.operators import access
from custodia.operators.analytics import compliance_report
from custodia.functions import entities, masking, roles
from custodia.operators.alerts import filter_alerts
from custodia.operators.retrieval import assemble_context


def embedder(function, batch=C.UPSERT_BATCH):
    """texts -> vectors, called with at most ``batch`` texts at a time."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        parts = [function(texts.iloc[i : i + batch]) for i in range(0, len(texts), batch)]
        vectors = [list(map(float, v)) for part in parts for v in part]
        return pd.Series(vectors, index=texts.index)

    return embed


def with_embeddings(df: DataFrame, text="content", embed=None, stored=None, key="id") -> DataFrame:
    """Add ``embedding`` from a model, or from a stored (key, embedding) table."""
    if embed is not None:
        return df.withColumn("embedding", embed(F.col(text)))
    return df.join(stored, key, "left")


def moderator(function):
    """texts -> (unsafe, failed). Where a batch fails, its texts are judged one by one; only a text
    that fails by itself passes, and is marked."""

    def judge(texts):
        try:
            return [(bool(v), False) for v in function(texts)]
        except Exception:
            if len(texts) == 1:
                return [(False, True)]
            return [verdict for i in range(len(texts)) for verdict in judge(texts.iloc[i : i + 1])]

    @F.pandas_udf("unsafe boolean, failed boolean")
    def moderate(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(judge(texts), columns=["unsafe", "failed"])

    return moderate


def verdict_table(df: DataFrame, key: str, text: str, moderate) -> DataFrame:
    """The verdicts of a model in the shape of the stored ones; ``failed`` texts were not judged."""
    judged = df.select(F.col(key).alias("verdict_id"), moderate(F.col(text)).alias("v"))
    return judged.select("verdict_id", F.col("v.unsafe").cast("int").alias("toxic"), "v.failed")


def entity_recognizer(function):
    """texts -> lists of findings, to be passed to the output gate and the masks. A finding is (entity, value),
    or (entity, value, start, end, score) where the model knows the place."""
    names = ("entity", "value", "start", "end", "score")

    @F.pandas_udf("array<struct<entity:string,value:string,start:int,end:int,score:double>>")
    def recognize(texts: pd.Series) -> pd.Series:
        found = [[dict(zip(names, (*f, None, None, None))) for f in findings] for findings in function(texts)]
        return pd.Series(found, index=texts.index)

    return recognize


def register_entity_table(spark, function=None, name="entity_spans") -> None:
    """A table function for SQL, to be joined laterally: ``FROM texts, LATERAL entity_spans(content)``.

    Its rows are those of ``entities.span_table``: what the rules find, and with ``function``, a model as for
    ``entity_recognizer``, what the model finds."""
    names = ("entity", "value", "start", "end", "score")

    class EntitySpans:
        def eval(self, text: str):
            if text is None:
                return
            findings = function(pd.Series([text]))[0] if function else []
            told = [dict(zip(names, (*f, None, None, None))) for f in findings]
            for start, end, kind, score in entities.sweep(entities.rule_spans(text) + entities.model_spans(text, told)):
                yield start, end, kind, score, text[start:end]

    spans = F.udtf(EntitySpans, returnType="start int, end int, entity string, score double, value string", useArrow=True)
    spark.udtf.register(name, spans)


def capitalised_pairs(texts):
    """Stands in for a name model: pairs of capitalised words, with their places."""
    pattern = re.compile("[A-Z][a-z]+ [A-Z][a-z]+")
    return [[("PERSON", m[0], *m.span(), 0.85) for m in pattern.finditer(t or "")] for t in texts]


class DomainTools:
    """The table functions of one domain, for use with ``DataFrame.transform``."""

    def __init__(self, domain: str):
        self.domain = domain

    def _with_role(self, df):
        named = df.withColumn("_tool_domain", F.lit(self.domain))
        return roles.with_general_role(named, "_tool_domain", "department_role", "general_role")

    def check_access(self, df: DataFrame) -> DataFrame:
        """Add ``general_role`` and whether it may read this domain."""
        return access.with_access_flag(self._with_role(df), "general_role", "_tool_domain").drop("_tool_domain")

    def mask_pii_for_role(self, df: DataFrame, column="content") -> DataFrame:
        """Basic masking for admins and analysts, every pattern for the others."""
        few = F.col("general_role").isin("admin", "analyst")
        masked = masking.mask_where(
            self._with_role(df), column,
            lambda name: F.lit(True) if name in C.BASIC_PII else ~few,
        )
        return masked.drop("_tool_domain", "general_role")

    def extract_info(self, documents: DataFrame) -> DataFrame:
        """Context, sources and count per query, without numbering."""
        return assemble_context(documents, numbered=False).withColumn("domain", F.lit(self.domain))

    def explain_decision(self, df: DataFrame, decision_type="decision_type", **names) -> DataFrame:
        named = df.withColumn("_tool_domain", F.lit(self.domain))
        return roles.explain_decision(named, decision_type, domain="_tool_domain", **names).drop("_tool_domain")

    @staticmethod
    def get_compliance_report(audit: DataFrame, now, framework="general") -> DataFrame:
        return compliance_report(audit, now, framework=framework)

    @staticmethod
    def get_security_alerts(alerts: DataFrame, severity=None) -> DataFrame:
        return filter_alerts(alerts, severity)

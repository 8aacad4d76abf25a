"""The registered queries of the operators: thin wrappers that shape each operator's result."""

import public_tokenizers
from pyspark.sql import functions as F

from custodia.llm import (
    collocations, common, cotraining, decontaminate, digests, filter_audit, pieces, quality_rules, secrets, sharding,
    simhash, sql, substrings, surrogates, toxicity,
)

QUERIES = {}
ORACLES = dict(sql.ORACLES)


def _query(build):
    QUERIES[build.__name__] = build
    return build


@_query
def op1_simhash_near_dedup(spark, sf_dir):
    found = simhash.near_duplicates(common.table(spark, sf_dir, "documents"), words=4, distance=4)
    return found.select("doc_id", "fingerprint", F.col("component").alias("component_id"))


@_query
def op2_sentencepiece(spark, sf_dir):
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = pieces.encode(docs, model, decoded_col="decoded")
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), pieces.id_digest().alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@_query
def op4_sharding(spark, sf_dir):
    found = sharding.shard(common.table(spark, sf_dir, "documents"), "doc_id", "text", shards=8)
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@_query
def op8_decontamination(spark, sf_dir):
    tables = [common.table(spark, sf_dir, name) for name in ("documents", "benchmark")]
    found = decontaminate.find(*tables, words=10)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


@_query
def op6_substring_dedup(spark, sf_dir):
    kept = substrings.remove_repeats(common.table(spark, sf_dir, "documents"), words=13)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@_query
def op5_quality_rules(spark, sf_dir):
    docs, labels = (common.table(spark, sf_dir, name) for name in ("documents", "labels"))
    trusted = quality_rules.trusted_ids(labels, "doc_id", F.col("quality") == 1)
    found = quality_rules.judge_by_trusted(docs, trusted)
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "kept"
    )


@_query
def op10_secret_scan(spark, sf_dir):
    found = secrets.find(common.table(spark, sf_dir, "documents"))

    def listed(spans):
        parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.concat_ws(",", parts)

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(listed(base), 256).alias("base_sha256"), listed("spans").alias("spans"),
    )


TOXIC = 0.3  # score from which a text counts as toxic


def held_out(id_col="doc_id"):
    """Rows whose labels are never learnt from."""
    return F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 4 == 2


def toxicity_model(docs, spark, sf_dir):
    return toxicity.fit(docs, common.table(spark, sf_dir, "labels"), learn=~held_out())


@_query
def op3_toxicity(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity_model(docs, spark, sf_dir))
    return found.select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= TOXIC).cast("int").alias("predicted"),
    )


@_query
def op7_pii_surrogates(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.pseudonymize(docs, count_col="n_entities")


@_query
def op9_quality_classifier(spark, sf_dir):
    docs, labels = (common.table(spark, sf_dir, name) for name in ("documents", "labels"))
    model = cotraining.fit(docs, labels, learn=~held_out())
    found = cotraining.score(docs, model)
    return found.select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text_score", "metadata_score", "score",
        (F.col("score") >= 0.5).alias("kept"),
    )


@_query
def op13_filter_audit(spark, sf_dir):
    docs, labels = (common.table(spark, sf_dir, name) for name in ("documents", "labels"))
    return filter_audit.audit(filter_audit.failure_counts(docs, labels))


@_query
def op12_collocations(spark, sf_dir):
    return collocations.mine(common.table(spark, sf_dir, "documents"), least=100, longest=5, top=2000)


@_query
def op11_fingerprints(spark, sf_dir):
    return digests.compare_edited(common.table(spark, sf_dir, "documents"))

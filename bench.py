"""Times the headline queries and prints one JSON line.

Every query runs to completion into a no-op sink, after one run on the smallest tables that
warms the JVM and the Python workers up. The keyword index is fitted under its own
entry; the retrieval queries then use the fitted index, as a long-running service would.

The given tables are files of one row group, which a single task reads. A corpus comes in many files, so
each table is first dealt out to as many files as there are cores; that is not timed."""

import json
import os
import shutil
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from custodia.plans import load_all  # noqa: E402
from custodia.session import local_session  # noqa: E402

HEADLINE = """
mask_pii_by_role validate_documents compliance_filter mask_entities output_gate
rate_limit_user excessive_denials repeat_query_hits latency_percentiles system_metrics
guardrail_metrics latency_histogram session_state
semantic_topk_cosine query_x_document tfidf_fit keyword_index keyword_topk hybrid_retrieve
retrieve_by_domain secure_answer_inputs compliance_answer_inputs retrieve_and_validate
stream_rate_limit stream_redaction
""".split()


def run(build, spark, sf_dir):
    build(spark, sf_dir).write.format("noop").mode("overwrite").save()


def deal(spark, sf_dir, parts, folder):
    for name in sorted(os.listdir(sf_dir)):
        if name.endswith(".parquet"):
            spark.read.parquet(os.path.join(sf_dir, name)).repartition(parts).write.parquet(os.path.join(folder, name))


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=cpus if cpus.isdigit() else 8)
    registry = load_all().QUERIES
    from custodia.plans.retrieval_queries import keyword_index

    builders = dict(registry)
    builders["keyword_index"] = lambda s, d: keyword_index(s, d).vectors
    chosen = sys.argv[1:] or HEADLINE
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    seconds, given = {}, sf_dir
    sf_dir = tempfile.mkdtemp(prefix="bench-")
    deal(spark, given, int(cpus) if cpus.isdigit() else 8, sf_dir)
    for name in chosen:
        if os.path.isdir(warm_dir) and warm_dir != given:  # compile the plan's code first
            run(builders[name], spark, warm_dir)
        start = time.perf_counter()
        run(builders[name], spark, sf_dir)
        seconds[name] = round(time.perf_counter() - start, 3)
    documents = spark.read.parquet(os.path.join(sf_dir, "documents.parquet")).count()
    questions = builders["route_query"](spark, sf_dir).count()
    rates = {}
    if "validate_documents" in seconds:
        rates["validated_role_documents_per_sec"] = round(5 * documents / seconds["validate_documents"], 1)
    if "tfidf_fit" in seconds:
        rates["tfidf_fit_documents_per_sec"] = round(documents / seconds["tfidf_fit"], 1)
    if "hybrid_retrieve" in seconds:
        rates["hybrid_queries_per_sec"] = round(questions / seconds["hybrid_retrieve"], 1)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rates": rates,
                "sf": os.path.basename(os.path.normpath(given)).removeprefix("sf"),
            }
        )
    )
    shutil.rmtree(sf_dir, ignore_errors=True)


if __name__ == "__main__":
    main()

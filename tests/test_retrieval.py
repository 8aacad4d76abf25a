import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from custodia import constants as C
from custodia.operators import governed, retrieval, tfidf, topk
from custodia.sources import vector_store

DIM = 8


def vectors(n, seed, copies=True):
    rng = np.random.default_rng(seed)
    out = rng.normal(size=(n, DIM)).round(3)
    if copies:
        out[n // 3 :: 3] = out[0]  # a third of all rows are copies of one vector
    return out


def brute(queries, items, metric, k):
    out = {}
    for q, qv in enumerate(queries):
        if metric == "l2":
            s = -((items - qv) ** 2).sum(axis=1)
        else:
            s = items @ qv
            if metric == "cosine":
                s = s / np.linalg.norm(items, axis=1) / np.linalg.norm(qv)
        s = np.round(s, 9)
        out[q] = sorted(range(len(items)), key=lambda i: (-s[i], i))[:k]
    return out


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
@pytest.mark.parametrize("path", ["one block", "blocks"])
def test_top_k_is_exact(rows, monkeypatch, metric, path):
    items, queries = vectors(300, 1), vectors(50, 2, copies=False)
    item_df = rows("id long, embedding array<double>", *[(i, list(map(float, v))) for i, v in enumerate(items)])
    query_df = rows("query_id long, embedding array<double>", *[(i, list(map(float, v))) for i, v in enumerate(queries)])
    out = topk.top_k(item_df, query_df, 7, DIM, metric, broadcast_bytes=3_000 if path == "blocks" else 1 << 20)
    got = {}
    for r in sorted(out.collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["item_id"])
    assert got == brute(queries, items, metric, 7)


def test_top_k_with_few_items_and_bad_vectors(rows):
    items = rows(
        "id long, embedding array<double>",
        (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None), (5, [1.0, None]),
    )
    queries = rows("query_id long, embedding array<double>", (1, [1.0, 1.0]))
    out = topk.top_k(items, queries, 5, 2).collect()
    assert {(r["item_id"], round(r["score"], 6)) for r in out} == {(1, 0.707107), (2, 0.0)}
    none = topk.top_k(items.filter("id > 9"), queries, 5, 2)
    assert none.count() == 0


# --- keyword index against the formula in plain Python --------------------------------


def words_of(text, stops):
    return [w for w in re.findall(r"(?u)\b\w\w+\b", text.lower()) if w not in stops]


def grams(text, stops):
    w = words_of(text, stops)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def fit_python(docs, max_features, max_df, stops):
    counts = [Counter(grams(t, stops)) for t in docs]
    cf, df = Counter(), Counter()
    for c in counts:
        cf.update(c)
        df.update(c.keys())
    kept = sorted((t for t in cf if df[t] <= max_df * len(docs)), key=lambda t: (-cf[t], t))[:max_features]
    return {t: (cf[t], df[t], math.log((1 + len(docs)) / (1 + df[t])) + 1) for t in kept}


def weigh_python(text, vocab, stops):
    w = {t: n * vocab[t][2] for t, n in Counter(grams(text, stops)).items() if t in vocab}
    norm = math.sqrt(sum(x * x for x in w.values()))
    return {t: x / norm for t, x in w.items()}


def corpus_texts():
    rng = random.Random(11)
    words = ["alpha", "beta", "gamma", "delta", "épsilon", "the", "zeta_1", "x", "of", "Eta", "42"]
    out = [" ".join(rng.choices(words, k=rng.randrange(0, 40))) for _ in range(60)]
    return out + ["", "the of", "common " * 30] + ["common word"] * 3


@pytest.mark.parametrize("max_features,inline", [(5, 5000), (12, 5000), (12, 0), (1000, 5000), (1000, 0)])
def test_keyword_index(rows, monkeypatch, max_features, inline):
    monkeypatch.setattr(tfidf, "_INLINE_WORDS", inline)
    texts = corpus_texts()
    stops = set(C.STOP_WORDS)
    expected = fit_python(texts, max_features, 0.95, stops)
    docs = rows("id long, content string", *enumerate(texts))
    index = tfidf.fit(docs, max_features=max_features)
    vocab = {r["term"]: r for r in index.vocab.collect()}
    assert {t: (r["cf"], r["df"]) for t, r in vocab.items()} == {t: v[:2] for t, v in expected.items()}
    assert all(abs(vocab[t]["idf"] - v[2]) < 1e-12 for t, v in expected.items())
    terms = {r["term_id"]: t for t, r in vocab.items()}
    got = {r["id"]: {terms[e["i"]]: e["w"] for e in r["vec"]} for r in index.vectors.collect()}
    for i, text in enumerate(texts):
        want = weigh_python(text, expected, stops)
        assert got.get(i, {}) == pytest.approx(want)


def test_keyword_top_k(rows):
    texts = corpus_texts()
    stops = set(C.STOP_WORDS)
    expected = fit_python(texts, 1000, 0.95, stops)
    index = tfidf.fit(rows("id long, content string", *enumerate(texts)))
    asked = ["alpha beta", "nothing known", "common word gamma", ""]
    out = tfidf.keyword_top_k(index, rows("query_id long, query string", *enumerate(asked)), 4).collect()
    got = {}
    for r in sorted(out, key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["item_id"], round(r["score"], 9)))
    weights = [weigh_python(t, expected, stops) for t in texts]
    for q, text in enumerate(asked):
        wq = weigh_python(text, expected, stops) if any(t in expected for t in grams(text, stops)) else {}
        scores = [(i, round(sum(x * w.get(t, 0) for t, x in wq.items()), 9)) for i, w in enumerate(weights)]
        want = [s for s in sorted(scores, key=lambda s: (-s[1], s[0]))[:4] if s[1] > 0]
        assert [i for i, _ in got.get(q, [])] == [i for i, _ in want]
        assert [s for _, s in got.get(q, [])] == pytest.approx([s for _, s in want])


# --- merging --------------------------------------------------------------------------


def hits(rows, *triples):
    return rows("query_id long, item_id long, score double, rank int", *triples)


def test_hybrid_merge(rows):
    semantic = hits(rows, (1, 10, 0.9, 1), (1, 11, 0.5, 2))
    keyword = hits(rows, (1, 11, 0.8, 1), (1, 12, 1.0, 2))
    merged = retrieval.merge_hits(retrieval.hits_union(semantic, keyword))
    out = [(r["item_id"], round(r["relevance_score"], 6), r["retrieval_method"])
           for r in sorted(retrieval.cut_ranked(merged, 3).collect(), key=lambda r: r["rank"])]
    assert out == [(10, 0.63, "semantic-pinecone"), (11, 0.59, "hybrid"), (12, 0.3, "keyword-tfidf")]


def test_flat_semantic_scores_keep_keyword_only_documents_out(rows):
    semantic = hits(rows, (1, 10, -0.1, 1), (1, 11, -0.2, 2))
    keyword = hits(rows, (1, 12, 1.0, 1))
    merged = retrieval.merge_hits(retrieval.hits_union(semantic, keyword, "l2"))
    out = [r["item_id"] for r in sorted(retrieval.cut_ranked(merged, 2).collect(), key=lambda r: r["rank"])]
    assert out == [10, 11]


def test_weights_are_normalised_and_must_not_vanish(rows):
    one = hits(rows, (1, 10, 1.0, 1))
    out = retrieval.hits_union(one, one, semantic_weight=3, keyword_weight=1).collect()
    assert sorted(r["relevance_score"] for r in out) == [0.25, 0.75]
    with pytest.raises(ValueError):
        retrieval.hits_union(one, one, semantic_weight=0, keyword_weight=0)


def test_domain_or_public(rows):
    df = rows(
        "query_id long, rank int, domain string, wanted_domain string",
        (1, 1, "hr", "hr"), (1, 2, "public", "hr"), (2, 1, "legal", "hr"), (2, 2, "public", "hr"), (3, 1, "legal", "hr"),
    )
    out = {(r["query_id"], r["domain"]) for r in retrieval.domain_or_public(df).collect()}
    assert out == {(1, "hr"), (2, "public")}


def test_context_and_sources(rows):
    df = rows(
        "query_id long, rank int, id string, title string, domain string, content string",
        (1, 2, "b", None, None, "two %s {x}"), (1, 1, "a", "A", "hr", "one"),
    )
    out = retrieval.assemble_context(df).first()
    assert out["context"] == "[Document 1: A]\none\n\n[Document 2: Untitled]\ntwo %s {x}\n"
    assert [tuple(s) for s in out["sources"]] == [("A", "a", "hr"), ("Untitled", "b", "unknown")]
    assert retrieval.assemble_context(df, numbered=False).first()["context"].startswith("[A]\none\n")


def test_routing_ties_go_to_the_first_topic(spark, rows):
    from custodia import rules

    asked = rows("query_id long, query string", (1, "Revenue and benefits"), (2, "HIPAA medical sales"), (3, "hello"))
    out = {r["query_id"]: r["routed_domain"] for r in retrieval.route_queries(asked, rules.routing_topics(spark)).collect()}
    assert out == {1: "finance", 2: "health", 3: "none"}


def test_plan_results_keep_the_last_task_of_an_agent(rows):
    plans = rows(
        "query_id long, plan array<struct<agent:string,task:string,priority:int>>",
        (1, [("retriever", "late", None), ("poet", "early", 1), ("analyst", "no tool", 2), ("validator", "v", 5)]),
    )
    tools = rows("agent string, tool string", ("retriever", "fetch"), ("validator", "check"))
    out = {r["agent"]: (r["task"], r["priority"]) for r in governed.run_task_plan(plans, tools).collect()}
    assert out == {"retriever": ("late", 999), "validator": ("v", 5)}
    steps = {r["task"]: r["step"] for r in governed.plan_steps(plans).collect()}
    assert steps == {"early": 1, "no tool": 2, "v": 3, "late": 4}


# --- vector store ---------------------------------------------------------------------


def test_upsert_and_delete(rows):
    schema = "vector_id string, id string, namespace string, version int, title string"
    store = rows(schema, ("a_x", "a", "x", 1, "old"), ("b_x", "b", "x", 1, "old"), ("a_y", "a", "y", 1, "old"))
    changes = rows(schema, ("a_x", "a", "x", 2, "mid"), ("a_x", "a", "x", 3, "new"), ("c_x", "c", "x", 2, "new"))
    out = vector_store.upsert(store, changes)
    assert {(r["vector_id"], r["title"]) for r in out.collect()} == {
        ("a_x", "new"), ("b_x", "old"), ("a_y", "old"), ("c_x", "new"),
    }
    left = vector_store.delete_ids(out, rows("id string", ("a",), ("c",)), "x")
    assert {r["vector_id"] for r in left.collect()} == {"b_x", "a_y"}
    assert {r["vector_id"] for r in vector_store.delete_namespace(out, "x").collect()} == {"a_y"}


DOCUMENT = "id long, title string, domain string, classification string, author string, date string, content string"


def _documents(rows, ids, text="text {}"):
    return rows(DOCUMENT, *[(i, f"t{i}", "hr", None, None, None, text.format(i)) for i in ids])


def _model():
    def model(texts):
        if texts.str.contains("boom").any():
            raise RuntimeError("no model")
        return [[float(len(t)), 1.0] for t in texts]

    return model


def test_a_failing_batch_leaves_the_others_loaded(rows, spark, tmp_path):
    path = str(tmp_path / "store")
    old = rows("vector_id string, id long, namespace string, version int, title string, domain string, classification string,"
               "author string, date string, content_preview string, content_length long, embedding array<float>",
               ("150_x", 150, "x", 0, "old", "hr", "", "", "", "", 0, [0.0, 0.0]), ("900_x", 900, "x", 0, "old", "hr", "", "", "", "", 0, [0.0, 0.0]))
    vector_store.write_store(old, path, buckets=3)
    docs = _documents(rows, range(250)).withColumn("content", F.expr("if(id = 130, 'boom', content)")).repartition(7)
    loads = vector_store.load_into(docs, path, _model(), "x", dim=2, position="id", buckets=3)
    found = {r["batch"]: (r["documents"], r["failed"], r["error"]) for r in loads.collect()}
    assert found == {0: (100, False, None), 1: (100, True, "RuntimeError: no model"), 2: (50, False, None)}
    store = {r["id"]: r for r in spark.read.parquet(path).collect()}
    assert set(store) == {*range(100), *range(200, 250), 150, 900}
    assert store[150]["title"] == "old" and store[7]["title"] == "t7" and store[7]["embedding"] == [6.0, 1.0]
    # the mended load under the same name replaces its rows
    again = vector_store.load_into(_documents(rows, range(250)), path, _model(), "x", dim=2, position="id", buckets=3)
    assert [r["failed"] for r in again.collect()] == [False] * 3
    assert vector_store.loads_of(spark, path).count() == 3
    vector_store.load_into(_documents(rows, [300]), path, _model(), "x", dim=2, load_id="2", buckets=3)
    assert vector_store.loads_of(spark, path).count() == 4 and spark.read.parquet(path).count() == 252


@pytest.mark.parametrize("parts", [1, 3])
def test_batches_where_documents_lie(rows, parts):
    calls = rows(DOCUMENT).sparkSession.sparkContext.accumulator(0)

    answer = _model()

    def model(texts):
        assert 0 < len(texts) <= 100
        calls.add(1)
        return answer(texts)

    done = vector_store.embed_batches(_documents(rows, range(730)).coalesce(1).repartition(parts), model, dim=2).collect()
    loads = [r["load"] for r in done if r["load"]]
    assert sum(b["documents"] for b in loads) == 730 and all(b["documents"] == 100 for b in loads if b["documents"] > 50)
    assert sorted(r["id"] for r in done if r["load"] is None) == list(range(730))
    assert calls.value == len(loads) <= 8 + parts


@pytest.mark.parametrize("model", [
    lambda texts: [[1.0]] * len(texts), lambda texts: [[1.0, 2.0]] * (len(texts) + 1), lambda texts: None, lambda texts: [["x", "y"]] * len(texts),
])
def test_wrong_answers_fail_their_batch(rows, model):
    done = vector_store.embed_batches(_documents(rows, range(3)), model, dim=2).collect()
    assert all(r["load"]["failed"] and r["load"]["error"] for r in done) and sum(r["load"]["documents"] for r in done) == 3


def test_nothing_to_load(rows):
    assert vector_store.embed_batches(_documents(rows, []), _model()).count() == 0
    nulls = _documents(rows, [1]).withColumn("content", F.lit(None).cast("string"))
    done = vector_store.embed_batches(nulls, lambda texts: [[float(t is None)] for t in texts]).collect()
    assert [r["embedding"] for r in done if r["load"] is None] == [[1.0]]


def test_first_document_per_id(rows):
    df = rows("id string, position long, title string", ("a", 3, "late"), ("a", 1, "first"), ("b", 2, "b"))
    out = {r["id"]: r["title"] for r in retrieval.first_by_id(df).collect()}
    assert out == {"a": "first", "b": "b"}


def test_positions_that_are_no_numbers_are_skipped(rows):
    found = rows("query_id long, doc_index string", (1, "0.0"), (2, "1"), (3, "x"), (4, None), (5, "-1"), (6, "7"))
    docs = rows("position long, title string", (0, "zero"), (1, "one"))
    out = {r["query_id"]: r["title"] for r in retrieval.hits_by_position(found, docs).collect()}
    assert out == {1: "zero", 2: "one"}


# --- empty inputs ---------------------------------------------------------------------


@pytest.mark.parametrize("path", [0, 1 << 20])
def test_no_queries_or_no_items(rows, path):
    items = rows("id long, embedding array<double>", (1, [1.0, 0.0]))
    queries = rows("query_id long, embedding array<double>", (1, [1.0, 1.0]))
    assert topk.top_k(items, queries.limit(0), 3, 2, broadcast_bytes=path).count() == 0
    assert topk.top_k(items.limit(0), queries, 3, 2, broadcast_bytes=path).count() == 0


def test_corpus_without_terms(rows):
    docs = rows("id long, content string", (1, ""), (2, "a"), (3, None))
    index = tfidf.fit(docs)
    assert index.vocab.count() == 0 and index.vectors.count() == 0
    asked = rows("query_id long, query string", (1, "anything"))
    assert tfidf.keyword_top_k(index, asked, 3).count() == 0


@pytest.mark.parametrize("path", [0, 1 << 20])
def test_string_ids(rows, path):
    items = rows("id string, embedding array<double>", ("doc_2", [1.0, 0.0]), ("doc_10", [1.0, 0.0]), ("é", [0.0, 1.0]))
    queries = rows("query_id string, embedding array<double>", ("q", [1.0, 0.1]), ("r", [0.0, 1.0]))
    out = topk.top_k(items, queries, 2, 2, broadcast_bytes=path)
    assert {(r["query_id"], r["rank"]): r["item_id"] for r in out.collect()} == {
        ("q", 1): "doc_10", ("q", 2): "doc_2", ("r", 1): "é", ("r", 2): "doc_10",
    }


def test_hybrid_with_string_ids(rows):
    docs = rows("id string, content string", ("a", "alpha beta"), ("b", "beta gamma"), ("c", "delta"))
    index = tfidf.fit(docs)
    vecs = rows("id string, embedding array<double>", ("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [-1.0, 0.0]))
    asked = rows("query_id string, query string, embedding array<double>", ("q", "gamma", [1.0, 0.0]))
    out = retrieval.hybrid_retrieve(vecs, index, asked, k=2, dim=2).collect()
    assert [(r["item_id"], r["retrieval_method"]) for r in sorted(out, key=lambda r: r["rank"])] == [
        ("a", "semantic-pinecone"), ("b", "hybrid"),
    ]


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_scoring_a_block_keeps_few_scores_at_once(metric):
    """A task's memory follows its block of queries: 20 million scores are made, 1 million at a time."""
    rng = np.random.default_rng(1)
    queries, items = rng.normal(size=(2000, 8)), rng.normal(size=(10_000, 8))
    items[:3], items[3, 0] = 0, np.nan
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), pa.array(items.tolist(), pa.list_(pa.float64()))], ["id", "vec"])
    tracemalloc.start()
    found = topk._score_batches([batch], np.arange(2000), queries, 3, metric, ("long", "long"))
    assert tracemalloc.get_traced_memory()[1] < 60 << 20
    tracemalloc.stop()
    if metric == "cosine":
        sizes = np.linalg.norm(queries[:20], axis=1)[:, None] * np.linalg.norm(items, axis=1)
        scores = np.divide(queries[:20] @ items.T, sizes, out=np.zeros((20, 10_000)), where=sizes > 0)
        want = np.lexsort((np.broadcast_to(np.arange(10_000), scores.shape), -np.round(scores, 9)))[:, :3]
        assert found.column("item_id").to_numpy()[:60].reshape(20, 3).tolist() == want.tolist()

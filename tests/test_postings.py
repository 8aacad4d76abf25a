"""The inverted index against scoring every document."""

import numpy as np
import pyarrow as pa
import pytest
from custodia.operators import postings

DIM = 50


def sparse(rng, n, most, zipf=True):
    """Unit vectors of few terms, low terms being common; some are empty, some are copies."""
    share = 1 / np.arange(1, DIM + 1) if zipf else np.ones(DIM)
    out = []
    for _ in range(n):
        terms = np.unique(rng.choice(DIM, size=rng.integers(0, most + 1), p=share / share.sum()))
        weights = rng.random(len(terms)).round(3) + 0.001
        out.append({int(t): float(w) for t, w in zip(terms, weights / np.linalg.norm(weights))} if len(terms) else {})
    out[n // 2 :: 4] = [out[0]] * len(out[n // 2 :: 4])
    return out


def brute(queries, items, k):
    out = {}
    for q, query in enumerate(queries):
        scores = [(-round(sum(w * item.get(t, 0) for t, w in query.items()), 9), i) for i, item in enumerate(items)]
        out[q] = [(i, -s) for s, i in sorted(x for x in scores if x[0] < 0)[:k]]
    return {q: found for q, found in out.items() if found}


SCHEMA = "array<struct<i:int,w:double>>"


def vectors(rows, schema, values, name=lambda i: i):
    return rows(schema, *[(name(i), sorted(v.items())) for i, v in enumerate(values)])


def searched(items, queries, k, **options):
    segments = postings.build(items)
    found = postings.top_k(segments, postings.champions(segments), queries, k, DIM, **options).collect()
    out = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["item_id"], r["score"]))
    return out


@pytest.mark.parametrize("k", [1, 4, postings.CHAMPIONS + 20])
@pytest.mark.parametrize("segment", [7, 100, 8192])
def test_search_is_exact(rows, monkeypatch, k, segment):
    monkeypatch.setattr(postings, "SEGMENT_DOCS", segment)
    rng = np.random.default_rng(segment)
    items, queries = sparse(rng, 400, 8), sparse(rng, 60, 4)
    got = searched(vectors(rows, f"id long, vec {SCHEMA}", items), vectors(rows, f"query_id long, vec {SCHEMA}", queries), k)
    assert got == brute(queries, items, k)


def test_blocks_of_queries_and_names(rows, monkeypatch):
    monkeypatch.setattr(postings, "SEGMENT_POSTINGS", 60)
    rng = np.random.default_rng(3)
    items, queries = sparse(rng, 120, 5), sparse(rng, 40, 3)
    got = searched(
        vectors(rows, f"id string, vec {SCHEMA}", items, lambda i: f"d{i:03}"),
        vectors(rows, f"query_id string, vec {SCHEMA}", queries, str), 3, query_bytes=2_000,
    )
    want = brute(queries, items, 3)
    assert got == {str(q): [(f"d{i:03}", s) for i, s in found] for q, found in want.items()}


def test_nothing_to_find(rows):
    items = rows(f"id long, vec {SCHEMA}", (1, [(3, 1.0)]), (2, []), (3, None))
    queries = rows(f"query_id long, vec {SCHEMA}", (1, [(4, 1.0)]), (2, []), (3, None), (4, [(3, 0.5)]))
    assert searched(items, queries, 5) == {4: [(1, 0.5)]}
    assert searched(items.filter("id > 9"), queries, 5) == {}
    assert searched(items, queries.filter("query_id > 9"), 5) == {}


def in_memory(items, queries, k, floors=True):
    """What searching one segment after the other touches, and all postings of the queries' terms."""
    entry = pa.struct([("i", pa.int32()), ("w", pa.float64())])
    asked = pa.array([[{"i": t, "w": w} for t, w in sorted(q.items())] for q in queries], pa.list_(entry))
    every = {t: sorted((v[t] for v in items if t in v), reverse=True) for t in range(DIM)}
    some = postings.Queries.of(np.arange(len(queries)), asked, every if floors else {}, k)
    counted, matching = postings.Searched(), 0
    for at in range(0, len(items), 100):
        part = items[at : at + 100]
        lists = {t: ([i for i, v in enumerate(part) if t in v], [v[t] for v in part if t in v]) for t in range(DIM)}
        lists = {t: (np.array(d, np.uint16), np.array(w)) for t, (d, w) in lists.items() if d}
        bounds = np.array([lists[t][1].max() if t in lists else 0.0 for t in range(DIM)])
        postings.search_segment(some, some.floor.copy(), k, lists, bounds, np.arange(len(part)), counted)
        matching += sum(len(lists[t][0]) for q in queries for t in q if t in lists)
    return counted, matching


def test_work_follows_matching_postings():
    rng = np.random.default_rng(5)
    items, queries = sparse(rng, 3000, 8), sparse(rng, 200, 4)
    without, matching = in_memory(items, queries, 3, floors=False)
    assert 0 < without.postings + without.lookups <= matching  # no posting twice, and nothing else
    bounded, _ = in_memory(items, queries, 3)
    assert bounded.postings + bounded.lookups < 0.9 * matching and bounded.skipped > without.skipped
    # twice the documents without the terms asked for cost nothing
    more, _ = in_memory(items + [{DIM - 1: 1.0}] * 3000, [{t: w for t, w in q.items() if t < DIM - 1} for q in queries], 3)
    less, _ = in_memory(items, [{t: w for t, w in q.items() if t < DIM - 1} for q in queries], 3)
    assert more.postings == less.postings


def test_champions_are_the_greatest_weights(rows, monkeypatch):
    monkeypatch.setattr(postings, "CHAMPIONS", 5)
    monkeypatch.setattr(postings, "SEGMENT_DOCS", 50)
    items = sparse(np.random.default_rng(7), 500, 6)
    got = postings.champions(postings.build(vectors(rows, f"id long, vec {SCHEMA}", items)))
    want = {t: sorted((v[t] for v in items if t in v), reverse=True)[:5] for t in range(DIM)}
    assert got == {t: w for t, w in want.items() if w}


def test_a_search_reads_the_columns_of_its_terms(rows):
    items = rows(f"id long, vec {SCHEMA}", (1, [(3, 0.6), (4, 0.8)]))
    segments = postings.build(items)
    some = postings.Queries(np.arange(1), np.zeros(1, int), np.array([3 + postings.BLOCKS]), np.ones(1), np.full(1, -np.inf))
    plan = postings._best_of_block(segments, some, 1, DIM, ("long", "long"))._jdf.queryExecution().optimizedPlan().toString()
    assert "b3#" in plan and "ids#" in plan

"""Floors of the keyword search rise while a segment is searched, and counts are added up before they are handed on."""

import numpy as np
import pyarrow as pa
from custodia.operators import postings, tfidf


def sparse_rows(rng, n, terms, most):
    out = np.zeros((n, terms))
    for row in out:
        some = rng.choice(terms, size=rng.integers(1, most + 1), replace=False)
        row[some] = rng.random(len(some)) + 1e-3
    return out / np.linalg.norm(out, axis=1)[:, None]


def test_weak_floors_rise_within_a_segment():
    rng = np.random.default_rng(7)
    n, terms, k = 4 * postings.ROUND_DOCS - 100, 40, 3
    items, asked = sparse_rows(rng, n, terms, 12), sparse_rows(rng, 60, terms, 9)
    row, term = np.nonzero(asked)
    floor, counted = np.full(60, 1e-6), postings.Searched()
    lists = {t: (np.flatnonzero(items[:, t]), items[items[:, t] > 0, t]) for t in range(terms)}
    queries = postings.Queries(np.arange(60), row, term, asked[row, term], floor.copy())
    q, d, s = postings.search_bytes(queries, np.ones(60, bool), floor, k, lists, items.max(axis=0), np.arange(n), counted)
    scores = np.round(asked @ items.T, 9)
    want = [d for row in scores for d in np.lexsort((np.arange(n), -row))[:k].tolist()]
    assert d.tolist() == want and np.allclose(floor, -np.sort(-scores, axis=1)[:, k - 1], atol=2e-9)
    # the first round meets all documents that share a term, the others few
    assert counted.scored < 0.4 * int((scores > 0).sum())


def test_floors_come_from_some_segments(rows, monkeypatch):
    monkeypatch.setattr(postings, "SEGMENT_DOCS", 50)
    rng, k, schema = np.random.default_rng(4), 3, "id long, vec array<struct<i:int,w:double>>"
    items, asked = sparse_rows(rng, 800, 30, 9), sparse_rows(rng, 40, 30, 6)
    vectors = lambda m: [(i, [(int(t), float(r[t])) for t in np.flatnonzero(r)]) for i, r in enumerate(m)]
    segments = postings.build(rows(schema, *vectors(items)).coalesce(1)).cache()
    assert segments.count() >= 16
    found = {}
    for share in (16, 4):
        monkeypatch.setattr(postings, "FLOOR_SHARE", share)
        got = postings._with_floors(rows(schema, *vectors(asked)), segments, {}, k, 30, "long").collect()
        found[share] = np.array([r["floor"] for r in sorted(got, key=lambda r: r["id"])])
    true = -np.sort(-np.round(asked @ items.T, 9), axis=1)[:, k - 1]
    assert (found[4] <= true + 1e-9).all() and (found[4] >= found[16]).all() and (found[4] > found[16]).mean() > 0.5


def test_documents_lie_by_their_heaviest_terms():
    lengths = np.array([2, 0, 1, 3, 2])
    terms, weights = np.array([1, 2, 7, 0, 2, 5, 1, 2]), np.array([0.1, 0.9, 1.0, 0.2, 0.8, 0.1, 0.9, 0.1])
    assert postings._by_heaviest(lengths, terms, weights).tolist() == [1, 4, 3, 0, 2]


def batch(terms, cf, df):
    return pa.RecordBatch.from_arrays([pa.array(terms), pa.array(cf), pa.array(df)], ["term", "cf", "df"])


def test_a_task_hands_on_a_term_once(monkeypatch):
    steps = [batch(["a", f"b{i}", "c"], [3, 1, 2], [2, 1, 1]) for i in range(100)]
    out = [r for b in tfidf._added_up(iter(steps)) for r in b.to_pylist()]
    assert len(out) == 102 and {"term": "a", "cf": 300, "df": 200} in out
    monkeypatch.setattr(tfidf, "_COUNTS_KEPT", 20)
    monkeypatch.setattr(tfidf, "_ROWS_OUT", 7)
    parts = list(tfidf._added_up(iter(steps)))
    assert all(b.num_rows <= 7 for b in parts) and sum(r["cf"] for b in parts for r in b.to_pylist()) == 600
    assert sum(r["df"] for b in parts for r in b.to_pylist() if r["term"] == "a") == 200
    assert list(tfidf._added_up(iter([]))) == []

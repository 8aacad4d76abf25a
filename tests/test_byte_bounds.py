"""Scores bounded in bytes: no document is lost, and few are scored."""

import numpy as np
import pytest
from custodia.operators import postings

DIM = 60


def unit_rows(rng, n, most):
    """A dense matrix of sparse unit vectors; low terms are common, and some rows are copies."""
    share = 1 / np.arange(1, DIM + 1)
    out = np.zeros((n, DIM))
    for row in out:
        terms = np.unique(rng.choice(DIM, size=rng.integers(1, most + 1), p=share / share.sum()))
        row[terms] = rng.random(len(terms)) ** 3 + 1e-6  # some weights are very small
    out[n // 2 :: 5] = out[0]
    return out / np.linalg.norm(out, axis=1)[:, None]


def searched(items, asked, k, floor):
    row, term = np.nonzero(asked)
    queries = postings.Queries(np.arange(len(asked)), row, term, asked[row, term], floor)
    lists = {t: (np.flatnonzero(items[:, t]), items[items[:, t] > 0, t]) for t in range(DIM) if items[:, t].any()}
    bounds, counted = items.max(axis=0), postings.Searched()
    chosen = postings.bounded_in_bytes(queries, floor, bounds)
    found = postings.search_bytes(queries, chosen, floor.copy(), k, lists, bounds, np.arange(len(items)) * 3, counted)
    return chosen, list(zip(*(x.tolist() for x in found))), counted


@pytest.mark.parametrize("n", [50, 1001])  # a segment's width is no multiple of 8
@pytest.mark.parametrize("share", [0.3, 0.999999, 1.0])
@pytest.mark.parametrize("row_bytes", [2_000, 64 << 20])
def test_no_document_is_lost(monkeypatch, n, share, row_bytes):
    monkeypatch.setattr(postings, "ROW_BYTES", row_bytes)
    rng = np.random.default_rng(n)
    items, asked, k = unit_rows(rng, n, 9), unit_rows(rng, 90, 25), 4
    scores = np.round(asked @ items.T, 9)
    floor = -np.sort(-scores, axis=1)[:, k - 1] * share
    chosen, found, _ = searched(items, asked, k, floor)
    assert chosen.sum() > 80
    want = []
    for q in np.flatnonzero(chosen).tolist():
        best = np.lexsort((np.arange(n), -scores[q]))[:k]
        want += [(q, d, scores[q, d]) for d in best.tolist()]
    assert [f[:2] for f in found] == [w[:2] for w in want]
    assert np.allclose([f[2] for f in found], [w[2] for w in want], atol=2e-9)


def test_few_documents_are_scored():
    rng = np.random.default_rng(8)
    items, asked, k = unit_rows(rng, 4000, 20), unit_rows(rng, 200, 12), 3
    items[2000::5] = unit_rows(rng, len(items[2000::5]), 20)  # no copies
    floor = -np.sort(-np.round(asked @ items.T, 9), axis=1)[:, k - 1]
    _, found, counted = searched(items, asked, k, floor)
    matching = int(((asked > 0).astype(int) @ (items > 0).astype(int).T).sum())
    # a posting is read once for all queries
    assert counted.postings < 0.05 * matching and len(found) <= counted.scored < 0.05 * counted.bounded


def test_one_segment_gives_floors(rows):
    rng = np.random.default_rng(4)
    items, asked, k = unit_rows(rng, 300, 9), unit_rows(rng, 40, 6), 3
    schema = "array<struct<i:int,w:double>>"
    vectors = lambda m: [(i, [(int(t), float(r[t])) for t in np.flatnonzero(r)]) for i, r in enumerate(m)]
    segments = postings.build(rows(f"id long, vec {schema}", *vectors(items)))
    got = postings._with_floors(rows(f"id long, vec {schema}", *vectors(asked)), segments, {}, k, DIM, "long").collect()
    true = -np.sort(-np.round(asked @ items.T, 9), axis=1)[:, k - 1]
    assert len(got) == 40 and all(r["floor"] <= true[r["id"]] + 1e-9 for r in got)
    assert any(r["floor"] > 0 for r in got)

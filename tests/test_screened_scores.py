"""Vector search: pairs are screened in single precision, none of the best is lost, and few are scored."""

import numpy as np
import pyarrow as pa
import pytest
from custodia.operators import topk


def batches(items, size=700):
    ids, rows = np.arange(len(items)), pa.array(items.tolist(), pa.list_(pa.float64()))
    whole = pa.RecordBatch.from_arrays([pa.array(ids), rows], ["id", "vec"])
    return [whole.slice(a, size) for a in range(0, len(items), size)]


def found(items, queries, k, metric):
    out = topk._score_batches(batches(items), np.arange(len(queries)), queries, k, metric, ("long", "long"))
    return list(zip(*(out.column(i).to_pylist() for i in range(3))))


def wanted(items, queries, k, metric):
    scores = topk._scores(queries, items, metric, topk._sizes(queries, metric), topk._sizes(items, metric))
    ids = np.arange(len(items))
    return [(q, int(d), row[d]) for q, row in enumerate(scores) for d in np.lexsort((ids, -row))[:k].tolist()]


def made(kind, n, seed):
    rng = np.random.default_rng(seed)
    out = rng.normal(size=(n, 16))
    if kind == "near ties":  # apart by less than single precision tells
        out = rng.normal(size=16) + 1e-7 * out
    elif kind == "copies":
        out[n // 3 :] = out[rng.integers(0, 3, n - n // 3)]
    elif kind == "lengths":
        out *= 10.0 ** rng.integers(-20, 20, (n, 1))
    out[5] = 0
    return out


@pytest.mark.parametrize("kind", ["plain", "near ties", "copies", "lengths"])
@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_the_best_are_those_of_all_scores(kind, metric):
    items, queries = made(kind, 3000, 1), made(kind, 60, 1)
    got, want = found(items, queries, 4, metric), wanted(items, queries, 4, metric)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], rtol=1e-12, atol=2e-9)
    if kind in ("plain", "copies"):
        assert [g[:2] for g in got] == [w[:2] for w in want]


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_vectors_without_a_length(metric):
    items, queries = made("plain", 900, 1), made("plain", 30, 2)
    items[7], items[800], queries[3] = 1e200, np.inf, 1e200
    with np.errstate(all="ignore"):
        got = found(items, queries, 3, metric)
    usual = np.delete(np.arange(30), 3)
    finite = np.delete(np.arange(900), [7, 800])
    for q in usual.tolist():
        mine = {g[1] for g in got if g[0] == q} - {7, 800}
        best = [finite[d] for _, d, _ in wanted(items[finite], queries[[q]], 3, metric)]
        assert mine == set(best[: len(mine)])


def test_few_pairs_are_scored(monkeypatch):
    """Every pair used to be scored in double precision."""
    scored, real, dense = [], topk._pair_scores, topk._scores
    monkeypatch.setattr(topk, "_pair_scores", lambda q, *rest: scored.append(len(q)) or real(q, *rest))
    monkeypatch.setattr(topk, "_scores", lambda q, i, *rest: scored.append(len(q) * len(i)) or dense(q, i, *rest))
    items, queries = made("plain", 20_000, 1), made("plain", 200, 2)[10:]
    found(items, queries, 5, "cosine")
    assert sum(scored) < 0.01 * len(items) * len(queries)

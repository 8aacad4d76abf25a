"""Bounds are added up eight bytes at a time in arrays that are used again; squared lengths are part of the product."""

import tracemalloc

import numpy as np
from custodia.operators import postings, topk


def test_sums_of_eight_bytes_do_not_carry():
    rng = np.random.default_rng(3)
    lines = rng.integers(0, 86, (40, 24), dtype=np.uint8)  # three of them reach 255 at most
    lines[0], lines[-1] = 85, 0
    table = rng.integers(0, 40, (7, 3))
    table[0], table[1, 1:] = 0, 39
    least = rng.integers(1, 256, 7).astype(np.uint8)
    least[0] = 255
    space = [np.full((9, 3), 7, np.uint64), np.full((9, 3), 9, np.uint64), np.ones((9, 24), bool)]
    for some in (slice(0, 7), slice(5, 7)):  # what an earlier group left is not met again
        found = postings._reaching(lines.view(np.uint64), table[some], least[some], space)
        want = lines[table[some]].astype(int).sum(axis=1) >= least[some][:, None]
        assert (found.reshape(want.shape) == want).all()


def searched_documents(n, terms, queries):
    rng = np.random.default_rng(5)
    items = rng.random((n, terms))
    items /= np.linalg.norm(items, axis=1)[:, None]
    lists = {t: (np.arange(n), items[:, t].copy()) for t in range(terms)}
    asked = rng.random((queries, terms))
    row, term = np.nonzero(asked)
    floor = np.full(queries, 1e-6)
    weighed = postings.Queries(np.arange(queries), row, term, asked[row, term], floor)
    found = postings.search_bytes(weighed, np.ones(queries, bool), floor, 3, lists, items.max(axis=0), np.arange(n), postings.Searched())
    best = -np.sort(-np.round(asked @ items.T, 9), axis=1)[:, :3]
    assert np.allclose(found[2].reshape(queries, 3), best, atol=2e-9)


def test_weak_floors_score_a_bounded_number_of_pairs_at_a_time(monkeypatch):
    monkeypatch.setattr(postings, "PAIRS", 20_000)
    made = []
    plain = np.einsum
    monkeypatch.setattr(postings.np, "einsum", lambda how, a, b: made.append(a.size) or plain(how, a, b))
    searched_documents(2000, 30, 40)
    assert sum(made) == 2000 * 30 * 40 and max(made) <= 20_000


def test_squared_lengths_take_no_array_of_their_own():
    rng = np.random.default_rng(2)
    items, asked = rng.random((2000, 16)), rng.random((500, 16))
    sizes = (items**2).sum(axis=1)
    screen = topk._Screen(items, sizes, "l2", {})
    floor = np.full(500, -1.0)
    screen.stand_ins(asked, (asked**2).sum(axis=1), floor, 3)  # its arrays are made
    tracemalloc.start()
    product, least = screen.stand_ins(asked, (asked**2).sum(axis=1), floor, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < product.nbytes / 4
    scores = 2 * asked @ items.T - (asked**2).sum(axis=1)[:, None] - sizes
    assert (product >= least[:, None])[scores >= -1.0].all()

"""Terms of many texts are counted a part at a time; nothing is lost at the edges of a part."""

from collections import Counter

import pyarrow as pa
import pytest
from custodia.operators import tfidf

LISTS = [["a", "b", "a"], None, [], ["c"] * 5, ["a"], ["b", "c"], [], ["d", "a", "d"]]


@pytest.mark.parametrize("most", [1, 3, 4, 100])
def test_parts_hold_every_term_once(monkeypatch, most):
    monkeypatch.setattr(tfidf, "_TERMS_PER_STEP", most)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(LISTS))), pa.array(LISTS, pa.list_(pa.string()))], ["id", "c"])
    seen = []
    for part, rows, encoded in tfidf._listed_terms([batch.slice(1), batch.slice(0, 1)], 1):
        terms = encoded.to_pylist()
        assert len(terms) <= most or len(set(rows.tolist())) == 1
        seen += zip(part.column(0).take(pa.array(rows)).to_pylist(), terms)
    assert Counter(seen) == Counter((i, t) for i, terms in enumerate(LISTS) for t in terms or [])


def test_counts_of_terms_and_of_rows(rows):
    counted = tfidf._stats(tfidf._counts(rows("w array<string>", *[(terms,) for terms in LISTS])))
    every = Counter(t for terms in LISTS for t in terms or [])
    once = Counter(t for terms in LISTS for t in set(terms or []))
    assert {r["term"]: (r["cf"], r["df"]) for r in counted.collect()} == {t: (every[t], once[t]) for t in every}

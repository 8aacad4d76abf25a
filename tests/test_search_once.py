"""Hits are written before documents are fetched for them: a lazy ranking would be searched again for each use."""

import pytest
from custodia.operators import retrieval
from custodia.plans import load_all


@pytest.mark.parametrize("name", "domain_or_public validation_counts extract_sources build_context retrieve_by_domain domain_postfilter".split())
def test_documents_are_fetched_for_stored_hits(spark, monkeypatch, name):
    plans, real = [], retrieval.with_documents

    def spy(hits, *rest, **options):
        plans.append(hits._jdf.queryExecution().optimizedPlan().toString())
        return real(hits, *rest, **options)

    monkeypatch.setattr(retrieval, "with_documents", spy)
    load_all().QUERIES[name](spark, "/root/testdata/sf0.001")
    assert plans and not any(step in plan for plan in plans for step in ("MapInArrow", "Window"))

"""Filter interaction audit against filters that are really applied one after the other."""

import itertools
import math
import re

import pytest
from custodia.llm import filter_audit, queries, sql
from pyspark.sql import functions as F

import compare

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_force(docs, labels):
    """(part, order, step) -> figures, from rows (id, text, part) and labels (id, quality, toxic)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    seen = {}
    for i, text, _ in docs:
        if i is not None:
            seen[text or ""] = min(seen.get(text or "", i), i)

    def fails(i, text):
        text = text or ""
        words = WORD.findall(text)
        checks = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and seen[text] < i,
        }
        return {k for k, bad in checks.items() if bad}

    parts = {}
    for i, text, part in docs:
        parts.setdefault(part or "", []).append((fails(i, text), i))
    out = {}
    for part, rows in parts.items():
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                before = [r for r in rows if f in r[0] and r[0] & set(order[: step - 1])]
                total[f] += len(gone)
                out[part, order, step] = [
                    len(left), len(gone), len(before), sum(r[0] == {f} for r in rows),
                    sum(r[1] in good for r in gone), sum(r[1] in toxic for r in gone),
                ]
        for (p, order, step), figures in out.items():
            if p == part:
                figures.append(total[order[step - 1]])
    return out


FIGURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def figures(df):
    rows = df.collect()
    found = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in FIGURES] for r in rows}
    assert len(found) == len(rows)
    return found


PROSE = " ".join(f"word{i}" for i in range(250))
ODD = [
    (1, PROSE, "a"), (2, PROSE, "a"), (2, PROSE, "b"), (3, PROSE + " #", "b"), (3, PROSE + " #", "b"), (None, PROSE, "a"),
    (None, None, None), (4, None, ""), (5, "", None), (6, "ONE TWO", "a"), (7, "same " * 300, "a"), (8, "x " * 60_000, "a"),
    (9, "\x0b\x0c Ünï | 日本", "ü'\\"), (0, "ONE TWO", "c"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, 1), (6, 1, None), (None, 1, 1), (99, 1, 1), (0, 0, 1)]


def test_audit_of_odd_rows(spark):
    schema = "doc_id long, text string, source string, mask int, part int, n int, good string, _id int, _words int, state int"
    docs = spark.createDataFrame([(*r, 1, 2, 3, "x", 4, 5, 6) for r in ODD], schema)
    labels = spark.createDataFrame([(*r, 7) for r in LABELS], "doc_id long, quality int, toxic int, mask int")
    found = figures(filter_audit.audit(filter_audit.failure_counts(docs, labels)))
    assert found == brute_force(ODD, LABELS)


@pytest.mark.parametrize("schema", ["doc_id long, text string, source string", "doc_id string, text string, source string"])
def test_audit_of_nothing(spark, schema):
    docs = spark.createDataFrame([], schema)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.failure_counts(docs, labels)).count() == 0


def test_audit_without_labels_and_with_other_ids(spark):
    docs = spark.createDataFrame([(f"d{i}", t, s) for i, t, s in ODD if i is not None], "doc_id string, text string, source string")
    labels = spark.createDataFrame([], "doc_id string, quality int, toxic int")
    want = brute_force([(f"d{i}", t, s) for i, t, s in ODD if i is not None], [])
    assert figures(filter_audit.audit(filter_audit.failure_counts(docs, labels))) == want


def test_audit_of_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic").collect()
    found = queries.op13_filter_audit(spark, sf_dir)
    assert figures(found) == brute_force([tuple(r) for r in docs.select("doc_id", "text", "source").collect()], labels)
    assert compare.spark_rows(found) == compare.sql_rows(compare.connect(sf_dir), sql.ORACLES["op13_filter_audit"])


def test_paths_of_the_lattice_are_orders():
    for filters in range(1, 7):
        edges = filter_audit.lattice(filters)
        assert len(edges) == filters << filters >> 1
        for i in range(filters):  # every order uses one edge of each filter
            assert sum(reach * leave for _, f, reach, leave in edges if f == i) == math.factorial(filters)


def test_removals_of_all_filters_sum_to_what_an_order_removes(spark, sf_dir):
    """The Shapley sums are shares of the documents that any order removes in the end."""
    found = queries.op13_filter_audit(spark, sf_dir)
    order = found.filter(F.col("filter_order") == "ABCDE").groupBy("part").agg(
        F.sum("removed").alias("gone"), F.sum("shapley").alias("shares"))
    assert all(r.shares == 120 * r.gone for r in order.collect())

"""Phrase collocations against counting every phrase."""

import random
import re
from collections import Counter

import pytest
from custodia.llm import collocations, queries, sql

import compare

PIECE = re.compile(r"[.,;:!?\x0a-\x0d]")
WORD = re.compile(r"[^\x20\x09]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_force(rows, least, longest=5, top=2000):
    langs = {}
    for lang, text in rows:
        for piece in PIECE.split((text or "").translate(LOWER)):
            langs.setdefault("und" if lang is None else lang, []).append(WORD.findall(piece))
    out = []
    for lang, pieces in langs.items():
        n = sum(map(len, pieces))
        f = Counter(tuple(p[i : i + k]) for p in pieces for k in range(1, longest + 1) for i in range(len(p) - k + 1))
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            inside = any(
                100 * b >= 100 * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                for q, b in candidates.items()
            )
            if not inside:
                score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def found(docs, **options):
    result = collocations.mine(docs, **options)
    assert result.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, result.collect()))


def corpus(seed, texts):
    """Texts of few words, with passages that repeat, in two languages."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 3))) for _ in range(60)]
    passages = [rng.choices(words, k=rng.randint(2, 8)) for _ in range(12)]
    rows = []
    for _ in range(texts):
        parts = []
        for _ in range(rng.randint(0, 12)):
            parts += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(words)]
            if rng.random() < 0.2:
                parts[-1] += rng.choice(".,;:!?\n\r\x0b\x0c")
            if rng.random() < 0.1:
                parts[-1] = parts[-1].upper()
        rows.append((rng.choice(["en", "en", "de"]), rng.choice([" ", "\t", "  "]).join(parts)))
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus(1, 300) + [
        (None, "No lang. No lang. No lang, no lang"), (None, None), ("und", "no lang!"), ("en", None), ("en", ""), ("", "a b " * 9),
        ("e'n\\", "x y z " * 7), ("zz", " \t .,; "), ("en", "the long text goes on " * 3000), ("de", "unbroken" * 5000),
        ("nul", "\x00 \x00 \x00\x1f \x00\x1f"),
    ]


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "lang string, text string, hash int, n int, words int, _text int")


def test_every_phrase(spark, rows):
    assert found(table(spark, rows), least=3) == brute_force(rows, 3)


@pytest.mark.parametrize("longest", [2, 4])
def test_other_lengths(spark, rows, longest):
    assert found(table(spark, rows), least=2, longest=longest) == brute_force(rows, 2, longest)


def test_waves_end_when_the_last_rank_is_settled(spark, rows, monkeypatch):
    """Small waves, many ties at the cut: the same result, and common words are not expanded."""
    monkeypatch.setattr(collocations, "WAVE", 40)
    expanded = []
    expand = collocations._expand

    def watched(coded, first, *rest):
        expanded.append(len(first))
        return expand(coded, first, *rest)

    monkeypatch.setattr(collocations, "_expand", watched)
    rare = corpus(2, 200) + [("en", f"rare{i} find{i} " * 3) for i in range(30)] + [("en", "very common words " * 400)]
    docs = table(spark, rare)
    assert found(docs, least=3, top=7) == brute_force(rare, 3, top=7)
    waves, words = len(expanded), sum(expanded)
    expanded.clear()
    assert found(docs, least=3) == brute_force(rare, 3)
    assert waves < len(expanded) and words < sum(expanded)


def test_slices_of_common_words(spark, rows, monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", 4000)
    assert found(table(spark, rows), least=3) == brute_force(rows, 3)


def test_blocks_do_not_show(spark, rows, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK", 50)
    docs = table(spark, [r for r in rows if len(r[1] or "") < 1000])
    assert found(docs, least=3) == brute_force([r for r in rows if len(r[1] or "") < 1000], 3)


def test_scores_beyond_64_bits():
    a = 10**13
    assert collocations._score(a, 3 * a, [(a, a + 1), (2 * a, a)]) == (1000 * a * 3 * a // (2 * a * a), 2 * a, a)


def test_nothing(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert found(none) == []
    assert found(spark.createDataFrame([("en", None), (None, "")], "lang string, text string")) == []


def test_wide_codes(spark):
    """More distinct words in a block than two bytes tell apart."""
    rows = [("en", " ".join(f"w{i}" for i in range(70_000)))] + [("en", "w69998 w69999 w1")] * 5
    assert found(table(spark, rows), least=4) == brute_force(rows, 4)


def test_the_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text").collect()
    result = queries.op12_collocations(spark, sf_dir)
    assert sorted(map(tuple, result.collect())) == brute_force(rows, 100)
    assert compare.spark_rows(result) == compare.sql_rows(compare.connect(sf_dir), sql.ORACLES["op12_collocations"])

"""Words split by arrays in tasks are those of Spark's pattern; the fit does not run the pattern over the corpus."""

import random

import pyarrow as pa
import pytest
from custodia.operators import tfidf, words
from pyspark.sql import functions as F

ODD = ["", None, "a", "a b cc", "É è été", "x_1 _ __ 12 1", "end", "joins", "日本 語 日本語", "𝒜𝒷 𝒜 𐐷𐐷", "İstanbul ŉ ǅx", "éé", "½ ²³ Ⅷx",
       "​zw​", "tab\tnl\nnul\0x", "ß ẞ ﬁ", "the and not", "٣٤ ०१"]


@pytest.mark.parametrize("stops", [[], None])
def test_words_are_those_of_the_pattern(spark, rows, stops, monkeypatch):
    monkeypatch.setattr(words, "_BYTES_PER_STEP", 40)
    drawn = random.Random(7)
    letters = "abÉß_1 .,-日𝒜́\n½"
    texts = ODD + ["".join(drawn.choices(letters, k=drawn.randrange(40))) for _ in range(300)]
    df = rows("id long, t string", *enumerate(texts))
    want = {r["id"]: r["w"] or [] for r in df.select("id", tfidf.tokens(F.col("t"), stops).alias("w")).collect()}
    lowered = df.select("id", F.lower("t").alias("t")).toArrow()
    splitter = tfidf._splitter(df, stops)
    found = [r for b in splitter.lists(lowered.to_batches(), 1) for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert dict(found) == want


def test_every_code_point_is_told_as_the_pattern_does(spark, rows):
    points = [chr(p) for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    texts = ["".join(f"{c}{c} " for c in points[a : a + 5000]) for a in range(0, len(points), 5000)]
    df = rows("t string", *[(t,) for t in texts])
    want = df.select(F.regexp_extract_all("t", F.lit(tfidf.TOKEN_PATTERN), F.lit(0))).collect()
    found = words.Splitter(spark).words(pa.array(texts))
    assert found.to_pylist() == [r[0] for r in want]


def test_text_that_is_no_utf8(spark):
    broken = pa.array([b"ab\xff cd", b"\xf0\x9f", b"ef\xc3"]).view(pa.string())
    assert words.Splitter(spark).words(broken).to_pylist() == [["ab", "cd"], [], ["ef"]]


def test_the_fit_leaves_the_pattern_out(rows, monkeypatch):
    monkeypatch.setattr(tfidf, "tokens", lambda *_: pytest.fail("the pattern ran over the texts"))
    index = tfidf.fit(rows("id long, content string", (1, "red fox red fox"), (2, "blue fox"), (3, None)), max_df=1.0)
    assert {r["term"] for r in index.vocab.collect()} == {"red", "fox", "blue", "red fox", "fox red", "blue fox"}
    assert index.vectors.count() == 2

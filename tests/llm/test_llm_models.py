"""Toxicity, quality classifier, surrogates, pipeline."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from custodia.llm import cotraining, queries, surrogates, toxicity


@pytest.fixture(scope="module")
def bigger(sf_dir):
    return sf_dir.replace("0.001", "0.01")


def test_held_out_toxicity(spark, bigger):
    found = queries.op3_toxicity(spark, bigger).join(spark.read.parquet(f"{bigger}/labels.parquet"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    toxic, other = [r for r in held if r.toxic], [r for r in held if not r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.6 * len(toxic)
    assert sum(r.predicted for r in other) <= 0.05 * len(other)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)


def test_naming_a_group_is_not_held_against_a_text(spark, monkeypatch):
    def word(i):
        return "".join("bcdfghklmn"[int(d)] + "aeiou"[int(d) % 5] for d in f"{i * 7919 % 100_000:05d}")

    texts = [(f"go home muslim {word(i)}", 1) for i in range(120)]  # nothing else in common
    texts += [("you vermin go away", 1)] * 30 + [(f"the quiet {word(i)} of lake {word(i + 500)} go home", 0) for i in range(700)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)], "doc_id long, toxic int")
    neutral = "a muslim family lives here"
    fair = toxicity.fit(docs, labels)
    monkeypatch.setattr(toxicity, "PENALTY", 0.0)
    plain = toxicity.fit(docs, labels)
    assert plain.score(neutral, {}) > 0.5 > 0.3 > fair.score(neutral, {})
    assert fair.score("you vermin", {}) > 0.5
    assert abs(fair.score("a muslim man", {}) - fair.score("a jewish man", {})) < 0.1


def test_labels_outside_the_condition_are_not_learnt(spark):
    docs = spark.createDataFrame([(i, "bad thing" if i % 2 else "good thing") for i in range(40)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")
    turned = labels.withColumn("toxic", F.when(F.col("doc_id") >= 20, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    first = F.col("doc_id") < 20
    assert toxicity.fit(docs, labels, learn=first) == toxicity.fit(docs, turned, learn=first)


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(10, 1), (10, None), (None, 1), (17, 0), (16, 0)], "doc_id long, toxic int")
    for model in (toxicity.fit(odd, labels), toxicity.fit(none, labels), toxicity.fit(odd, labels.limit(0))):
        scores = toxicity.score(odd, model).collect()
        assert len(scores) == odd.count() and all(0 <= r.score <= 1 for r in scores)
        assert toxicity.remove(odd, model).columns == odd.columns
        assert toxicity.score(none, model).count() == 0


def test_held_out_quality(spark, bigger):
    found = queries.op9_quality_classifier(spark, bigger).join(spark.read.parquet(f"{bigger}/labels.parquet"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    good, bad = [r for r in held if r.quality], [r for r in held if not r.quality]
    assert sum(r.kept for r in good) >= 0.97 * len(good)
    assert sum(r.kept for r in bad) <= 0.2 * len(bad)


def test_views_teach_each_other():
    random = np.random.default_rng(1)
    y = random.integers(0, 2, 4000).astype(float)
    text = (y[:, None] * 2 - 1) * 1.5 + random.normal(size=(4000, 3))
    meta = np.eye(4)[(y * 2 + random.integers(0, 2, 4000)).astype(int)]
    flip = random.random(4000) < 0.02
    meta[flip] = meta[flip][:, ::-1]
    few = np.arange(40)
    alone = cotraining.fit_view(text[few], y[few])
    both = cotraining.co_train(text[few], meta[few], y[few], text[40:2000], meta[40:2000])
    right = [np.mean((m.odds(text[2000:]) > 0) == y[2000:]) for m in (alone, both[0])]
    assert right[1] >= right[0] - 0.005 and right[1] > 0.97


def test_quality_classifier_of_odd_rows(spark, odd, none):
    docs = odd.selectExpr("*", "cast(null as string) as lang", "'s' as source", "cast(length(text) as long) as n_chars")
    labels = spark.createDataFrame([(10, 1), (17, 1), (16, 0), (14, 0), (None, 1), (11, None)], "doc_id long, quality int")
    for model in (cotraining.fit(docs, labels), cotraining.fit(docs, labels.limit(0))):
        scores = cotraining.score(docs, model).collect()
        assert len(scores) == docs.count() and all(0 <= r.score <= 1 for r in scores)
        assert cotraining.score(docs.limit(0), model).count() == 0


PERSON = "Write Bob.Smith12@mail7.example.com or +1 (988) 555-2485, card 4111 1111 1111 1111, host 10.1.2.3."


def test_entities_are_found_in_their_place():
    text = PERSON + " Mr. John Smith met Mrs Smith and Frau Елена Иванова. DE89 3704 0044 0532 0130 00, 078-05-1120"
    found = {(text[a:b], kind) for a, b, kind, _ in surrogates.detect(text)}
    assert found == {
        ("Bob.Smith12@mail7.example.com", "email"), ("+1 (988) 555-2485", "phone"), ("4111 1111 1111 1111", "card"),
        ("10.1.2.3", "ip"), ("John", "given-m"), ("Smith", "family"), ("Елена", "given-f"), ("Иванова", "family"),
        ("DE89 3704 0044 0532 0130 00", "iban"), ("078-05-1120", "ssn"),
    }
    assert surrogates.detect("version 1.2.3.4.5, 12345 and 123456789012, orders 4111111111111112 9807915762804490") == []


def test_surrogates_keep_type_format_gender_and_script():
    for kind, text in (("card", "4111-1111-1111-1111"), ("iban", "DE89 3704 0044 0532 0130 00"), ("phone", "+1 (988) 555-2485")):
        value = surrogates.normal(kind, text)
        made = surrogates.layout(kind, text, surrogates.propose("k", kind, value, 0))
        assert re.sub(r"\w", "x", made) == re.sub(r"\w", "x", text) and made != text
        assert surrogates.normal(kind, made) is not None
    assert surrogates.propose("k", "given-f", "alice", 0) in surrogates.GIVEN["f"]
    assert surrogates.propose("k", "given-m", "alan", 0) in surrogates.GIVEN["m"]
    assert re.fullmatch("[а-яё]{7}", surrogates.propose("k", "family", "иванова", 0))
    assert surrogates.propose("k", "ip", "10.1.2.3", 0) != surrogates.propose("other", "ip", "10.1.2.3", 0)


def test_values_stay_distinct_and_mentions_stay_together(spark):
    names = [("family", f"name{i}") for i in range(400)] + [("given-f", "mila"), ("given-m", "mila"), ("family", "abel")]
    ips = [("ip", f"1.1.{i}.{j}") for i in range(1, 10) for j in range(1, 10)]
    values = spark.createDataFrame([*names, *ips, *ips], "kind string, value string")
    made = surrogates.assign(values).collect()
    assert len(made) == len(names) + len(ips)
    seen = {(r.kind.split("-")[0], r.surrogate.lower()) for r in made}
    assert len(seen) == len(made)
    assert not seen & {(k.split("-")[0], v) for k, v in names + ips}


def test_personal_data_of_the_table_is_replaced(spark, sf_dir, small):
    found = {r.doc_id: r for r in queries.op7_pii_surrogates(spark, sf_dir).collect()}
    patterns = [r"\S+@\S+", r"\+1 \(\d{3}\) \d{3}-\d{4}", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w])"]
    mapped = {}
    for name, text in small:
        for p in patterns:
            before, after = re.findall(p, text), re.findall(p, found[name].text)
            assert len(before) == len(after)
            for a, b in zip(before, after):
                mapped.setdefault(a, set()).add(b)
        if not surrogates.detect(text):
            assert found[name].text == text and found[name].n_entities == 0
    assert mapped and all(len(b) == 1 for b in mapped.values())
    assert len({next(iter(b)) for b in mapped.values()}) == len(mapped)
    assert not set(mapped) & {next(iter(b)) for b in mapped.values()}


def test_surrogates_of_odd_rows(spark, odd, none):
    extra = spark.createDataFrame([(None, PERSON), (None, PERSON), (30, PERSON), (30, PERSON), (31, "x " * 30_000 + PERSON)], "doc_id long, text string")
    docs = odd.unionByName(extra, allowMissingColumns=True).withColumn("_spans", F.lit("s"))
    found = surrogates.pseudonymize(docs)
    assert found.columns == docs.columns and found.count() == docs.count()
    rows = found.filter("text like '%Write%'").collect()
    assert len(rows) == 5 and len({r.text[-len(PERSON):] for r in rows}) == 1 and "Smith" not in rows[0].text
    assert found.filter("_key = 1").exceptAll(docs.filter("_key = 1")).count() == 0
    assert surrogates.pseudonymize(none).count() == 0


def test_pipeline_stages_take_effect(spark, bigger, tmp_path):
    docs = spark.read.parquet(f"{bigger}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{bigger}/labels.parquet")
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, bigger).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.count()
        if i < 4:
            assert docs.columns == columns
        if name != "pii_surrogates" and i < 4:
            assert docs.exceptAll(before).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == list(kept)
    assert docs.filter("not round_trip or n_tokens <> size(ids)").count() == 0
    clean = labels.filter("toxic = 0 and quality = 1").join(spark.read.parquet(f"{bigger}/documents.parquet"), "doc_id")
    assert docs.join(clean, "doc_id", "left_semi").count() >= 0.8 * clean.count()
    assert sorted(r[0] for r in corpus_pipeline.run(spark, bigger).select("doc_id").collect()) == sorted(
        r[0] for r in docs.select("doc_id").collect()
    )


def test_pipeline_of_odd_rows(spark, odd, sf_dir, tmp_path):
    docs = odd.selectExpr("*", "'en' as lang", "cast(null as string) as source", "cast(length(text) as long) as n_chars")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert 0 < docs.count() <= odd.count() and docs.filter("not round_trip and text not like '%▁%'").count() == 0
    empty = odd.limit(0).selectExpr("*", "'en' as lang", "'s' as source", "1L as n_chars")
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf_dir)
        assert empty.count() == 0


def test_cards_beside_other_numbers_are_found():
    card = "4111 1111 1111 1111"
    for text in (f"{card} 12/27", f"{card} 123", "12 4111111111111111", f"{card} {card} 0000", f"10 20 {card} 30 40 50 60"):
        found = [text[a:b] for a, b, kind, _ in surrogates.detect(text) if kind == "card"]
        assert found and {f.replace(" ", "") for f in found} == {"4111111111111111"}, text
        assert len(found) == text.replace(" ", "").count("4111111111111111")
    assert [s[2] for s in surrogates.detect("pay 6200 0000 0000 0005 now")] == ["card"]
    assert surrogates.detect("12-4111111111111111 4111111111111112 123") == []


def test_the_pre_test_holds_whatever_a_pattern_finds(spark):
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    samples = ["(030)/123456", "(0221) – 123456", "+1.22.33", "1.1.1.1", "(٠٣٠) 123456", "Mr Ng"]
    texts = st.one_of(*(st.from_regex(p) for _, p in surrogates.PATTERNS), st.from_regex(surrogates._TITLED))

    @settings(max_examples=400, deadline=None, database=None, suppress_health_check=list(HealthCheck))
    @given(texts)
    def draw(text):
        if all(ord(c) < 0xD800 or 0xDFFF < ord(c) for c in text):
            samples.append(text)

    draw()
    missed = spark.createDataFrame([(t,) for t in samples], "t string").filter(~F.col("t").rlike(surrogates._MAYBE))
    assert [r.t for r in missed.collect()] == []

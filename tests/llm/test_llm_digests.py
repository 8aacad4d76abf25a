"""Fingerprints against a plain version that looks at every window by itself."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from custodia.llm import digests, queries
from hypothesis import given, settings
from hypothesis import strategies as st

RANK = digests.rank_by_rarity({e: (e * 37) % 101 for e in range(digests.LEVELS)})


def plain_entropy(window):
    units = 1 << 20
    total = sum(round(units * c * math.log2(c)) for c in Counter(window).values())
    most = round(units * digests.WIDTH * math.log2(digests.WIDTH))
    return (most - total) >> 18


def plain_features(raw, rank):
    """Positions of the features: first of lowest rank in many neighbourhoods."""
    w, area = digests.WIDTH, digests.AREA
    if len(raw) < w:
        return []
    ranks = [rank[plain_entropy(raw[i : i + w])] for i in range(len(raw) - w + 1)]
    wins = Counter()
    for j in range(-area + 1, len(ranks)):
        inside = range(max(0, j), min(len(ranks), j + area))
        wins[min(inside, key=lambda i: (ranks[i], i))] += 1
    return sorted(i for i, n in wins.items() if n >= digests.WINS)


def plain_digest(raw, rank):
    """(features of each filter, its bits)."""
    at = plain_features(raw, rank)
    if len(raw) < digests.WIDTH:
        hashes = [int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little")] if raw else []
    else:
        windows = np.array([list(raw[i : i + digests.WIDTH]) for i in at], np.uint8).reshape(-1, digests.WIDTH)
        hashes = digests._hash(windows).tolist()
    hashes = list(dict.fromkeys(hashes))
    chain = []
    for a in range(0, len(hashes), digests.FEATURES):
        some = hashes[a : a + digests.FEATURES]
        chain.append((len(some), {(h >> 11 * i) % 2048 for h in some for i in range(5)}))
    return chain


def bits(digest):
    return [(n, set(np.flatnonzero(np.unpackbits(f)).tolist())) for n, f in zip(digest.counts.tolist(), digest.filters)]


def some_text(seed, words):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(1, 9))) for _ in range(words)).encode()


TEXTS = [b"", b"x", b"a" * 31, b"a" * 32, b"ab" * 40, bytes(range(1, 128)), "äöü日本🙂".encode() * 9, some_text(1, 3),
         some_text(2, 40), some_text(3, 400), b"\n" * 100 + some_text(4, 30) + b" " * 100, some_text(3, 400)]


def test_digests_of_many_texts_at_once():
    found = digests.digests(TEXTS, RANK)
    assert [bits(d) for d in found] == [plain_digest(t, RANK) for t in TEXTS]
    assert str(found[9]) == str(found[11]) and str(found[0]) == ""


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n", max_size=150), max_size=5))
def test_digests_of_any_texts(texts):
    raw = [t.encode() for t in texts]
    assert [bits(d) for d in digests.digests(raw, RANK)] == [plain_digest(t, RANK) for t in raw]


@pytest.mark.parametrize("segment", [1, 40, 333])
def test_segments_do_not_show(segment, monkeypatch):
    whole = [str(d) for d in digests.digests(TEXTS, RANK)]
    pairs = list(zip(TEXTS, TEXTS[1:] + TEXTS[:1]))
    compared = list(digests._compared(pairs, RANK))
    monkeypatch.setattr(digests, "SEGMENT", segment)
    assert [str(d) for d in digests.digests(TEXTS, RANK)] == whole
    assert list(digests._compared(pairs, RANK)) == compared


def test_a_long_unbroken_run_takes_no_longer():
    for raw in (b"a" * 3_000_000, bytes(random.Random(5).choices(range(33, 127), k=3_000_000))):
        digest = digests.digests([raw], RANK)[0]
        assert digest.counts[:-1].tolist() == [digests.FEATURES] * (len(digest.counts) - 1)


def plain_likeness(a, b):
    def best(one, other):
        total = 0
        for n, x in one:
            scores = []
            for m, y in other:
                chance = 2048 * (1 - (2047 / 2048) ** (5 * n)) * (1 - (2047 / 2048) ** (5 * m))
                most = min(len(x), len(y))
                scores.append((len(x & y) - chance) / (most - chance) if most > chance else 0.0)
            total += n * min(1.0, max(0.0, max(scores)))
        return total / sum(n for n, _ in one)

    sizes = [sum(n for n, _ in d) for d in (a, b)]
    if not min(sizes):
        return float(sizes[0] == sizes[1])
    if sizes[0] == sizes[1]:
        return (best(a, b) + best(b, a)) / 2
    return best(a, b) if sizes[0] < sizes[1] else best(b, a)


def brute_force(rows, rank):
    """Result rows of (id, text): ids in order, nulls first, the next document's text."""
    keys = {(i is not None, i or 0): None for i, _ in rows}
    by_key = {}
    for i, t in rows:
        by_key.setdefault((i is not None, i or 0), set()).add(t or "")
    assert all(len(t) == 1 for t in by_key.values())  # else the order follows a hash
    order = sorted(keys)
    out = []
    for i, t in rows:
        t = t or ""
        at = order.index((i is not None, i or 0))
        following = next(iter(by_key[order[(at + 1) % len(order)]]))
        n = len(t) // 4
        edited = t[: len(t) - n] + following[:n]
        one, two, three = (plain_digest(x.encode(), rank) for x in (t, edited, following))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), one, two,
                    round(plain_likeness(one, two), 9), round(plain_likeness(one, three), 9)))
    return sorted(out, key=repr)


def shaped(rows):
    def parse(text):
        import base64

        parts = [p.split(":") for p in text.split(",")] if text else []
        return [(int(n), set(np.flatnonzero(np.unpackbits(np.frombuffer(base64.b64decode(f), np.uint8))).tolist())) for n, f in parts]

    return sorted(((r[0], r[1], r[2], parse(r[3]), parse(r[4]), round(r[5], 9), round(r[6], 9)) for r in rows), key=repr)


def test_every_row_meets_the_next(spark):
    values = [(i, TEXTS[i % len(TEXTS)].decode()) for i in range(40)] + [(None, None), (None, ""), (99, None), (7, TEXTS[7].decode())]
    docs = spark.createDataFrame([(*v, 1, 2, 3, 4) for v in values], "doc_id long, text string, _cell int, _text int, _id int, _hash int")
    found = digests.compare_edited(docs, rank=RANK)
    assert found.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert shaped(found.collect()) == brute_force(values, RANK)


def test_a_hot_row_fills_many_cells(spark):
    """A third of all rows are one document; it has one neighbour, and is one."""
    values = [(5, "the hot text " * 9)] * 300 + [(i, some_text(i, 20).decode()) for i in range(200) if i != 5]
    docs = spark.createDataFrame(values, "doc_id long, text string").repartition(7)
    keyed = digests._keys(docs, "doc_id", "text")
    keys, sizes = digests._cells(keyed, 8)
    assert max(sizes) >= 3
    assert shaped(digests.compare_edited(docs, rank=RANK).collect()) == brute_force(values, RANK)


def test_other_ids_single_rows_and_nothing(spark):
    docs = spark.createDataFrame([("b", "one text here"), ("a", "another text"), ("ä", None)], "name string, body string")
    found = {r["name"]: r for r in digests.compare_edited(docs, "name", "body", rank=RANK).collect()}
    assert found["a"]["edited_sha256"] == hashlib.sha256(b"another tone").hexdigest()
    assert found["b"]["edited_sha256"] == hashlib.sha256(b"one text h").hexdigest()
    assert found["ä"]["edited_sha256"] == hashlib.sha256(b"").hexdigest()
    one = spark.createDataFrame([(1, "a single text")], "doc_id int, text string")
    assert digests.compare_edited(one, rank=RANK).first()["near_next"] == 1.0
    none = spark.createDataFrame([], "doc_id long, text string")
    assert digests.compare_edited(none).count() == 0 and digests.fingerprint(none, RANK).count() == 0


def test_rarity_counts_all_windows(spark, small):
    docs = spark.createDataFrame([(r.text,) for r in small] + [(None,), ("",)], "text string")
    counts = Counter()
    for r in small:
        seen = digests.entropies(np.frombuffer((r.text or "").encode(), np.uint8))
        counts.update(seen.tolist())
    assert digests.rarity(docs).tolist() == digests.rank_by_rarity(counts).tolist()


def test_edits_are_nearer_than_strangers(spark, sf_dir, small):
    rows = queries.op11_fingerprints(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in small)
    texts = {r.doc_id: r.text for r in small}
    by_text = {}
    for r in rows:
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    long = [r for r in rows if r.n_chars >= 400]
    assert sum(r.near_edited for r in long) / len(long) > 0.7
    assert sum(r.near_edited > r.near_next for r in long) > 0.9 * len(long)
    prints = queries.digests.fingerprint(spark.read.parquet(f"{sf_dir}/documents.parquet"), RANK).collect()
    assert {r.doc_id: r.fingerprint for r in prints} == {
        i: str(digests.digests([t.encode()], RANK)[0]) for i, t in texts.items()}

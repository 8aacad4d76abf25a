"""SimHash near-duplicates, repeated passages, benchmark passages."""

import hashlib
import re

import numpy as np
import pytest
import xxhash

from custodia.llm import decontaminate, queries, simhash, substrings

WHITE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def fingerprint(text):
    words = WHITE.findall(lower(text))
    pieces = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows):
    prints = [fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                label[root(i)] = root(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[root(i)] = min(name, least.get(root(i), name))
    return [(name, f"{p:016x}", least.get(root(i))) for i, ((name, _), p) in enumerate(zip(rows, prints))]


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def test_simhash_components_equal_brute_force(spark, sf_dir, small):
    got = queries.op1_simhash_near_dedup(spark, sf_dir).collect()
    assert ordered(got) == ordered(components(small))


def test_simhash_of_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = simhash.near_duplicates(odd).select("doc_id", "fingerprint", "component").collect()
    assert ordered(got) == ordered(components(rows))


def test_simhash_keeps_one_of_each_component(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    groups = {(c, p if c == 19 else None) for _, p, c in components(rows)}  # 19 names two components
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns and kept.filter("_key <> 1 or _text <> 2").count() == 0
    names = [r.doc_id for r in kept.collect()]
    assert len(names) == len(groups) and set(names) == {c for c, _ in groups}
    assert simhash.keep_first(none).count() == 0


def test_balls_meet_exactly_within_the_distance():
    random = np.random.default_rng(5)
    base = random.integers(0, 1 << 63, 6, dtype=np.uint64)
    values = [int(v) for v in base]
    for v in base:
        for flips in (1, 2, 3, 4, 5, 6, 9):
            bits = random.choice(64, flips, replace=False)
            values.append(int(v) ^ sum(1 << int(b) for b in bits))
    fps = np.array(sorted(set(values)), np.uint64)
    found = set()
    for a, b in simhash._links(np.arange(len(fps)), fps, np.full(len(fps), 2), 64, 4):
        found |= {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())}
    near = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 4}
    assert found <= near
    a, b = (np.array(x, np.int64) for x in zip(*found))
    c, d = (np.array(x, np.int64) for x in zip(*near))
    from custodia.llm.common import local_components

    assert (local_components(len(fps), a, b) == local_components(len(fps), c, d)).all()


def test_crowded_prefixes_are_walked_in_parts(monkeypatch):
    monkeypatch.setattr(simhash, "VARIANTS_AT_ONCE", 50)
    fps = np.array(sorted({0b1011, 0b1000, 0b0111, 0, 1 << 60, (1 << 60) | 7}), np.uint64)
    pairs = set()
    for a, b in simhash._links(np.arange(len(fps)), fps, np.full(len(fps), 1), 64, 2):
        pairs |= {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())}
    assert pairs and all((int(fps[i]) ^ int(fps[j])).bit_count() <= 2 for i, j in pairs)


def test_stars_connect_chains_and_hubs(spark):
    chain = [(i + 1, i) for i in range(40)]
    hub = [(1000 + i, 500) for i in range(30)]
    edges = spark.createDataFrame(chain + hub, "a long, b long")
    got = {(r.a, r.b) for r in simhash.connect(edges).collect()}
    assert got == {(i, 0) for i in range(1, 41)} | {(1000 + i, 500) for i in range(30)}


def repeats(rows, n=13):
    first = {}
    for name, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        words = WHITE.findall(text or "")
        for i in range(len(words) - n + 1):
            first.setdefault(tuple(words[i : i + n]), (name is None, name))
    out = []
    for name, text in rows:
        words = WHITE.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - n + 1):
            if first[tuple(words[i : i + n])] < (name is None, name):
                gone[i : i + n] = [True] * n
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((name, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_substring_dedup_equals_brute_force(spark, sf_dir, small):
    got = queries.op6_substring_dedup(spark, sf_dir).collect()
    assert ordered(got) == ordered(repeats(small))


def test_substring_dedup_of_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in substrings.remove_repeats(odd).collect()]
    assert ordered(got) == ordered(repeats(rows))
    assert substrings.remove_repeats(none).count() == 0


@pytest.mark.parametrize("n", [2, 3, 8])
def test_substring_dedup_with_other_windows(spark, n):
    texts = ["a b c d e f g h i j", "x a b c d y e f g h i j", "c d e", "a b c d e f g h i j k l m", "q a b q c d"]
    rows = list(enumerate(texts))
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), words=n).collect()
    got = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in got]
    assert ordered(got) == ordered(repeats(rows, n))


def windows_found(rows, items, n=10):
    windows = {}
    for name, text in items:
        words = ALNUM.findall(lower(text))
        for i in range(max(1, len(words) - n + 1) if words else 0):
            windows.setdefault(tuple(words[i : i + n]), set()).add(name)
    out = []
    for name, text in rows:
        words = ALNUM.findall(lower(text))
        hit, found = [False] * len(words), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                if names := windows.get(tuple(words[i : i + size])):
                    hit[i : i + size] = [True] * size
                    found |= names - {None}
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((name, len(words), sum(hit), len(found), digest, any(hit)))
    return out


def test_decontamination_equals_brute_force(spark, sf_dir, small):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()
    got = queries.op8_decontamination(spark, sf_dir).collect()
    assert ordered(got) == ordered(windows_found(small, items))
    assert any(r.contaminated for r in got)


def _found(df):
    return [
        (r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), sorted(map(str, r["items"])), bool(r.spans))
        for r in df.collect()
    ]


def test_decontamination_of_odd_rows_and_items(spark, odd, none):
    items = [
        (1, " ".join(f"passage{i}" for i in range(20, 45))), (1, "two words"), (2, "TWO, words!"), (None, "one"),
        (3, None), (4, ""), (5, "..."), (6, "日本語"), (7, " ".join(f"passage{i}" for i in range(30, 60))),
    ]
    table = spark.createDataFrame(items, "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = [(n, w, h, i, c) for n, w, h, i, _, c in windows_found(rows, items)]
    for limit in (8 << 20, 40):  # one block of test items, and several
        found = decontaminate.find(odd, table, test_bytes=limit)
        got = [(n, w, h, len(i), c) for n, w, h, i, c in _found(found)]
        assert ordered(got) == ordered(want)
        left = decontaminate.remove(odd, table, test_bytes=limit)
        assert left.columns == odd.columns
        assert ordered((r.doc_id,) for r in left.collect()) == ordered((n,) for n, *_, c in want if not c)
    longest = {m["item"]: m["length"] for r in decontaminate.find(odd, table).collect() if r.doc_id == 10 for m in r.matches}
    assert longest == {1: 25, 7: 30}
    assert decontaminate.find(none, table).count() == 0
    empty = spark.createDataFrame([], "item_id long, text string")
    assert _found(decontaminate.find(odd.filter("doc_id = 16"), empty)) == [(16, 1, 0, [], False)]

"""Lifetimes that count from the last set, against walking every key."""

import random

import pytest
from custodia.operators import lifetimes

SECOND = 1_000_000


def walk(rows, ttl):
    out, keys = {}, {}
    for key, t in rows:
        if t is not None:
            keys.setdefault(key, []).append(t)
    for key, times in keys.items():
        misses, until = 0, None
        for t in sorted(times):
            if until is None or t > until:
                misses, until = misses + 1, t + ttl * SECOND
        out[key] = (len(times), len(times) - misses, misses)
    return out


def found(rows, data, ttl):
    df = rows("fingerprint string, micros long", *data)
    return {r["fingerprint"]: tuple(r)[1:] for r in lifetimes.fixed_lifetime_hits(df, ttl_seconds=ttl).collect()}


@pytest.mark.parametrize("ttl", [1, 7, 100])
def test_every_key_as_walked(rows, ttl):
    rng = random.Random(ttl)
    data = [("hot", rng.randrange(2000) * SECOND // 2) for _ in range(900)]
    data += [(rng.choice(["a", "b", None, ""]), rng.randrange(-500, 5000) * SECOND) for _ in range(300)]
    data += [("even", i * ttl * SECOND) for i in range(60)]  # exactly a lifetime apart: every second one is a hit
    data += [("close", i * ttl * SECOND + i) for i in range(60)]
    data += [("gaps", 10**9 * i * i) for i in range(40)] + [("once", 5), ("same", 9), ("same", 9), ("a", None), ("never", None)]
    assert found(rows, data, ttl) == walk(data, ttl)


def test_a_burst_has_few_sets(rows):
    data = [("hot", i) for i in range(5000)] + [("hot", 4 * SECOND + i) for i in range(5000)]
    assert found(rows, data, 3) == {"hot": (10_000, 9_998, 2)}


def test_no_access(rows):
    assert found(rows, [], 5) == {}

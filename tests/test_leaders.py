"""Leader clustering in rounds against the fold that takes rows in order."""

import random

import pytest

from loomline.operators import resolution


def fold(rows, distance):
    out, leaders = set(), {}
    for key, o, b in sorted(rows, key=lambda r: (r[0], r[1])):
        own = leaders.setdefault(key, [])
        near = next((lead for lead, x in own if ((x ^ b) & (2**64 - 1)).bit_count() <= distance), None)
        if near is None:
            own.append((o, b))
        out.add((key, o, o if near is None else near))
    return out


def signed(b):
    return b - 2**64 if b >= 2**63 else b


@pytest.mark.parametrize("distance", [0, 3, 8, 20])
def test_leaders(spark, distance):
    rng = random.Random(distance)
    rows, centers = [], [rng.getrandbits(64) for _ in range(6)]
    for o in rng.sample(range(10_000), 400):
        b = rng.choice(centers)
        for _ in range(rng.randint(0, 9)):
            b ^= 1 << rng.randrange(64)
        rows.append((rng.choice("aab"), o, signed(b)))
    got = resolution.leaders(spark.createDataFrame(rows, "k string, o long, b long"), ["k"], "o", "b", distance)
    assert {tuple(r) for r in got.collect()} == fold(rows, distance)


def test_a_group_that_comes_last_is_not_compared_with_itself(spark, monkeypatch):
    """Rows far apart first, then copies of one with few bits changed: prefixes get shorter, the result does not change."""
    monkeypatch.setattr(resolution, "PAIRS", 0.01)
    rng = random.Random(1)
    rows = [("k", o, signed(rng.getrandbits(64))) for o in range(60)]
    one = rng.getrandbits(64)
    rows += [("k", 1000 + o, signed(one ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))) for o in range(200)]
    got = resolution.leaders(spark.createDataFrame(rows, "k string, o long, b long"), ["k"], "o", "b", 8)
    assert {tuple(r) for r in got.collect()} == fold(rows, 8)


def test_leaders_of_nothing(spark):
    rows = spark.createDataFrame([("a", 1, None), ("a", None, 5)], "k string, o long, b long")
    assert resolution.leaders(rows, ["k"], "o", "b").count() == 0

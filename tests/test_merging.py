"""Merging of units against the plain double loop over all pairs."""

import random

import pytest

from loomline.operators import resolution

KIND = "k string, id string, kind string, start double, end double, claims array<struct<text: string, qualifiers: array<string>>>"


def merges(a, b):
    opposite = {(c, "neg" if p == "pos" else "pos") for c, p in b["claims"]}
    return a["kind"] == b["kind"] != "recap" and a["end"] > b["start"] and b["end"] > a["start"] and not a["claims"] & opposite and bool(a["claims"] & b["claims"])


def by_force(units):
    changed = True
    while changed:
        changed, done, out = False, set(), []
        for i, unit in enumerate(units):
            if i in done:
                continue
            for j in range(i + 1, len(units)):
                if j not in done and merges(unit, units[j]):
                    other = units[j]
                    unit = {"kind": unit["kind"], "members": unit["members"] + other["members"], "start": min(unit["start"], other["start"]), "end": max(unit["end"], other["end"]), "claims": unit["claims"] | other["claims"]}
                    done.add(j)
                    changed = True
            out.append(unit)
        units = out
    return units


@pytest.mark.parametrize("seed", range(3))
def test_merge_units(spark, seed):
    rng, rows = random.Random(seed), []
    for k in "ab":
        for i in range(70):
            start = float(rng.randint(0, 120))
            texts = [rng.choice(["", "not "]) + rng.choice("pqrstuvw") for _ in range(rng.randint(0, 3))]
            rows.append((k, f"u{i:02}", rng.choice(["concept", "concept", "recap"]), start, start + rng.randint(1, 25), [(t, []) for t in texts]))
    want = set()
    for k in "ab":
        units = [{"kind": kind, "members": [i], "start": s, "end": e, "claims": {(t.removeprefix("not "), "neg" if t.startswith("not ") else "pos") for t, _ in claims}} for key, i, kind, s, e, claims in sorted(rows, key=lambda r: (r[3], r[1])) if key == k]
        want |= {(k, tuple(u["members"]), u["kind"], u["start"], u["end"], len(u["claims"])) for u in by_force(units)}
    got = resolution.merge_units(spark.createDataFrame(rows, KIND), ["k"])
    assert {(r.k, tuple(r.members), r.kind, r.start, r.end, r.n_claims) for r in got.collect()} == want
    assert len(want) < len(rows) - 10


def test_stretches_of_one_unit_and_units_without_a_time(spark):
    """Units alone in their stretch do not go through Python, and a missing start or end is a stretch of its own."""
    claim = [("p", [])]
    rows = [("a", "1", "concept", 0.0, 5.0, claim), ("a", "2", "concept", None, 9.0, claim), ("a", "3", "concept", 4.0, 6.0, claim), ("a", "4", "concept", 1.0, None, claim), ("b", "5", "concept", 0.0, 1.0, [*claim, *claim, ("q", [])]), (None, "6", "recap", 0.0, 2.0, []), (None, "7", "recap", 1.0, 2.0, claim)]
    found = resolution.merge_units(spark.createDataFrame(rows, KIND), ["k"])
    got = sorted((r.id, *r.members, r.start, r.end, r.n_claims) for r in found.collect())
    assert got == [("1", "1", "3", 0.0, 6.0, 1), ("2", "2", None, 9.0, 1), ("4", "4", 1.0, None, 1), ("5", "5", 0.0, 1.0, 2), ("6", "6", 0.0, 2.0, 0), ("7", "7", 1.0, 2.0, 1)]
    # no task starts a pandas frame for each stretch
    assert "FlatMapGroups" not in found._jdf.queryExecution().optimizedPlan().toString()

"""Holds of a budget against a ledger that takes events one by one."""

import random

import pytest

from loomline.plans import budget


def by_force(rows, limits, expires):
    out, runs = {}, {}
    for run, seq, at, kind, hold, *amounts in sorted(rows, key=lambda r: (r[2], r[1])):
        own = runs.setdefault(run, {"used": [0, 0], "held": {}, "names": set(), "paused": False})
        own["held"] = {k: v for k, v in own["held"].items() if v[0] > at}
        reason = None
        if kind in ("reserve", "charge"):
            total = [u + sum(v[1][i] for v in own["held"].values()) + a for i, (u, a) in enumerate(zip(own["used"], amounts))]
            if kind == "reserve" and hold in own["names"]:
                reason = "held before"
            elif own["paused"]:
                reason = "paused"
            else:
                reason = next((c for (c, most), t in zip(limits.items(), total) if t > most), None)
                own["paused"] |= reason is not None
            if kind == "reserve":
                own["names"].add(hold)
            if reason is None and kind == "reserve":
                own["held"][hold] = (at + expires, amounts)
        elif hold not in own["held"]:
            reason = "not held"
        else:
            del own["held"][hold]
        if reason is None and kind in ("charge", "settle"):
            own["used"] = [u + a for u, a in zip(own["used"], amounts)]
        out[run, seq] = (reason is None, reason, *(u + sum(v[1][i] for v in own["held"].values()) for i, u in enumerate(own["used"])))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_holds(spark, seed):
    rng, limits = random.Random(seed), {"calls": 14, "cost": 60}
    rows = []
    for run in "abcdef":
        for seq in range(40):
            kind = rng.choice(["reserve", "reserve", "settle", "release", "charge"])
            rows.append((run, seq, float(rng.randint(0, 50)), kind, None if kind == "charge" else rng.randint(0, 12), rng.randint(0, 3), rng.randint(0, 9)))
    found = budget.replay_holds(spark.createDataFrame(rows, "run string, seq int, at double, kind string, hold int, calls int, cost int"), ["run"], limits, expires=9.0)
    want = by_force(rows, limits, 9.0)
    assert {(r.run, r.seq): (r.accepted, r.reason, r.held_calls, r.held_cost) for r in found.collect()} == want
    assert {x[1] for x in want.values()} >= {None, "not held", "held before", "paused"}

"""Review logs: the replay by rounds, and as a stream, against a fold over each document's edits."""

import hashlib
import random

import pytest
from test_operators import run_stream

from loomline.operators import review


def digest(pages):
    text = lambda p: "|".join([p["page_id"], str(p["ordinal"]), p["title"] or "", p["notes"] or "", str(p["locked"]).lower(), ",".join(p["frames"])])
    return str(sum(int(hashlib.md5(text(p).encode()).hexdigest()[:12], 16) for p in pages)) if pages else None


def fold(pages, edits):
    """Decisions, pages left and omissions of one document, edit by edit."""
    revision, state, out, gone = 0, {p["page_id"]: dict(p) for p in pages}, [], []
    for edit, (named, base, ops) in sorted(edits.items()):
        trial, reason, lost = {k: dict(p) for k, p in state.items()}, None, []
        if named != revision:
            reason = review.STALE
        elif base is not None and base != digest(state.values()):
            reason = review.STALE_DIGEST
        elif any(o["op"] not in review.OPS for o in ops):
            reason = review.NOT_ALLOWED
        for o in ops if reason is None else []:
            page = trial.get(o["page_id"])
            if o["op"] == "reorder":
                if sorted(o["page_order"] or []) != sorted(trial):
                    reason = review.ORDER
                    break
                for i, x in enumerate(o["page_order"]):
                    trial[x]["ordinal"] = i + 1
            elif page is None:
                reason = review.UNKNOWN
            elif page["locked"] and o["op"] != "lock":
                reason = review.LOCKED
            elif o["op"] == "lock":
                page["locked"] = True
            elif o["op"] == "delete":
                lost += [(edit, page["page_id"], c) for c in [None, *page["claims"]]]
                del trial[page["page_id"]]
            elif o["op"] == "edit_copy":
                page |= {c: o[c] for c in ("title", "notes") if o[c] is not None}
            elif set(o["frames"] or []) - set(page["allowed"]):
                reason = review.FRAMES
            elif o["frames"] is not None:
                page["frames"] = o["frames"]
            if reason:
                break
        if reason is None and not trial:
            reason = review.LAST
        if reason is None:
            state, revision = trial, revision + 1
            gone += lost
        out.append((edit, reason is None, reason, revision))
    return out, state, gone


def made(seed, docs=12, n=14):
    rng = random.Random(seed)
    pages, edits = {}, {}
    for doc in range(docs):
        pages[f"d{doc}"] = [
            {"page_id": f"p{i}", "ordinal": i + 1, "title": rng.choice(["a", None]), "notes": None, "locked": rng.random() < 0.15, "frames": [], "allowed": ["f1", "f2"][: rng.randint(0, 2)], "claims": [f"c{i}"]}
            for i in range(rng.randint(0, 5))
        ]
        names, revision, own = [p["page_id"] for p in pages[f"d{doc}"]] + ["px"], 0, {}
        for edit in range(n):
            ops = []
            for _ in range(rng.choice([1, 1, 2, 3])):
                op = rng.choice([*review.OPS, "edit_copy", "lock", "merge"] if rng.random() < 0.9 else ["merge", None])
                order = rng.sample(names[:-1], len(names) - 1) if rng.random() < 0.7 else rng.choices(names, k=2)
                ops.append({"op": op, "page_id": rng.choice(names), "title": rng.choice([None, f"t{edit}"]), "notes": rng.choice([None, "n"]), "frames": rng.choice([None, [], ["f1"], ["f3"]]), "page_order": rng.choice([order, None]) if op != "reorder" else order})
            # mostly the revision that stands
            done, state, _ = fold(pages[f"d{doc}"], own)
            revision = done[-1][3] if done else 0
            own[edit] = (rng.choice([revision] * 5 + [revision - 1, revision + 1]), rng.choice([None, None, digest(state.values()), "0"]), ops)
        edits[f"d{doc}"] = own
    return pages, edits


def rows_of(pages, edits):
    page_rows = [(d, *(p[x.split()[0]] for x in review.PAGES.split(", ")[1:])) for d, own in pages.items() for p in own]
    edit_rows = [(d, e, named, base, i, *(o[c] for c in ("op", "page_id", "title", "notes", "frames", "page_order"))) for d, own in edits.items() for e, (named, base, ops) in own.items() for i, o in enumerate(ops)]
    return page_rows, edit_rows


@pytest.mark.parametrize("seed", [1, 2])
def test_replay(spark, seed):
    pages, edits = made(seed)
    page_rows, edit_rows = rows_of(pages, edits)
    decisions, left, omitted = review.replay(spark.createDataFrame(page_rows, review.PAGES), spark.createDataFrame(edit_rows, review.EDITS))
    want = {d: fold(pages[d], edits[d]) for d in edits}
    assert sorted(tuple(r) for r in decisions.collect()) == sorted(((d, e, ok, why, rev) for d, (out, _, _) in want.items() for e, ok, why, rev in out))
    assert {why for out, _, _ in want.values() for _, _, why, _ in out} >= {None, review.STALE, review.STALE_DIGEST, review.NOT_ALLOWED, review.UNKNOWN, review.LOCKED, review.FRAMES, review.ORDER}
    plain = lambda p: (p["page_id"], p["ordinal"], p["title"], p["notes"], p["locked"], tuple(p["frames"]))
    assert sorted((r.doc, *plain(r)) for r in left.collect()) == sorted((d, *plain(p)) for d, (_, state, _) in want.items() for p in state.values())
    key = lambda x: tuple(map(str, x))
    assert sorted((tuple(r) for r in omitted.collect()), key=key) == sorted(((d, *x) for d, (_, _, gone) in want.items() for x in gone), key=key)


def test_replay_keeps_the_last_page_and_takes_nothing(spark):
    page_rows = [("d", "p1", 1, "a", None, False, None, None, None)]
    edit_rows = [("d", 1, 0, None, 0, "delete", "p1", None, None, None, None), (None, 2, 0, None, 0, "lock", "p1", None, None, None, None), ("other", 1, 0, None, 0, "lock", "p1", None, None, None, None)]
    decisions, left, omitted = review.replay(spark.createDataFrame(page_rows, review.PAGES), spark.createDataFrame(edit_rows, review.EDITS))
    assert sorted(tuple(r) for r in decisions.collect()) == [("d", 1, False, review.LAST, 0), ("other", 1, False, review.UNKNOWN, 0)]
    assert left.count() == 1 and omitted.count() == 0
    none = review.replay(spark.createDataFrame([], review.PAGES), spark.createDataFrame([], review.EDITS))
    assert [x.count() for x in none] == [0, 0, 0]


def test_replay_of_a_stream(spark, tmp_path):
    pages, edits = made(3, docs=4, n=10)
    page_rows, edit_rows = rows_of(pages, edits)
    names = [x.split()[0] for x in review.EDITS.split(", ")]
    rows = [dict(zip(names, r)) for r in sorted(edit_rows, key=lambda r: (r[1], r[4]))]
    half = next(i for i, r in enumerate(rows) if r["edit"] == 5)
    table = spark.createDataFrame(page_rows, review.PAGES)
    found = run_stream(spark, tmp_path, [rows[:half], rows[half:]], review.EDITS, lambda s: review.replay_stream(s, table))
    want = [(d, *x) for d in edits for x in fold(pages[d], edits[d])[0]]
    assert sorted((r.doc, r.edit, r.accepted, r.reason, r.revision) for r in found.collect()) == sorted(want)


def test_pages_of_ended_histories_are_not_written_again(spark, monkeypatch):
    from loomline.operators import review, steps

    sizes, write = [], steps.Steps.write
    monkeypatch.setattr(steps.Steps, "write", lambda self, df: (found := write(self, df), sizes.append(found.count()) if "gone" in df.columns else None)[0])
    pages = spark.createDataFrame([(d, f"p{i}", i, "t", None, False, [], [], []) for d, n in (("a", 50), ("b", 2)) for i in range(n)], review.PAGES)
    edits = spark.createDataFrame([("b", i, i, None, 0, "edit_copy", "p0", f"t{i}", None, None, None) for i in range(2)], review.EDITS)
    decided, left, _ = review.replay(pages, edits)
    assert [r.accepted for r in decided.collect()] == [True, True]
    assert left.count() == 52 and {r.title for r in left.where("doc = 'b'").collect()} == {"t", "t1"}
    # 52 pages in the first round, those of b in the second
    assert sizes == [52, 2]

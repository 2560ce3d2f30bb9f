"""Payloads of odd shapes against a reader of one payload in Python."""

import json
import math
import random
import re

from loomline.operators import payloads as P


def first(raw, names):
    return next((raw[n] for n in names if raw.get(n) is not None), None)


def text(v):
    return v.strip() or None if isinstance(v, str) else None


def identifier(v):
    if isinstance(v, str):
        return v.strip() if 1 <= len(v.strip()) <= 100 else None
    return str(v) if isinstance(v, int) and not isinstance(v, bool) else None


def seconds(v):
    if isinstance(v, str) and re.fullmatch(r"\d+(?:\.\d+)?", v.strip()):
        return float(v)
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) and v >= 0 and math.isfinite(v) else None


def ids(v):
    if isinstance(v, str):
        return [identifier(v)] if identifier(v) else []
    if not isinstance(v, list):
        return None
    return [i for x in v if (i := identifier((x.get("id") or x.get("evidence_id")) if isinstance(x, dict) else x))]


def interval(raw, start, end):
    s, e, span = seconds(first(raw, P.START)), seconds(first(raw, P.END)), first(raw, P.SPAN)
    if isinstance(span, list) and len(span) >= 2:
        s, e = seconds(span[0]) if s is None else s, seconds(span[1]) if e is None else e
    elif isinstance(span, dict):
        s = seconds(first(span, ("start_seconds", "startSeconds", "start", "begin"))) if s is None else s
        e = seconds(first(span, ("end_seconds", "endSeconds", "end", "finish"))) if e is None else e
    s, e = start if s is None else s, end if e is None else e
    return (s, e) if s is not None and e is not None and s < e else None


def listed(doc, names, keyed):
    if isinstance(doc, list):
        return doc
    if not isinstance(doc, dict):
        return None
    for n in names:
        if n in doc:
            v = doc[n]
            if keyed and isinstance(v, dict) and v and all(isinstance(x, dict) for x in v.values()):
                return [v[k] for k in sorted(v)]
            return v if isinstance(v, list) else None
    return [doc] if keyed and ("claims" in doc or "kind" in doc) else None


def topic(raw, n):
    if not isinstance(raw, dict):
        return "not an object"
    title, goal, time = text(first(raw, P.TITLE)), text(first(raw, P.GOAL)), interval(raw, 1.0, 400.0)
    if not (title and goal and time):
        return "no title" if not title else "no goal" if not goal else "no time"
    evidence, flag = ids(first(raw, P.EVIDENCE)) or [], first(raw, ("speculative", "is_speculative", "isSpeculative"))
    return identifier(first(raw, ("id", "topic_id", "topicId"))) or f"topic-b-{n:02}", title, goal, *time, evidence, flag if isinstance(flag, bool) else None if evidence else True


def unit(raw, n):
    if not isinstance(raw, dict):
        return "not an object"
    time, name, out = interval(raw, 0.0, 9.0), identifier(first(raw, ("id", "unit_id", "unitId"))) or f"unit-s-{n:02}", []
    if not time:
        return "no time"
    if not isinstance(raw.get("claims"), list):
        return "no claims"
    for i, c in enumerate(raw["claims"], 1):
        if isinstance(c, dict) and (t := text(first(c, ("text", "claim", "statement", "content")))) and (e := ids(first(c, (*P.EVIDENCE, "evidence_id")))):
            own, status, k = identifier(first(c, ("id", "claim_id", "claimId"))) or f"{name[:80]}-c{i:02}", (text(first(c, ("status", "claim_status"))) or "").lower(), 2
            base = own
            while own in [x[0] for x in out]:
                own, k = f"{base}-{k}", k + 1
            out.append((own, t, e, status if status in P.STATUSES else "draft"))
    kind = (text(first(raw, ("kind", "type", "unit_kind", "unitKind"))) or "").lower()
    topic_id, segments = identifier(first(raw, ("topic_id", "topicId"))) or "T", ids(first(raw, ("segment_ids", "segmentIds", "segment_id"))) or ["s"]
    return (name, topic_id, segments, *time, kind if kind in P.KINDS else P.KIND_ALIASES.get(kind, "concept"), out) if out else "no usable claim"


def odd(rng, names, depth=0):
    """A JSON value of any kind, with the fields that matter more often than not."""
    plain = [None, True, False, 0, 7, -3, 2.5, 1e300, "", " ", " x ", "12", "3.5 ", "é漢", "a" * 101, "recap", "Steps", "SUPPORTED"]
    if depth > 3 or rng.random() < 0.45:
        return rng.choice(plain)
    if rng.random() < 0.4:
        return [odd(rng, names, depth + 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice(names): odd(rng, names, depth + 1) for _ in range(rng.randint(0, 7))}


def made(rng, names, extra, wrap):
    """Mostly items with the fields that an item needs, some of them odd."""
    items = [{**odd_object(rng, names), **{k: v for k, v in extra(rng).items() if rng.random() < 0.9}} if rng.random() < 0.85 else odd(rng, names) for _ in range(rng.randint(0, 3))]
    doc = rng.choice([items, {rng.choice(wrap): items}, {wrap[-1]: items, wrap[0]: rng.choice([None, items])}, {wrap[0]: {f"k{i}": x for i, x in enumerate(items)}}, items[0] if items else {}, odd(rng, names)])
    return json.dumps(doc, ensure_ascii=False)


def odd_object(rng, names):
    return {rng.choice(names): odd(rng, names, 3) for _ in range(rng.randint(0, 3))}


FIELDS = [*P.TITLE[:2], *P.GOAL[:2], *P.EVIDENCE[:3], *P.START[:2], *P.END[:2], *P.SPAN[:2], "id", "topic_id", "kind", "text", "status", "speculative", "segment_ids"]


def docs(seed, extra, wrap):
    rng = random.Random(seed)
    return [(i, made(rng, FIELDS, extra, wrap)) for i in range(250)] + [(900, "{"), (901, ""), (902, None), (903, "[]"), (904, "3"), (905, '{"%s": {}}' % wrap[0])]


def settled(rows, names, keyed, one):
    taken, refused = {}, set()
    for i, payload in rows:
        try:
            found = listed(json.loads(payload or ""), names, keyed)
        except ValueError:
            refused.add((i, None, "not json"))
            continue
        if found is None:
            refused.add((i, None, "no list"))
        for n, raw in enumerate(found or [], 1):
            got = one(raw, n)
            if isinstance(got, str):
                refused.add((i, n, got))
            else:
                taken[i, n] = got
    return taken, refused


def test_topics(spark):
    rows = docs(1, lambda r: {"title": r.choice(["t", " u ", 5]), "goal": "g", "start": r.choice([3, "4", -1, 500]), "evidence": r.choice(["e", ["e", {"id": 7}, True, {"evidence_id": "x"}, None], 5])}, P.TOPICS)
    want, refused = settled(rows, P.TOPICS, False, topic)
    taken, out = P.topics(spark.createDataFrame([(*r, "b", 1.0, 400.0) for r in rows], "i int, payload string, block_id string, block_start double, block_end double"), ["i"])
    assert {(r.i, r.n): (r.id, r.title, r.goal, r.start, r.end, r.evidence_ids, r.speculative) for r in taken.collect()} == want and len(want) > 30
    assert {tuple(r) for r in out.collect()} == refused and {x[2] for x in refused} == {"not json", "no list", "not an object", "no title", "no goal", "no time"}


def test_units(spark):
    claim = lambda r: r.choice([{"text": "a", "evidence": "e"}, {"id": "x", "claim": " b ", "sources": [1, " "], "status": r.choice(["Supported", "odd", 3])}, {"text": "a"}, {"text": " ", "evidence": "e"}, "no", {"id": "x-2", "text": "c", "evidence_id": "z"}])
    rows = docs(2, lambda r: {"claims": [claim(r) for _ in range(r.randint(0, 4))], "kind": r.choice(["recap", " Note ", "odd", 4]), "segment_ids": r.choice([["s1", 2], "s3", [], None])}, P.UNITS)
    want, refused = settled(rows, P.UNITS, True, unit)
    taken, out = P.units(spark.createDataFrame([(*r, "s", "T", 0.0, 9.0) for r in rows], "i int, payload string, segment_id string, topic_id string, context_start double, context_end double"), ["i"])
    got = {(r.i, r.n): (r.id, r.topic_id, r.segment_ids, r.start, r.end, r.kind, [(c.id, c.text, c.evidence_ids, c.status) for c in r.claims]) for r in taken.collect()}
    assert got == want and len(want) > 30
    assert {tuple(r) for r in out.collect()} == refused and {x[2] for x in refused} >= {"not json", "no list", "not an object", "no claims", "no usable claim"}


def test_items_are_settled_once(spark):
    """Neither what is taken nor what is refused reads the JSON again, and an empty list gives neither."""
    rows = [(1, '{"topics": []}'), (2, "{"), (3, "5"), (4, '[{"title": "t", "goal": "g"}, 7]'), (5, None)]
    rows = spark.createDataFrame(rows, "k long, payload string").selectExpr("*", "'b' AS block_id", "0D AS block_start", "9D AS block_end")
    taken, refused = P.topics(rows, ["k"])
    assert [(r.k, r.n, r.title) for r in taken.collect()] == [(4, 1, "t")]
    assert sorted((r.k, r.n or 0, r.reason) for r in refused.collect()) == [(2, 0, "not json"), (3, 0, "no list"), (4, 2, "not an object"), (5, 0, "not json")]
    for found in (taken, refused):
        assert "parse_json" not in found._jdf.queryExecution().optimizedPlan().toString().lower()


def test_units_are_looked_up_once(spark, monkeypatch):
    """The JSON is parsed for one table, and no task's share of the claims grows with the payloads."""
    written = []
    monkeypatch.setattr(P.Steps, "write", lambda self, rows, write=P.Steps.write: written.append(rows) or write(self, rows))
    rows = spark.range(3).selectExpr("id AS k", """concat('[{"claims": [{"text": "', id, '", "evidence": "e"}], "end": 2}]') AS payload""", "'s' AS segment_id", "'T' AS topic_id", "0D AS context_start", "9D AS context_end")
    taken, refused = P.units(rows, ["k"])
    assert taken.count() == 3 and refused.isEmpty()
    parsed = [x._jdf.queryExecution().optimizedPlan().toString().lower().replace("_", "").count("parsejson") for x in written]
    assert len(parsed) == 2 and parsed[0] >= 1 and parsed[1] == 0

"""Evidence, reduction and selection operators bound to the harness tables, each with the same question in SQL.

A user's timeline has captions (two events of three), frames (the third one) and text regions of every second frame.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence, intervals, reduction, selection, sequence, verification
from ..sources import listings
from . import budget
from .queries import DAYS, DURATION, EV, ISLANDS, USER, events, islands, query, table, timelines

SEG = f"""{EV}, seg AS (SELECT user_id, 'seg-' || event_id AS id, "start", "end", event_type AS text, event_id FROM ev WHERE event_id % 3 <> 0 AND "start" < "end"),
  occ AS (SELECT user_id, 'frame-' || event_id AS id, event_id % 11 AS asset, "start" AS requested, CASE WHEN event_id % 2 = 0 THEN "start" + 0.5 END AS stamped,
    CASE WHEN event_id % 5 = 0 THEN "start" + 0.25 END AS actual, CASE event_id % 7 WHEN 0 THEN 'dark' WHEN 1 THEN '' END AS reject_reason, event_id FROM ev WHERE event_id % 3 = 0),
  asset AS (SELECT DISTINCT event_id % 11 AS asset, CASE WHEN event_id % 11 % 4 = 3 THEN 'scene' ELSE 'frame' END AS role FROM events WHERE event_id % 11 <> 10),
  acc AS (SELECT occ.*, coalesce(actual, stamped, requested) AS t FROM occ JOIN asset ON occ.asset = asset.asset WHERE role = 'frame' AND coalesce(reject_reason, '') = ''),
  reg AS (SELECT user_id, 'ocr-' || event_id AS id, id AS parent, 'board ' || event_id AS text FROM occ WHERE event_id % 2 = 0)"""


def captions(spark, d):
    rows = events(spark, d).where("event_id % 3 <> 0 and start < end")
    return rows.select("user_id", F.concat(F.lit("seg-"), F.col("event_id").cast("string")).alias("id"), "start", "end", F.col("event_type").alias("text"), "event_id")


def occurrences(spark, d):
    e = F.col("event_id")
    reject = F.when(e % 7 == 0, "dark").when(e % 7 == 1, "")
    rows = events(spark, d).where("event_id % 3 = 0")
    return rows.select("user_id", F.concat(F.lit("frame-"), e.cast("string")).alias("id"), (e % 11).alias("asset"), F.col("start").alias("requested"), F.when(e % 2 == 0, F.col("start") + 0.5).alias("stamped"), F.when(e % 5 == 0, F.col("start") + 0.25).alias("actual"), reject.alias("reject_reason"), "event_id")


def assets(spark, d):
    rows = table(spark, d, "events").select((F.col("event_id") % 11).alias("asset")).distinct().where("asset <> 10")
    return rows.withColumn("role", F.when(F.col("asset") % 4 == 3, "scene").otherwise("frame"))


def regions(spark, d):
    e = F.col("event_id").cast("string")
    return occurrences(spark, d).where("event_id % 2 = 0").select("user_id", F.concat(F.lit("ocr-"), e).alias("id"), F.col("id").alias("parent"), F.concat(F.lit("board "), e).alias("text"))


def frames(spark, d):
    return evidence.accepted(occurrences(spark, d), assets(spark, d))


def days(spark, d):
    k = F.explode(F.sequence(F.lit(0), F.lit(DAYS - 1)))
    return timelines(spark, d).select("user_id", k.alias("window")).withColumn("start", F.col("window") * 86400.0).withColumn("end", F.col("start") + 86400.0)


# evidence


@query(f"WITH {SEG} SELECT id, t FROM acc")
def p1_accepted_frames(spark, d):
    return frames(spark, d).select("id", "t")


@query(f"""WITH {SEG}, win AS (SELECT user_id, CAST(k AS INTEGER) AS "window", k * 86400.0 AS s, k * 86400.0 + 86400 AS e FROM (SELECT DISTINCT user_id FROM events) u, range(0, {DAYS}) r(k)),
  ins AS (SELECT win.user_id, "window", acc.id, acc.t FROM win JOIN acc ON win.user_id = acc.user_id AND s <= t AND t < e),
  f AS (SELECT win.user_id, "window", seg.id, seg."start" AS pos, 0 AS kind FROM win JOIN seg ON win.user_id = seg.user_id AND seg."end" > s AND seg."start" < e
    UNION ALL SELECT user_id, "window", id, t, 1 FROM ins UNION ALL SELECT ins.user_id, "window", reg.id, t, 2 FROM ins JOIN reg ON reg.user_id = ins.user_id AND reg.parent = ins.id)
  SELECT user_id, "window", id, CAST(row_number() OVER (PARTITION BY user_id, "window" ORDER BY kind, pos, id) AS INTEGER) AS n FROM f""")
def j3_evidence_in_range(spark, d):
    return evidence.in_range(days(spark, d), captions(spark, d), frames(spark, d), regions(spark, d), USER, width=86400.0)


@query(f"""WITH {SEG} SELECT user_id, id, text FROM seg UNION ALL SELECT user_id, id, text FROM reg UNION ALL SELECT user_id, parent, trim(string_agg(text, ' ' ORDER BY id)) FROM reg GROUP BY user_id, parent""")
def j11_evidence_index(spark, d):
    return evidence.index(captions(spark, d), regions(spark, d), USER)


@query(f"""WITH {SEG} SELECT user_id, id FROM seg UNION SELECT user_id, id FROM occ UNION SELECT user_id, id FROM reg""")
def a18_universe(spark, d):
    return evidence.universe(*(f(spark, d).select("user_id", "id") for f in (captions, occurrences, regions)))


@query(f"""WITH {ISLANDS}, cut AS (SELECT user_id, greatest("start", 0.0) AS s, least("end", {DURATION}) AS e FROM islands WHERE "start" < {DURATION}),
  marks AS (SELECT * FROM cut UNION ALL SELECT DISTINCT user_id, 0.0, 0.0 FROM events UNION ALL SELECT DISTINCT user_id, {DURATION}, {DURATION} FROM events),
  gaps AS (SELECT user_id, max(e) OVER w AS "start", lead(s) OVER w AS "end" FROM marks WINDOW w AS (PARTITION BY user_id ORDER BY s, e)),
  issue AS (SELECT user_id, event_id, 'issue-' || event_id % 3 AS reason, CASE WHEN event_id % 14 <> 0 THEN "start" - 600 END AS s, CASE WHEN event_id % 21 <> 0 THEN "end" END AS e FROM ev WHERE event_id % 7 = 0),
  rows AS (SELECT user_id, 0 AS part, "start" AS pos, "start", "end", 'uncovered' AS reason FROM gaps WHERE "start" < "end"
    UNION ALL SELECT user_id, 1, event_id, CASE WHEN s < e THEN greatest(0.0, least({DURATION}, s)) ELSE 0.0 END, CASE WHEN s < e THEN greatest(0.0, least({DURATION}, e)) ELSE {DURATION} END, reason FROM issue)
  SELECT user_id, 'gap-' || lpad(CAST(row_number() OVER (PARTITION BY user_id ORDER BY part, pos) AS VARCHAR), CAST(greatest(4, length(CAST(row_number() OVER (PARTITION BY user_id ORDER BY part, pos) AS VARCHAR))) AS INTEGER), '0') AS gap, "start", "end", reason FROM rows WHERE "start" < "end" """)
def i8_gap_rows(spark, d):
    e = F.col("event_id")
    issues = events(spark, d).where("event_id % 7 = 0").select("user_id", e.alias("order"), F.concat(F.lit("issue-"), (e % 3).cast("string")).alias("reason"), F.when(e % 14 != 0, F.col("start") - 600).alias("start"), F.when(e % 21 != 0, F.col("end")).alias("end"))
    return evidence.gap_rows(events(spark, d), timelines(spark, d), issues, USER)


@query(f"""WITH {EV} SELECT user_id, sum(greatest(0.0, coalesce(CASE WHEN event_id % 5 <> 0 THEN "end" END, 0.0) - "start")) AS seconds FROM ev GROUP BY user_id""")
def i16_clip_seconds(spark, d):
    return evidence.clip_seconds(events(spark, d).withColumn("end", F.when(F.col("event_id") % 5 != 0, F.col("end"))), USER)


@query(f"""WITH {EV} SELECT u.user_id, u.event_id AS id FROM ev u JOIN ev s ON u.user_id = s.user_id AND s."start" < s."end" AND u."start" < u."end" AND s."end" > u."start" AND u."end" > s."start"
  GROUP BY u.user_id, u.event_id HAVING count(*) >= 3 AND avg(s."end" - s."start") < 4000""")
def p10_rapid_changes(spark, d):
    units = events(spark, d).select("user_id", F.col("event_id").alias("id"), "start", "end")
    return evidence.rapid_changes(units, events(spark, d), USER, width=14400.0, seconds=4000.0)


@query(f"""WITH {EV}, r AS (SELECT event_id, "start" - 30 AS s, "start" - 30 + event_id % 45 AS e, ['clip', 'frame', 'audio', 'text'][event_id % 4 + 1] AS m, event_id % 3 AS rounds, greatest("start" - 20, 0.0) AS cs, "start" + 20 AS ce,
    event_id % 5 <> 0 AS video, event_id % 6 <> 0 AS images, event_id % 9 AS frames_left, event_id % 25 AS left_s FROM ev),
  c AS (SELECT *, greatest(s, cs) AS xs, least(e, ce) AS xe FROM r),
  g AS (SELECT *, CASE WHEN rounds >= 2 THEN 'round_limit' WHEN s < 0 OR e > {DURATION} + 1e-9 OR e <= s OR xe <= xs THEN 'out_of_range' WHEN m = 'clip' AND NOT video THEN 'modality_not_allowed'
    WHEN m = 'clip' AND (xe - xs < 5 OR xe - xs > 30) THEN 'clip_duration' WHEN m = 'clip' AND left_s < xe - xs THEN 'budget_exhausted' WHEN m = 'frame' AND NOT images THEN 'modality_not_allowed'
    WHEN m = 'audio' THEN 'modality_not_allowed' WHEN m = 'frame' AND frames_left <= 0 THEN 'budget_exhausted' ELSE 'accepted' END AS decision FROM c)
  SELECT event_id, decision, CASE WHEN decision IN ('round_limit', 'out_of_range') THEN s ELSE xs END AS cut_start, CASE WHEN decision IN ('round_limit', 'out_of_range') THEN e ELSE xe END AS cut_end FROM g""")
def p8_refinement_gate(spark, d):
    e, start = F.col("event_id"), F.col("start")
    rows = events(spark, d).select("event_id", (start - 30).alias("start"), (start - 30 + e % 45).alias("end"), F.get(F.array(*map(F.lit, ("clip", "frame", "audio", "text"))), (e % 4).cast("int")).alias("modality"), (e % 3).alias("rounds"), F.lit(2).alias("max_rounds"), F.lit(DURATION).alias("duration"), F.greatest(start - 20, F.lit(0.0)).alias("context_start"), (start + 20).alias("context_end"), (e % 5 != 0).alias("video"), (e % 6 != 0).alias("images"), F.lit(False).alias("audio"), (e % 9).alias("frames_left"), (e % 25).alias("seconds_left"))
    return evidence.refinement_gate(rows).select("event_id", "decision", "cut_start", "cut_end")


CITED = f"""{SEG}, cited AS (SELECT user_id, event_id, "start", "end", 'seg-' || (event_id + k * 7) AS id FROM ev, range(0, 3) r(k) UNION ALL SELECT user_id, event_id, "start", "end", 'frame-' || event_id FROM ev)"""


def citations(spark, d):
    e = F.col("event_id")
    ids = F.array(*(F.concat(F.lit("seg-"), (e + k * 7).cast("string")) for k in range(3)), F.concat(F.lit("frame-"), e.cast("string")))
    return events(spark, d).select("user_id", "event_id", "start", "end", F.explode(ids).alias("id"))


@query(f"""WITH {CITED} SELECT c.event_id, c.id FROM cited c LEFT JOIN seg ON seg.user_id = c.user_id AND seg.id = c.id WHERE seg.id IS NULL OR (seg."end" > c."start" AND seg."start" < c."end")""")
def j14_aligned_citations(spark, d):
    return evidence.aligned_citations(citations(spark, d), captions(spark, d), USER).select("event_id", "id")


@query(f"""WITH {CITED}, c AS (SELECT cited.user_id, cited.event_id AS page, seg.event_id AS pos, seg.id, text FROM cited JOIN seg ON seg.user_id = cited.user_id AND seg.id = cited.id),
  near AS (SELECT p.user_id, p.event_id AS page, seg."start" AS pos, seg.id, seg.text FROM ev p JOIN seg ON seg.user_id = p.user_id AND seg."end" > p."start" AND seg."start" < p."start" + 30 WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.user_id = p.user_id AND c.page = p.event_id)),
  f AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id, page ORDER BY pos, id) AS INTEGER) AS n FROM (SELECT * FROM c UNION ALL SELECT * FROM near))
  SELECT user_id, page, n, text FROM f WHERE n <= 6""")
def j25_page_excerpts(spark, d):
    pages = events(spark, d).select("user_id", F.col("event_id").alias("page"), "start")
    cited = citations(spark, d).select("user_id", F.col("event_id").alias("page"), "id").join(captions(spark, d).select("user_id", "id", F.col("event_id").alias("order")), ["user_id", "id"])
    return evidence.page_excerpts(pages, cited, captions(spark, d), USER, width=7200.0)


@query(f"""WITH {CITED}, all_ids AS (SELECT user_id, event_id % 40 AS page, 'frame-' || event_id * 3 AS id FROM ev UNION SELECT user_id, event_id % 40, id FROM cited)
  SELECT DISTINCT a.user_id, page, a.id FROM all_ids a JOIN acc ON acc.user_id = a.user_id AND acc.id = a.id""")
def j24_allowed_frames(spark, d):
    rows = events(spark, d).withColumn("page", F.col("event_id") % 40)
    shown = rows.select("user_id", "page", F.concat(F.lit("frame-"), (F.col("event_id") * 3).cast("string")).alias("id"))
    of_claims = citations(spark, d).select("user_id", F.col("event_id").alias("claim"), "id")
    return evidence.allowed_frames(shown, rows.select("user_id", "page", F.col("event_id").alias("claim")), of_claims, frames(spark, d), USER)


@query(f"""WITH {SEG}, cited AS (SELECT user_id, CASE WHEN event_id % 4 = 0 THEN 'ev-' ELSE '' END || 'ocr-' || event_id AS id FROM ev UNION SELECT user_id, 'frame-' || event_id FROM ev WHERE event_id % 5 = 0),
  bare AS (SELECT user_id, regexp_replace(id, '^ev-', '') AS id FROM cited), up AS (SELECT user_id, id FROM bare UNION SELECT reg.user_id, parent FROM reg JOIN bare ON bare.user_id = reg.user_id AND bare.id = reg.id)
  SELECT DISTINCT occ.user_id, occ.id FROM occ JOIN up ON up.user_id = occ.user_id AND up.id = occ.id""")
def j26_parent_frames(spark, d):
    e = F.col("event_id")
    rows = events(spark, d)
    cited = rows.select("user_id", F.concat(F.when(e % 4 == 0, "ev-").otherwise(""), F.lit("ocr-"), e.cast("string")).alias("id")).unionByName(rows.where("event_id % 5 = 0").select("user_id", F.concat(F.lit("frame-"), e.cast("string")).alias("id")))
    return evidence.with_parents(cited, regions(spark, d), occurrences(spark, d), USER)


@query(f"""WITH {CITED}, known AS (SELECT user_id, id FROM seg UNION SELECT user_id, id FROM acc)
  SELECT c.user_id, event_id % 40 AS page, string_agg(DISTINCT c.id, ',' ORDER BY c.id) AS cited FROM cited c JOIN known k ON k.user_id = c.user_id AND k.id = c.id GROUP BY c.user_id, event_id % 40""")
def j23_page_citations(spark, d):
    claims = events(spark, d).select("user_id", (F.col("event_id") % 40).alias("page"), F.col("event_id").alias("claim"))
    known = evidence.universe(captions(spark, d).select("user_id", "id"), frames(spark, d).select("user_id", "id"))
    found = evidence.page_citations(claims, citations(spark, d).select("user_id", F.col("event_id").alias("claim"), "id"), known, USER)
    return found.withColumn("cited", F.array_join("cited", ","))


@query("""WITH pulled AS (SELECT p_partkey + 40 AS id, p_brand, p_retailprice AS price, p_partkey AS n FROM part UNION ALL SELECT p_partkey + 41, p_brand, 0.0, p_partkey + 1000000 FROM part),
  f AS (SELECT *, row_number() OVER (PARTITION BY p_brand, id ORDER BY n) AS r FROM pulled)
  SELECT p_brand, p_partkey AS id, p_retailprice AS price FROM part UNION ALL SELECT p_brand, id, price FROM f WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM part p WHERE p.p_brand = f.p_brand AND p.p_partkey = f.id)""")
def r6_merged_catalogue(spark, d):
    part = table(spark, d, "part")
    seen = part.select("p_brand", F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"), F.lit(0).cast("long").alias("n"))
    one = part.select("p_brand", (F.col("p_partkey") + 40).alias("id"), F.col("p_retailprice").alias("price"), F.col("p_partkey").cast("long").alias("n"))
    two = part.select("p_brand", (F.col("p_partkey") + 41).alias("id"), F.lit(0.0).alias("price"), (F.col("p_partkey") + 1_000_000).cast("long").alias("n"))
    return evidence.merged_catalogue(seen, one.unionByName(two), ["p_brand"], "n").drop("n")


@query("""SELECT l_orderkey, CASE WHEN NOT bool_or(l_orderkey % 4 = 0) OR count(DISTINCT l_quantity) = 1 THEN min(l_quantity) END AS seek FROM lineitem GROUP BY l_orderkey""")
def p21_page_seek(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_orderkey") % 4 == 0, "summary").otherwise("content").alias("type"), F.col("l_quantity").alias("time"))
    return evidence.page_seek(rows, ["l_orderkey"])


@query("""WITH l AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 'draft' WHEN l_linenumber = 7 THEN 'evidence-only' ELSE 'verified' END AS label FROM lineitem)
  SELECT l_orderkey, CASE WHEN l_orderkey % 9 = 0 THEN 'evidence-only' WHEN bool_or(label = 'evidence-only') THEN 'evidence-only' WHEN bool_and(label = 'verified') THEN 'verified' ELSE 'review_required' END AS status FROM l GROUP BY l_orderkey""")
def p16_quality_status(spark, d):
    label = F.when(F.col("l_returnflag") == "R", "draft").when(F.col("l_linenumber") == 7, "evidence-only").otherwise("verified")
    decks = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(label).alias("labels"))
    mode = F.when(F.col("l_orderkey") % 9 == 0, "evidence-only").when(F.col("l_orderkey") % 2 == 0, "strict").otherwise("draft")
    return decks.select("l_orderkey", evidence.quality_status(mode, F.col("labels")).alias("status"))


KINDS = "['step', 'grounding', 'image_text', 'style', 'translation', 'number', 'unknown_ref']"


def checked_claims(spark, d):
    kinds = F.array(*map(F.lit, ("step", "grounding", "image_text", "style", "translation", "number", "unknown_ref")))
    check = F.struct("l_linenumber", F.get(kinds, ((F.col("l_partkey") + F.col("l_linenumber")) % 7).cast("int")).alias("kind"), (F.col("l_returnflag") != "R").alias("passed"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(check)).alias("checks"))
    return rows.withColumn("provenance", F.when(F.col("l_orderkey") % 5 == 0, "generated-practice").otherwise("source"))


CHECKED = f"""c AS (SELECT l_orderkey, l_linenumber AS n, {KINDS}[(l_partkey + l_linenumber) % 7 + 1] AS kind, l_returnflag <> 'R' AS passed FROM lineitem)"""


@query(f"""WITH {CHECKED} SELECT l_orderkey, l_orderkey % 5 <> 0 AND bool_or(NOT passed AND kind <> 'style') AS critical FROM c GROUP BY l_orderkey""")
def p13_critical_claims(spark, d):
    return checked_claims(spark, d).select("l_orderkey", evidence.is_critical(F.col("provenance"), F.col("checks")).alias("critical"))


@query(f"""WITH {CHECKED}, k AS (SELECT l_orderkey, 'grounding' AS kind, -3 AS n FROM c UNION ALL SELECT l_orderkey, 'number', -2 FROM c WHERE l_orderkey % 3 = 0 UNION ALL SELECT l_orderkey, 'generated_practice', -1 FROM c WHERE l_orderkey % 5 = 0
    UNION ALL SELECT l_orderkey, kind, n FROM c WHERE kind IN ('step', 'translation', 'image_text', 'unknown_ref') AND (NOT passed OR kind = 'step')),
  f AS (SELECT l_orderkey, kind, min(n) AS n FROM k GROUP BY l_orderkey, kind) SELECT l_orderkey, string_agg(kind, ',' ORDER BY n, kind) AS kinds FROM f GROUP BY l_orderkey""")
def a21_sample_kinds(spark, d):
    text = F.when(F.col("l_orderkey") % 3 == 0, "takes 5 steps").otherwise("takes some steps")
    return checked_claims(spark, d).select("l_orderkey", F.array_join(evidence.sample_kinds(text, F.col("provenance"), F.col("checks")), ",").alias("kinds"))


# reduction


@query("""WITH s AS (SELECT l_orderkey, l_linenumber AS part, CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'degraded' ELSE 'complete' END AS status, l_partkey % 3 AS n, CASE l_returnflag WHEN 'R' THEN 'e' || l_suppkey % 3 ELSE '' END AS error FROM lineitem)
  SELECT l_orderkey, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'degraded') OR sum(n) = 0 THEN 'degraded' ELSE 'complete' END AS status, coalesce(string_agg(error, '; ' ORDER BY part, error) FILTER (WHERE error <> ''), '') AS error FROM s GROUP BY l_orderkey""")
def a8_split_status(spark, d):
    flag = F.col("l_returnflag")
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("part"), F.when(flag == "R", "failed").when(flag == "A", "degraded").otherwise("complete").alias("status"), (F.col("l_partkey") % 3).alias("n_units"), F.when(flag == "R", F.concat(F.lit("e"), (F.col("l_suppkey") % 3).cast("string"))).otherwise("").alias("error"))
    return reduction.split_status(rows, ["l_orderkey"])


@query("""WITH s AS (SELECT l_orderkey, list(l_partkey % 40 ORDER BY l_linenumber, l_partkey % 40) FILTER (WHERE l_linenumber < 4) AS a, coalesce(list(l_suppkey % 40 ORDER BY l_linenumber, l_suppkey % 40) FILTER (WHERE l_linenumber > 2), []) AS b FROM lineitem GROUP BY l_orderkey),
  u AS (SELECT l_orderkey, unnest(list_concat(a, b)) AS x, generate_subscripts(list_concat(a, b), 1) AS i FROM s), f AS (SELECT l_orderkey, x, min(i) AS i FROM u GROUP BY l_orderkey, x)
  SELECT l_orderkey, string_agg(x, ',' ORDER BY i) AS ids, CASE WHEN l_orderkey % 3 = 0 OR l_orderkey % 4 = 0 THEN 'unresolved' WHEN l_orderkey % 3 = 1 OR l_orderkey % 4 = 1 THEN 'contradicted' ELSE 'supported' END AS status FROM f GROUP BY l_orderkey""")
def a10_merged_claims(spark, d):
    n = F.col("l_linenumber")
    ids = lambda c, own: F.transform(F.array_sort(F.collect_list(F.when(own, F.struct(n, (F.col(c) % 40).alias("x"))))), lambda s: s["x"])
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(ids("l_partkey", n < 4).alias("a"), ids("l_suppkey", n > 2).alias("b"))
    status = lambda m: F.when(F.col("l_orderkey") % m == 0, "unresolved").when(F.col("l_orderkey") % m == 1, "contradicted").otherwise("supported")
    return rows.select("l_orderkey", F.array_join(reduction.merged_ids(F.col("a"), F.col("b")), ",").alias("ids"), reduction.merged_status(status(3), status(4)).alias("status"))


UNITS = """u AS (SELECT p_brand, p_partkey AS id, ['procedure', 'concept', 'example', 'recap'][p_partkey % 4 + 1] AS kind, p_type AS topic, CAST(p_size AS DOUBLE) AS s, 'step ' || p_size || ' ' || split_part(p_name, ' ', 1) AS text FROM part),
  cl AS (SELECT *, regexp_replace(lower(text), '[^a-z0-9_]+', '', 'g') AS c FROM u)"""


def units(spark, d):
    kinds = F.array(*map(F.lit, ("procedure", "concept", "example", "recap")))
    return table(spark, d, "part").select("p_brand", F.col("p_partkey").alias("id"), F.get(kinds, (F.col("p_partkey") % 4).cast("int")).alias("kind"), F.col("p_type").alias("topic"), F.col("p_size").cast("double").alias("start"), F.col("p_partkey").alias("n"))


def unit_claims(spark, d):
    text = F.concat(F.lit("step "), F.col("p_size").cast("string"), F.lit(" "), F.split("p_name", " ")[0])
    return table(spark, d, "part").select("p_brand", F.col("p_partkey").alias("unit"), F.col("p_partkey").alias("claim"), text.alias("text"))


@query(f"""WITH {UNITS}, o AS (SELECT *, lead(id) OVER w AS id2, lead(topic) OVER w AS topic2, lead(c) OVER w AS c2, lead(s) OVER w AS s2 FROM cl WHERE kind = 'procedure' WINDOW w AS (PARTITION BY p_brand ORDER BY s, id))
  SELECT p_brand, id AS from_id, id2 AS to_id, 'step_before' AS kind FROM o WHERE topic = topic2 AND topic <> '' AND (contains(c, c2) OR contains(c2, c) OR s2 = s + 1)""")
def r3_justified_edges(spark, d):
    return reduction.justified_edges(units(spark, d), unit_claims(spark, d), ["p_brand"], of_kind="procedure", edge="step_before")


@query(f"""WITH {UNITS}, r AS (SELECT p_brand, id, regexp_replace(c, '^step[0-9]+', '') AS c FROM cl WHERE kind = 'recap'), t AS (SELECT p_brand, id, regexp_replace(c, '^step[0-9]+', '') AS c FROM cl WHERE kind <> 'recap')
  SELECT r.p_brand, r.id AS recap, min(t.id) AS source FROM r JOIN t ON r.p_brand = t.p_brand AND (contains(r.c, t.c) OR contains(t.c, r.c)) WHERE r.c <> '' GROUP BY r.p_brand, r.id""")
def j20_recap_sources(spark, d):
    claims = table(spark, d, "part").select("p_brand", F.col("p_partkey").alias("unit"), F.split("p_name", " ")[0].alias("text"))
    return reduction.recap_sources(units(spark, d), claims, ["p_brand"])


@query("""WITH e AS (SELECT l_suppkey, l_orderkey AS owner, CASE WHEN l_linenumber % 3 = 0 THEN l_orderkey WHEN l_linenumber % 3 = 1 THEN l_partkey ELSE -l_partkey END AS from_id, l_orderkey + 1 AS to_id FROM lineitem),
  x AS (SELECT e.*, EXISTS (SELECT 1 FROM part JOIN lineitem i ON p_partkey = i.l_partkey WHERE p_partkey = from_id AND p_size < 25 AND i.l_suppkey = e.l_suppkey) AS is_claim, EXISTS (SELECT 1 FROM lineitem i WHERE i.l_suppkey = e.l_suppkey AND i.l_orderkey = from_id) AS is_unit FROM e)
  SELECT DISTINCT l_suppkey, CASE WHEN from_id <> owner AND NOT is_claim AND is_unit THEN from_id ELSE owner END AS owner, from_id, to_id, 'supports' AS kind FROM x""")
def r4_owned_edges(spark, d):
    lines, n = table(spark, d, "lineitem"), F.col("l_linenumber") % 3
    edges = lines.select("l_suppkey", F.col("l_orderkey").alias("owner"), F.when(n == 0, F.col("l_orderkey")).when(n == 1, F.col("l_partkey")).otherwise(-F.col("l_partkey")).alias("from_id"), (F.col("l_orderkey") + 1).alias("to_id"), F.lit("supports").alias("kind"))
    claims = table(spark, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("claim"))
    own = lines.select("l_suppkey", F.col("l_partkey").alias("claim")).distinct().join(claims, "claim")
    return reduction.owned_edges(edges, lines.select("l_suppkey", F.col("l_orderkey").alias("id")), own, ["l_suppkey"])


@query(f"""WITH {EV} SELECT event_id, CASE WHEN ("start" >= 1296000 - 1e-6 OR "end" > 1296000 + 1e-6) AND event_id % 3 < 2 THEN 'unresolved' ELSE ['draft', 'supported', 'contradicted'][event_id % 3 + 1] END AS status,
  CASE WHEN "start" >= 1296000 - 1e-6 THEN "start" WHEN "end" > 1296000 + 1e-6 THEN 1296000.0 END AS gap_start FROM ev""")
def v16_coverage_marked(spark, d):
    status = F.get(F.array(*map(F.lit, ("draft", "supported", "contradicted"))), (F.col("event_id") % 3).cast("int"))
    covered = timelines(spark, d).select("user_id", F.lit(DURATION / 2).alias("covered_end"))
    return reduction.coverage_marked(events(spark, d).withColumn("status", status), covered, USER).select("event_id", "status", "gap_start")


@query(f"""WITH {EV}, f AS (SELECT event_id, user_id, "start" AS s, "end" AS e, ['unresolved', 'draft', 'supported'][event_id % 3 + 1] AS status FROM ev),
  n AS (SELECT user_id, event_id + 3 AS claim, "start" AS s, "end" AS e, CASE WHEN event_id % 2 = 0 THEN 'supported' ELSE 'draft' END AS status, event_id % 5 <> 0 AS has FROM ev)
  SELECT f.event_id AS claim, CASE WHEN n.status = 'supported' AND n.has THEN 'supported' ELSE f.status END AS status, CASE WHEN n.has THEN 'own,native' ELSE 'own' END AS evidence
  FROM f LEFT JOIN n ON n.user_id = f.user_id AND n.claim = f.event_id AND n.e > f.s AND n.s < f.e""")
def j22_native_merged(spark, d):
    e = F.col("event_id")
    status = F.get(F.array(*map(F.lit, ("unresolved", "draft", "supported"))), (e % 3).cast("int"))
    own = events(spark, d).select("user_id", e.alias("claim"), "start", "end", status.alias("status"), F.array(F.lit("own")).alias("evidence"))
    native = events(spark, d).select("user_id", (e + 3).alias("claim"), "start", "end", F.when(e % 2 == 0, "supported").otherwise("draft").alias("status"), F.when(e % 5 != 0, F.array(F.lit("native"))).otherwise(F.array().cast("array<string>")).alias("evidence"))
    return reduction.native_merged(own, native, USER).select("claim", "status", F.array_join("evidence", ",").alias("evidence"))


@query("""WITH o AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, 't' || o_orderkey AS id, o_orderpriority AS title, CAST(round(o_totalprice % 500) AS INTEGER) AS s FROM orders),
  t AS (SELECT *, s + 40 + n % 3 AS e FROM o)
  SELECT k, count(*) AS n_topics, CAST(sum(s) AS BIGINT) AS n_starts FROM (
    WITH RECURSIVE f AS (SELECT k, n, [{'s': s, 'e': e, 't': title}] AS kept FROM t WHERE n = 1
      UNION ALL SELECT t.k, t.n, CASE WHEN len(list_filter(f.kept, lambda y: least(y.e, t.e) > greatest(y.s, t.s) AND y.t <> t.title AND ((y.s = t.s AND y.e = t.e) OR least(y.e, t.e) - greatest(y.s, t.s) >= 0.5 * least(y.e - y.s, t.e - t.s)))) > 0 THEN f.kept
        ELSE list_append(f.kept, {'s': t.s, 'e': t.e, 't': t.title}) END FROM f JOIN t ON t.k = f.k AND t.n = f.n + 1)
    SELECT k, unnest(kept).s AS s FROM (SELECT k, arg_max(kept, n) AS kept FROM f GROUP BY k)) GROUP BY k""")
def r5_outline(spark, d):
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    start = F.round(F.col("o_totalprice") % 500).cast("int")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), n.alias("n"), F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderpriority").alias("title"), start.alias("start"))
    rows = rows.withColumn("end", F.col("start") + 40 + F.col("n") % 3)
    found = reduction.outline(rows, rows.select("k").distinct().withColumn("duration", F.lit(600.0)), "k")
    return found.groupBy("k").agg(F.count(F.lit(1)).alias("n_topics"), F.sum("start").cast("long").alias("n_starts"))


@query("""WITH c AS (SELECT p_brand, p_type AS kind, p_name AS text, p_size AS score, p_partkey AS n FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY p_brand, kind ORDER BY score DESC, n) AS r FROM c)
  SELECT p_brand, kind, substr(text, 1, 12) AS snippet, CAST(list_position(['PROMO', 'ECONOMY', 'SMALL'], kind) AS BIGINT) AS place FROM k WHERE r = 1 AND list_contains(['PROMO', 'ECONOMY', 'SMALL'], kind)""")
def a14_best_snippets(spark, d):
    rows = table(spark, d, "part").select("p_brand", F.col("p_type").alias("kind"), F.col("p_name").alias("text"), F.col("p_size").alias("score"), F.col("p_partkey").alias("n"))
    return reduction.best_snippets(rows, ["p_brand"], ("PROMO", "ECONOMY", "SMALL"), most=12)


@query("""WITH s AS (SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'O' THEN w ELSE 0 END) AS a, sum(CASE WHEN o_orderstatus = 'F' THEN w ELSE 0 END) AS b FROM (SELECT *, CAST(o_orderkey % 3 AS DOUBLE) AS w FROM orders) GROUP BY o_custkey)
  SELECT o_custkey, CASE WHEN greatest(a, b) <= 0 THEN 'other' WHEN a >= b THEN 'O' ELSE 'F' END AS kind, greatest(a, b) AS strength FROM s""")
def a16_strongest_kind(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", F.col("o_orderstatus").alias("kind"), (F.col("o_orderkey") % 3).cast("double").alias("w"))
    return reduction.strongest(rows, ["o_custkey"], ("O", "F"), F.col("w"))


@query("""WITH u AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, 'u' || o_orderkey % 3 AS id FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, id ORDER BY n) AS k FROM u),
  m AS (SELECT *, CASE WHEN k = 1 THEN id ELSE id || '-' || k END AS new_id, CASE WHEN n % 2 = 0 THEN 'c' ELSE 'c' || n END AS old_claim, row_number() OVER (PARTITION BY o_custkey, n % 2 = 0 ORDER BY n) AS j FROM r)
  SELECT o_custkey, CAST(n AS INTEGER) AS n, new_id, new_id AS from_id, CASE WHEN n % 2 = 1 OR j = 1 THEN old_claim ELSE old_claim || '-' || j END AS to_id FROM m""")
def w18_renumbered(spark, d):
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = table(spark, d, "orders").select("o_custkey", n.alias("n"), F.concat(F.lit("u"), (F.col("o_orderkey") % 3).cast("string")).alias("id"))
    claim = F.when(F.col("n") % 2 == 0, "c").otherwise(F.concat(F.lit("c"), F.col("n").cast("string")))
    edges = rows.select("o_custkey", "n", F.col("id").alias("from_id"), claim.alias("to_id"))
    new, _, moved = reduction.renumbered(rows, rows.select("o_custkey", "n", F.lit(1).alias("m"), claim.alias("id")), edges, ["o_custkey"])
    return new.select("o_custkey", "n", F.col("unique_id").alias("new_id")).join(moved, ["o_custkey", "n"])


# sequences


@query(f"""WITH {EV}, c AS (SELECT event_id, "start" AS s, "end" AS e, [("start" + "end") / 2, "start" + ("end" - "start") * 0.25, "start" + ("end" - "start") * 0.75, "start"] AS xs FROM ev WHERE "end" - "start" >= 60)
  SELECT event_id, unnest(list_append(xs, e - 1e-3)) AS t FROM c""")
def w14_refinement_times(spark, d):
    rows = events(spark, d).where("end - start >= 60")
    return rows.select("event_id", F.explode(sequence.refinement_times(F.col("start"), F.col("end"), F.array(F.col("end"), F.col("start") + 0.0004), 6)).alias("t"))


@query(f"""WITH RECURSIVE {EV}, f AS (SELECT event_id, "start" AS s, "end" AS e FROM ev WHERE "start" < "end" UNION ALL
  SELECT event_id, CASE k WHEN 0 THEN s ELSE s + (e - s) / 2 END, CASE k WHEN 0 THEN s + (e - s) / 2 ELSE e END FROM f, range(0, 2) r(k) WHERE e - s > 1200 AND e - s > 1 + 1e-9)
  SELECT event_id, s AS "start", e AS "end", 'scheduled' AS status FROM f WHERE e - s <= 1200""")
def w6_halved_until_fit(spark, d):
    cores = events(spark, d).where("start < end").select("event_id", "start", "end")
    none = cores.limit(0).select("event_id", F.col("start").alias("at"))
    return sequence.halved_until_fit(cores, ["event_id"], lambda x: x.withColumn("fits", F.col("end") - F.col("start") <= 1200), none)


# selection, verification, ledgers


@query("""WITH c AS (SELECT o_custkey, o_orderkey AS id, o_orderpriority AS topic, o_orderstatus AS kind, o_totalprice AS score, o_orderkey % 17 = 0 AS must, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS needs FROM orders),
  a AS (SELECT *, CASE WHEN must THEN 0 WHEN row_number() OVER (PARTITION BY o_custkey, topic ORDER BY score DESC, id) = 1 THEN 1 ELSE 2 END AS cls FROM c),
  k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, kind ORDER BY cls, score DESC, id) AS rk FROM a),
  t AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY cls, score DESC, id) AS rn FROM k WHERE cls = 0 OR kind <> 'F' OR rk <= 2),
  taken AS (SELECT * FROM t WHERE cls = 0 OR rn <= 5),
  need AS (SELECT DISTINCT a.o_custkey, a.id, a.score FROM a WHERE EXISTS (SELECT 1 FROM taken x WHERE x.o_custkey = a.o_custkey AND x.id > a.id) AND NOT EXISTS (SELECT 1 FROM taken x WHERE x.o_custkey = a.o_custkey AND x.id = a.id)),
  more AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, id) AS rn FROM need)
  SELECT o_custkey, id, CASE cls WHEN 0 THEN 'mandatory' WHEN 1 THEN 'topic reserve' ELSE 'score' END AS reason FROM taken
  UNION ALL SELECT m.o_custkey, m.id, 'prerequisite' FROM more m WHERE rn <= 9 - (SELECT count(*) FROM taken x WHERE x.o_custkey = m.o_custkey)""")
def o5_budgeted(spark, d):
    orders = table(spark, d, "orders")
    rows = orders.select("o_custkey", F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("topic"), F.col("o_orderstatus").alias("kind"), F.col("o_totalprice").alias("score"), (F.col("o_orderkey") % 17 == 0).alias("mandatory"))
    # each needs the one before it
    needs = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    edges = orders.select("o_custkey", F.col("o_orderkey").alias("id"), needs.alias("needs")).where("needs is not null")
    return selection.budgeted(rows, edges, ["o_custkey"], target=5, most=9, caps={"F": 2}).select("o_custkey", "id", "reason")


@query("""WITH r AS (SELECT *, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS c FROM orders) SELECT o_custkey, o_orderkey AS id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY c, o_totalprice DESC, o_orderkey) AS n FROM r) WHERE n = 1""")
def o8_representatives(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("kind"), F.col("o_totalprice").alias("score"), F.lit(0).alias("start"))
    return selection.representatives(rows, ["o_custkey"], ("P", "O")).select("o_custkey", "id")


@query("""WITH r AS (SELECT o_custkey, o_orderkey AS id, o_orderstatus = 'F' AS ex, count(*) OVER (PARTITION BY o_custkey) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS n_ex, row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'F' ORDER BY o_orderkey) - 1 AS i FROM orders),
  g AS (SELECT *, i // 2 AS g FROM r WHERE n < 2 OR (n_ex > 0 AND ex AND i // 2 < 2) OR (n_ex = 0 AND i // 2 < 1))
  SELECT o_custkey, id, CASE WHEN n < 2 THEN id ELSE min(id) OVER (PARTITION BY o_custkey, g) END AS page_id FROM g""")
def o10_grouped_pages(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "example").otherwise("other").alias("kind"), F.col("o_orderkey").alias("position"))
    return selection.grouped_pages(rows, ["o_custkey"]).select("o_custkey", "id", "page_id")


@query("""WITH r AS (SELECT o_custkey, o_orderkey AS id, o_orderkey % 13 = 0 AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE 1 END, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey) AS n FROM orders)
  SELECT o_custkey, id FROM r WHERE p OR n <= 4""")
def o16_trimmed(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("class"), F.col("o_totalprice").alias("score"), (F.col("o_orderkey") % 13 == 0).alias("protected"))
    return selection.trimmed(rows, ["o_custkey"], ("1-URGENT", "2-HIGH"), 4).select("o_custkey", "id")


@query("""SELECT o_orderkey AS id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'F' THEN 3 ELSE 5 END, o_totalprice, o_orderkey) AS INTEGER) AS position FROM orders""")
def o17_pedagogical(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), "o_orderstatus", F.col("o_totalprice").alias("start"))
    group = F.when(F.col("o_orderstatus") == "P", 1).when(F.col("o_orderstatus") == "F", 3).otherwise(5)
    return selection.pedagogical(rows, ["o_custkey"], group).select("id", "position")


@query("""WITH c AS (SELECT DISTINCT o_custkey, o_orderkey AS claim FROM orders WHERE o_orderkey % 7 <> 0), v AS (SELECT o_custkey, o_orderkey AS claim, CASE o_orderstatus WHEN 'P' THEN 'insufficient' ELSE 'supported' END AS verdict, o_orderkey % 5 AS n FROM orders WHERE o_orderkey % 3 <> 0),
  p AS (SELECT o_custkey, claim, 'missing' AS problem FROM c WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.o_custkey = c.o_custkey AND v.claim = c.claim) UNION SELECT o_custkey, claim, 'unknown' FROM v WHERE NOT EXISTS (SELECT 1 FROM c WHERE v.o_custkey = c.o_custkey AND v.claim = c.claim)
    UNION SELECT o_custkey, claim, 'unresolved' FROM v WHERE verdict <> 'supported' UNION SELECT o_custkey, claim, 'ungrounded' FROM v WHERE n = 0)
  SELECT o_custkey, problem, string_agg(claim, ',' ORDER BY claim) AS ids FROM p GROUP BY o_custkey, problem""")
def v11_closure_problems(spark, d):
    orders = table(spark, d, "orders")
    claims = orders.where("o_orderkey % 7 <> 0").select("o_custkey", F.col("o_orderkey").alias("claim"))
    verdict = F.when(F.col("o_orderstatus") == "P", "insufficient").otherwise("supported")
    verdicts = orders.where("o_orderkey % 3 <> 0").select("o_custkey", F.col("o_orderkey").alias("claim"), verdict.alias("verdict"), (F.col("o_orderkey") % 5).alias("n_supporting"))
    found = verification.closure_problems(claims, verdicts, ["o_custkey"])
    return found.withColumn("ids", F.array_join("ids", ","))


@query("""WITH j AS (SELECT o_custkey, o_orderpriority AS topic, o_orderkey AS claim, o_orderkey % 2 = 0 AS example, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'supported' ELSE 'insufficient' END AS verdict FROM orders)
  SELECT claim FROM j WHERE example AND (verdict IS NULL OR verdict <> 'supported') AND EXISTS (SELECT 1 FROM j s WHERE s.o_custkey = j.o_custkey AND s.topic = j.topic AND NOT s.example AND s.verdict = 'supported')""")
def v12_kept_examples(spark, d):
    orders = table(spark, d, "orders")
    claims = orders.select("o_custkey", F.col("o_orderpriority").alias("topic"), F.when(F.col("o_orderkey") % 2 == 0, "example").otherwise("concept").alias("kind"), F.col("o_orderkey").alias("claim"))
    verdicts = orders.where("o_orderkey % 3 <> 0").select("o_custkey", F.col("o_orderkey").alias("claim"), F.when(F.col("o_orderstatus") == "F", "supported").otherwise("insufficient").alias("verdict"))
    return verification.kept_examples(claims, verdicts, ["o_custkey"]).select("claim")


@query("""SELECT page_id, page_id % 3 = 0 AS safe_link, page_id % 4 < 2 AS safe_path FROM pages""")
def p14_safe_links(spark, d):
    i = F.col("page_id")
    link = F.when(i % 6 == 0, F.concat(F.lit("t="), i.cast("string"), F.lit("s"))).when(i % 3 == 0, F.concat(F.lit("https://www.youtube.com/watch?v=a_b-c&t="), i.cast("string"), F.lit("s"))).when(i % 3 == 1, "http://www.youtube.com/watch?v=x&t=1s").otherwise("t=-1s")
    path = F.when(i % 4 == 0, F.concat(F.lit("assets/f"), i.cast("string"), F.lit(".JPG"))).when(i % 4 == 1, "a.b/c.webp").when(i % 4 == 2, "assets/../x.png").otherwise("/assets/x.png")
    return table(spark, d, "pages").select("page_id", T.is_safe_time_link(link).alias("safe_link"), T.is_safe_asset_path(path).alias("safe_path"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN 'note ' || o_orderkey ELSE '[' || CASE o_orderkey % 3 WHEN 0 THEN 'DRAFT] 待核对，不能当作已核验结论。' ELSE 'EVIDENCE-ONLY] 仅证据索引，不是语义摘要，不能当作已核验结论。' END || ' note ' || o_orderkey END AS marked, 'note ' || o_orderkey AS bare FROM orders""")
def t28_quality_notes(spark, d):
    k = F.col("o_orderkey")
    label = F.when(k % 3 == 0, "draft").when(k % 3 == 1, "evidence-only").otherwise("verified")
    # marking what is marked changes nothing
    marked = T.marked_notes(label, T.marked_notes(label, F.concat(F.lit("note "), k.cast("string"))))
    return table(spark, d, "orders").select("o_orderkey", marked.alias("marked"), T.bare_notes(marked).alias("bare"))


@query("""SELECT o_custkey AS run, o_orderkey AS name, CASE WHEN o_orderkey % 5 = 0 THEN 'pending' WHEN o_orderkey % 3 = 0 THEN 'done' ELSE 'open' END AS status, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'new' ELSE 'old' END AS cache_key,
  CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 3 = 0 THEN NULL ELSE 'e' END AS error FROM orders""")
def b11_stage_ledger(spark, d):
    k = F.col("o_orderkey")
    own = table(spark, d, "orders").select(F.col("o_custkey").alias("run"), k.alias("name"), F.lit("open").alias("status"), F.lit("old").alias("cache_key"), F.lit("e").alias("error"))
    updates = own.where("name % 3 = 0").select("run", "name", F.lit("done").alias("status"), F.when(F.col("name") % 2 == 0, "new").alias("cache_key"), F.lit(None).cast("string").alias("error"))
    return budget.stages_reset(budget.stage_update(own, updates), own.where("name % 5 = 0"))


@query("""SELECT p_partkey, round(CAST(141 AS DOUBLE) * p_size, 6) AS seconds, CAST(floor(1.8 * p_size) AS INTEGER) AS calls, CAST(least(512, 8 * p_size) AS DOUBLE) AS memory_mb, CAST(round(greatest(0.0, greatest(2.0, 0.08 * p_size) - 0.01 * floor(1.8 * p_size)), 6) AS DOUBLE) AS headroom_usd FROM part""")
def b12_timeline_estimate(spark, d):
    found = table(spark, d, "part").select("p_partkey", budget.timeline_estimate(F.col("p_size").cast("double")).alias("e"))
    return found.select("p_partkey", F.round("e.seconds", 6).alias("seconds"), "e.calls", "e.memory_mb", F.round("e.headroom_usd", 6).alias("headroom_usd"))


@query("""SELECT p_partkey, CAST(p_size * 0.5 + 3 AS DOUBLE) AS local_back, CAST(p_size * 1.5 + 1 AS DOUBLE) AS s, CAST((p_size + 2) * 1.5 + 1 AS DOUBLE) AS e FROM part""")
def i15_mapped_ranges(spark, d):
    size = F.col("p_size").cast("double")
    span = intervals.mapped_range(size, size + 2, F.lit(1.5), F.lit(1.0))
    back = intervals.inverse_map(size + 6, F.lit(2.0), F.lit(0.0))
    return table(spark, d, "part").select("p_partkey", F.round(back, 6).alias("local_back"), span["start"].alias("s"), span["end"].alias("e"))



# listings and references


@query("""WITH r AS (SELECT o_custkey % 50 AS video, CASE WHEN o_orderkey % 4 = 0 THEN o_orderstatus || 'X' ELSE ['en', 'ja', 'de-AT', 'fr-orig'][o_orderkey % 4 + 1] END AS language, o_orderkey % 3 = 0 AS manual, ['vtt', 'srt', 'ttml'][o_orderkey % 3 + 1] AS format FROM orders),
  v AS (SELECT DISTINCT video, CASE video % 3 WHEN 0 THEN 'de-AT' WHEN 1 THEN 'fr' END AS language FROM r),
  g AS (SELECT video, min(regexp_replace(language, '-orig$', '')) AS o FROM r WHERE NOT manual AND language LIKE '%-orig' GROUP BY video),
  c AS (SELECT v.video, coalesce(v.language, g.o, '') AS own FROM v LEFT JOIN g ON g.video = v.video),
  k AS (SELECT r.video, manual, r.language, format, row_number() OVER (PARTITION BY r.video ORDER BY manual DESC, coalesce(nullif(list_position([own, split_part(own, '-', 1), own || '-orig', 'ja', 'ja-orig', 'en'], r.language), 0), 99), r.language, format DESC) AS n FROM r JOIN c ON c.video = r.video
    WHERE format IN ('vtt', 'srt') AND regexp_matches(r.language, '^[a-zA-Z]{2,3}(-[a-zA-Z0-9]+)*$'))
  SELECT video, manual, regexp_replace(language, '-orig$', '') AS language, format FROM k WHERE n = 1""")
def s17_chosen_track(spark, d):
    k = F.col("o_orderkey")
    pick = lambda names, m: F.get(F.array(*map(F.lit, names)), (k % m).cast("int"))
    language = F.when(k % 4 == 0, F.concat("o_orderstatus", F.lit("X"))).otherwise(pick(("en", "ja", "de-AT", "fr-orig"), 4))
    tracks = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("video"), language.alias("language"), (k % 3 == 0).alias("manual"), pick(("vtt", "srt", "ttml"), 3).alias("format"))
    videos = tracks.select("video").distinct().withColumn("language", F.when(F.col("video") % 3 == 0, "de-AT").when(F.col("video") % 3 == 1, "fr"))
    return listings.chosen_track(tracks, videos)


@query("""WITH r AS (SELECT page_id AS n, CASE WHEN page_id % 5 = 0 THEN 'list-' || page_id ELSE 'https://youtu.be/' || lpad(CAST(page_id % 90 AS VARCHAR), 11, 'v') END AS url FROM pages),
  e AS (SELECT r.n, coalesce(k, 0) AS pos, CASE WHEN k IS NULL THEN url ELSE 'https://www.youtube.com/watch?v=' || lpad(CAST((n + k) % 120 AS VARCHAR), 11, 'v') END AS url FROM r LEFT JOIN range(1, 4) t(k) ON n % 5 = 0),
  f AS (SELECT *, right(url, 11) AS key, row_number() OVER (PARTITION BY right(url, 11) ORDER BY n, pos) AS i FROM e)
  SELECT key, 0 AS part, n, CAST(pos AS INTEGER) AS place, url FROM f WHERE i = 1""")
def s4_expanded(spark, d):
    n = F.col("page_id")
    short = F.concat(F.lit("https://youtu.be/"), F.lpad((n % 90).cast("string"), 11, "v"))
    rows = listings.candidates(table(spark, d, "pages").select(n.alias("n"), F.when(n % 5 == 0, F.concat(F.lit("list-"), n.cast("string"))).otherwise(short).alias("url")))
    lists = table(spark, d, "pages").where("page_id % 5 = 0").select(F.concat(F.lit("list-"), n.cast("string")).alias("url"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("at"), n)
    lists = lists.select("url", "at", F.concat(F.lit("https://www.youtube.com/watch?v="), F.lpad(((n + F.col("at")) % 120).cast("string"), 11, "v")).alias("video"))
    return listings.expanded(rows, lists).withColumnRenamed("at", "place")


@query("""SELECT 'ocr-' || event_id || '-' || lpad(CAST(k + 1 AS VARCHAR), 4, '0') AS id, event_id AS parent, CASE k WHEN 0 THEN 'word' ELSE event_type END AS text, CASE k WHEN 0 THEN 'own' ELSE CASE WHEN event_id % 2 = 0 THEN 'shared' ELSE 'given' END END AS engine, CAST(CASE k WHEN 0 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS confidence
  FROM events, range(0, 2) t(k)""")
def s11_text_regions(spark, d):
    e = F.col("event_id")
    first = F.struct(F.array(F.lit(0.0)).alias("bbox"), F.lit(" word ").alias("text"), F.lit("own").alias("engine"), F.lit(0.5).alias("confidence"))
    second = F.struct(F.array(F.lit(1.0)).alias("bbox"), F.col("event_type").alias("text"), F.lit(None).cast("string").alias("engine"), F.lit(None).cast("double").alias("confidence"))
    result = F.to_json(F.struct(F.when(e % 2 == 0, "shared").alias("engine"), F.array(first, second).alias("regions")))
    found = listings.text_regions(table(spark, d, "events").select(e.alias("frame"), F.lit("a").alias("asset"), result.alias("json")), "given")
    return found.select("id", "parent", "text", "engine", "confidence")


@query("""SELECT conv_id, turn, CASE WHEN contains(lower(text), 'recap') OR contains(text, '回顾') OR contains(text, '复习') THEN 'recap' WHEN contains(lower(text), 'example') OR contains(text, '例如') OR contains(text, '比如') THEN 'example'
  WHEN contains(lower(text), 'step') OR contains(text, '步骤') OR contains(text, '首先') THEN 'procedure' WHEN contains(lower(text), 'vs') OR contains(lower(text), 'versus') OR contains(text, '对比') THEN 'comparison'
  WHEN contains(lower(text), 'warning') OR contains(text, '注意') OR contains(text, '警告') THEN 'warning' ELSE 'concept' END AS kind FROM conversations""")
def t29_kinds(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.kind_of(F.col("text")).alias("kind"))


REFS = """p AS (SELECT l_suppkey, l_orderkey AS page, CASE l_returnflag WHEN 'R' THEN 'content' WHEN 'A' THEN 'summary' ELSE 'quiz' END AS type, l_partkey % 60 AS claim FROM lineitem WHERE l_suppkey % 2 = 0 OR l_returnflag <> 'A')"""


def page_references(spark, d):
    rows = table(spark, d, "lineitem").where("l_suppkey % 2 = 0 or l_returnflag <> 'A'")
    kind = F.when(F.col("l_returnflag") == "R", "content").when(F.col("l_returnflag") == "A", "summary").otherwise("quiz")
    pages = rows.select("l_suppkey", F.col("l_orderkey").alias("page"), kind.alias("type"), (F.col("l_partkey") % 60).alias("claim"))
    return verification.references_by_type(pages, pages.where("claim < 50"), ["l_suppkey"])


@query(f"""WITH {REFS} SELECT l_suppkey, claim, coalesce(string_agg(page, ',' ORDER BY page) FILTER (WHERE type = 'content'), '') AS content, coalesce(string_agg(page, ',' ORDER BY page) FILTER (WHERE type = 'summary'), '') AS summary,
  coalesce(string_agg(page, ',' ORDER BY page) FILTER (WHERE type = 'quiz'), '') AS other FROM p WHERE claim < 50 GROUP BY l_suppkey, claim""")
def a20_references_by_type(spark, d):
    return page_references(spark, d).select("l_suppkey", "claim", *(F.array_join(c, ",").alias(c) for c in ("content", "summary", "other")))


@query(f"""WITH {REFS}, c AS (SELECT l_suppkey, claim, claim % 7 AS topic, bool_or(type = 'content') AS b, bool_or(type = 'summary') AS s FROM p WHERE claim < 50 GROUP BY l_suppkey, claim),
  t AS (SELECT l_suppkey, topic, string_agg(claim, ',' ORDER BY claim) FILTER (WHERE b) AS body, coalesce(string_agg(claim, ',' ORDER BY claim) FILTER (WHERE s), '') AS summaries FROM c WHERE l_suppkey IN (SELECT l_suppkey FROM c WHERE s) GROUP BY l_suppkey, topic)
  SELECT l_suppkey, topic, body, summaries, summaries = '' AS missing FROM t WHERE body IS NOT NULL""")
def a2_topic_coverage(spark, d):
    references = page_references(spark, d)
    topics = references.select("l_suppkey", "claim", (F.col("claim") % 7).alias("topic"))
    found = verification.topic_coverage(references, topics, ["l_suppkey"])
    return found.select("l_suppkey", "topic", F.array_join("body", ",").alias("body"), F.array_join("summaries", ",").alias("summaries"), "missing")


@query("""WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey AS id, o_totalprice AS s, o_orderstatus = 'F' AS x, lead(o_orderkey) OVER w AS id2, lead(o_totalprice) OVER w AS s2, lead(o_orderstatus) OVER w = 'F' AS x2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
  p AS (SELECT *, CASE WHEN s < s2 OR (s = s2 AND x AND NOT x2) THEN id ELSE id2 END AS loser, row_number() OVER (PARTITION BY o_custkey ORDER BY id) AS n FROM o WHERE id2 IS NOT NULL),
  f AS (SELECT o_custkey, n, [loser] AS lost FROM p WHERE n = 1 UNION ALL SELECT p.o_custkey, p.n, CASE WHEN list_contains(lost, p.id) OR list_contains(lost, p.id2) THEN lost ELSE list_append(lost, loser) END FROM f JOIN p ON p.o_custkey = f.o_custkey AND p.n = f.n + 1)
  SELECT o_custkey, unnest(arg_max(lost, n)) AS id FROM f GROUP BY o_custkey""")
def o4_demoted_duplicates(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("left_id"), F.col("o_totalprice").alias("left_score"), (F.col("o_orderstatus") == "F").alias("left_example"), F.col("o_orderkey").alias("left_start"))
    for c in ("id", "score", "example", "start"):
        rows = rows.withColumn(f"right_{c}", F.lead(f"left_{c}").over(Window.partitionBy("o_custkey").orderBy("left_id")))
    return selection.demoted_duplicates(rows.where("right_id is not null"), ["o_custkey"])


@query(f"""WITH {ISLANDS} SELECT user_id, 'visual' AS modality, "start", "end" FROM islands UNION ALL SELECT user_id, 'spoken', "start", "end" FROM ev WHERE event_id % 9 = 0""")
def r7_labelled_gaps(spark, d):
    own = lambda rows: rows.select("user_id", "start", "end")
    return evidence.labelled_gaps({"visual": own(islands(spark, d)), "spoken": own(events(spark, d).where("event_id % 9 = 0"))})


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN 'unresolved' ELSE l_returnflag END AS status FROM lineitem""")
def v17_marked_unresolved(spark, d):
    status = F.when(F.col("l_returnflag") == "N", "draft").otherwise(F.col("l_returnflag"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", reduction.mark_unresolved(status).alias("status"))


@query("""WITH f AS (SELECT l_orderkey, 'e' || l_suppkey % 3 AS reason, min(l_linenumber) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_orderkey, l_suppkey % 3) SELECT l_orderkey, string_agg(reason, ',' ORDER BY n, reason) AS reasons FROM f GROUP BY l_orderkey""")
def a9_verdict_reasons(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("order"), F.when(F.col("l_returnflag") == "N", "supported").otherwise("insufficient").alias("verdict"), F.concat(F.lit("e"), (F.col("l_suppkey") % 3).cast("string")).alias("reason"))
    return verification.verdict_reasons(rows, ["l_orderkey"]).withColumn("reasons", F.array_join("reasons", ","))


@query("""WITH s AS (SELECT o_custkey AS k, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) * 100 + o_custkey % 7 AS DOUBLE) AS pos FROM orders),
  x AS (SELECT k, pos FROM s UNION ALL SELECT DISTINCT k, 0.0 FROM s), n AS (SELECT k, pos, coalesce(lead(pos) OVER (PARTITION BY k ORDER BY pos), 5000.0) AS nxt FROM x)
  SELECT k, pos AS t FROM n UNION SELECT k, pos + i * 90.0 FROM n, range(1, 60) r(i) WHERE pos + i * 90.0 < nxt - 0.1""")
def w13_scene_samples(spark, d):
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    scenes = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), (n * 100 + F.col("o_custkey") % 7).cast("double").alias("start"))
    return sequence.scene_samples(scenes, scenes.select("k").distinct().withColumn("duration", F.lit(5000.0)), ["k"])

"""The operators bound to the harness tables, each with the same question in SQL.

An event is an interval of its user's timeline: it begins at its time (whole seconds from START)
and lasts its value in minutes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import coerce
from ..functions import text as T
from ..operators import intervals, joins, resolution, selection, sequence, verification
from ..streaming import live
from . import budget

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
START, DAYS = "2024-01-01", 30
DURATION = DAYS * 86400.0
USER = ["user_id"]

EV = """ev AS (SELECT event_id, user_id, event_type, value, floor(epoch(ts)) - 1704067200.0 AS "start",
  floor(epoch(ts)) - 1704067200.0 + floor(value * 60) AS "end" FROM events)"""
ISLANDS = f"""{EV}, fresh AS (SELECT *, CASE WHEN "start" > max("end") OVER (PARTITION BY user_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1
    WHEN row_number() OVER (PARTITION BY user_id ORDER BY "start", "end") = 1 THEN 1 ELSE 0 END AS fresh FROM ev WHERE "start" < "end"),
  named AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM fresh),
  islands AS (SELECT user_id, min("start") AS "start", max("end") AS "end" FROM named GROUP BY user_id, island)"""


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.unix_timestamp("ts") - F.unix_timestamp(F.lit(START).cast("timestamp"))).cast("double")
    rows = table(spark, sf_dir, "events").withColumn("start", start)
    return rows.select("event_id", "user_id", "event_type", "value", "start", (F.col("start") + F.floor(F.col("value") * 60)).alias("end"))


def timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id").distinct().withColumn("duration", F.lit(DURATION))


def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merged(events(spark, sf_dir), USER)


# intervals


@query(f'WITH {ISLANDS} SELECT user_id, "start", "end" FROM islands')
def i1_union(spark, d):
    return islands(spark, d)


@query(f"""WITH {ISLANDS}, cut AS (SELECT user_id, greatest("start", 0.0) AS s, least("end", {DURATION}) AS e FROM islands WHERE "start" < {DURATION}),
  marks AS (SELECT * FROM cut UNION ALL SELECT DISTINCT user_id, 0.0, 0.0 FROM events UNION ALL SELECT DISTINCT user_id, {DURATION}, {DURATION} FROM events),
  gaps AS (SELECT user_id, max(e) OVER w AS "start", lead(s) OVER w AS "end" FROM marks WINDOW w AS (PARTITION BY user_id ORDER BY s, e))
  SELECT user_id, "start", "end" FROM gaps WHERE "start" < "end" """)
def i2_holes(spark, d):
    return intervals.holes(events(spark, d), timelines(spark, d), USER)


@query(f"""WITH {ISLANDS}, cut AS (SELECT user_id, sum(least("end", {DURATION}) - greatest("start", 0.0)) AS covered FROM islands WHERE "start" < {DURATION} GROUP BY user_id)
  SELECT user_id, CAST({DURATION} AS DOUBLE) AS duration, covered, covered / {DURATION} AS ratio FROM cut""")
def i3_covered_seconds(spark, d):
    return intervals.covered_seconds(events(spark, d), timelines(spark, d), USER)


@query(f"""WITH {EV}, cut AS (SELECT user_id, greatest("start", 0.0) AS s, least("end", {DURATION}) AS e FROM ev WHERE "start" < "end" AND "start" < {DURATION}),
  cur AS (SELECT *, coalesce(max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS c FROM cut),
  parts AS (SELECT user_id, greatest(s, c) AS "start", e AS "end", false AS filler FROM cur WHERE greatest(s, c) < e
    UNION ALL SELECT user_id, c, s, true FROM cur WHERE s > c
    UNION ALL SELECT user_id, max(e), {DURATION}, true FROM cut GROUP BY user_id HAVING max(e) < {DURATION})
  SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY "start") AS INTEGER) AS n FROM parts""")
def i6_partition(spark, d):
    return intervals.partition_ranges(events(spark, d), timelines(spark, d), USER)


@query(f"""WITH {EV}, o AS (SELECT user_id, "start", "end", lag("end") OVER w AS b, lead("start") OVER w AS a FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY "start", "end")),
  f AS (SELECT user_id, "start", "end", CASE WHEN b IS NULL AND abs("start") > 1e-9 THEN 'first' WHEN b - "start" > 1e-9 THEN 'overlap' WHEN "start" - b > 1e-9 THEN 'gap'
    WHEN a IS NULL AND abs("end" - {DURATION}) > 1e-9 THEN 'last' END AS fault FROM o)
  SELECT * FROM f WHERE fault IS NOT NULL""")
def i5_tiling_faults(spark, d):
    return intervals.tiling_faults(events(spark, d).select("user_id", "start", "end"), timelines(spark, d), USER)


@query(f"""WITH {EV} SELECT event_id, coalesce(max("end") OVER (PARTITION BY user_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > "start", false)
  OR coalesce(lead("start") OVER (PARTITION BY user_id ORDER BY "start", "end") < "end", false) AS overlaps FROM ev""")
def w2_overlap_flags(spark, d):
    return intervals.overlap_flags(events(spark, d), USER).select("event_id", "overlaps")


@query(f"""WITH {EV}, c AS (SELECT event_id, greatest("start", 3600.0) AS s, least("end", {DURATION} - 3600.0) AS e FROM ev),
  k AS (SELECT event_id, s, e, (s + e) / 2 AS m, greatest(3600.0, least((s + e) / 2 - 2.5, {DURATION} - 3600.0 - 5)) AS ws FROM c WHERE s < e)
  SELECT event_id, CASE WHEN e - s < 5 THEN ws WHEN e - s > 30 THEN m - 15 ELSE s END AS clip_start,
    CASE WHEN e - s < 5 THEN least({DURATION} - 3600.0, ws + 5) WHEN e - s > 30 THEN m + 15 ELSE e END AS clip_end FROM k""")
def i14_minimal_clip(spark, d):
    clip = intervals.minimal_clip(F.col("start"), F.col("end"), F.lit(3600.0), F.lit(DURATION - 3600.0))
    return events(spark, d).select("event_id", clip.alias("c")).where("c is not null").select("event_id", F.col("c.start").alias("clip_start"), F.col("c.end").alias("clip_end"))


@query("""WITH RECURSIVE up AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 0 THEN p_partkey // 2 END AS parent, 1.0 + p_size / 64.0 AS scale, CAST(p_size AS DOUBLE) AS shift FROM part
  UNION ALL SELECT up.id, CASE WHEN p.p_partkey > 0 THEN p.p_partkey // 2 END, (1.0 + p.p_size / 64.0) * up.scale, p.p_size + (1.0 + p.p_size / 64.0) * up.shift FROM up JOIN part p ON up.parent = p.p_partkey)
  SELECT id, round(scale, 6) AS scale, round(shift, 4) AS shift FROM up WHERE parent IS NULL""")
def i15_source_maps(spark, d):
    p = table(spark, d, "part")
    clips = p.select(F.col("p_partkey").alias("id"), F.expr("if(p_partkey > 0, p_partkey div 2, null)").alias("parent"), F.col("p_size").cast("double").alias("offset"), (1.0 + F.col("p_size") / 64.0).alias("speed"))
    return intervals.source_maps(spark, clips).select("id", F.round("scale", 6).alias("scale"), F.round("shift", 4).alias("shift"))


@query("""SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE epoch(l_shipdate) < epoch(o_orderdate) OR epoch(l_shipdate) >= epoch(o_orderdate) + 86400 * 60""")
def i17_out_of_bounds(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select("l_orderkey", "l_linenumber", (F.unix_timestamp("l_shipdate") - F.unix_timestamp("o_orderdate")).cast("double").alias("t"), F.lit(86400.0 * 60).alias("duration"))
    return intervals.out_of_bounds(rows, "t", None, "duration").select("l_orderkey", "l_linenumber")


# joins


@query(f'WITH {ISLANDS} SELECT e.event_id, i."start" AS island_start FROM ev e JOIN islands i ON e.user_id = i.user_id AND e."end" > i."start" AND i."end" > e."start" AND e."start" < e."end"')
def j1_overlap_join(spark, d):
    right = islands(spark, d).select("user_id", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return joins.range_join(events(spark, d), right, USER, width=7200.0).select("event_id", F.col("r_start").alias("island_start"))


@query("""SELECT o_orderkey, l_linenumber FROM (SELECT o_orderkey, o_custkey, epoch(o_orderdate) AS t FROM orders) o
  JOIN (SELECT o_custkey AS c, l_orderkey, l_linenumber, epoch(l_shipdate) - 86400 * 20 AS s, epoch(l_shipdate) AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey) l ON c = o_custkey AND s <= t AND t < e""")
def j2_point_join(spark, d):
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    points = orders.select("o_custkey", "o_orderkey", F.unix_timestamp("o_orderdate").cast("double").alias("t"))
    end = F.unix_timestamp("l_shipdate").cast("double")
    spans = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_linenumber", (end - 86400 * 20).alias("start"), end.alias("end"))
    return joins.point_join(points, spans, ["o_custkey"], width=86400.0 * 10).select("o_orderkey", "l_linenumber")


@query(f"""WITH {ISLANDS}, six AS (SELECT u.user_id, 'day' || k AS day, k * 86400.0 AS s, (k + 1) * 86400.0 AS e FROM (SELECT DISTINCT user_id FROM events) u, range(0, {DAYS}) t(k)),
  p AS (SELECT i.user_id, i."start", s.day, row_number() OVER (PARTITION BY i.user_id, i."start" ORDER BY least(i."end", s.e) - greatest(i."start", s.s) DESC, s.s) AS rn
    FROM islands i JOIN six s ON i.user_id = s.user_id AND i."end" > s.s AND s.e > i."start")
  SELECT i.user_id, i."start", coalesce(p.day, 'day0') AS day FROM islands i LEFT JOIN p ON p.user_id = i.user_id AND p."start" = i."start" AND rn = 1""")
def j4_best_overlap(spark, d):
    days = timelines(spark, d).select("user_id", F.explode(F.sequence(F.lit(0), F.lit(DAYS - 1))).alias("k"))
    days = days.select("user_id", F.concat(F.lit("day"), F.col("k").cast("string")).alias("day"), (F.col("k") * 86400.0).alias("r_start"), ((F.col("k") + 1) * 86400.0).alias("r_end"))
    left = islands(spark, d).withColumn("id", F.col("start"))
    return joins.best_overlap(left, days, USER, "id", "day", width=86400.0).select("user_id", "start", "day")


@query(f"""WITH {EV} SELECT a.event_id, b.event_id AS near_id FROM ev a JOIN ev b ON a.user_id = b.user_id AND a."start" >= b."start" - 600 AND a."start" <= b."end" + 600""")
def j8_band_join(spark, d):
    ev = events(spark, d)
    points = ev.select("user_id", "event_id", F.col("start").alias("t"))
    return joins.band_join(points, ev.select("user_id", F.col("event_id").alias("near_id"), "start", "end"), USER, reach=600.0).select("event_id", "near_id")


@query("""SELECT 'label document' AS rule, CAST(doc_id AS VARCHAR) AS reference, count(*) AS n FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) GROUP BY doc_id
  UNION ALL SELECT 'line part', CAST(l_partkey AS VARCHAR), count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40) GROUP BY l_partkey
  UNION ALL SELECT 'order customer', CAST(o_custkey AS VARCHAR), count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY o_custkey""")
def j13_missing_references(spark, d):
    t = lambda name: table(spark, d, name)
    return joins.missing_references(
        {
            "label document": (t("labels"), "doc_id", t("documents"), "doc_id"),
            "line part": (t("lineitem"), "l_partkey", t("part").where("p_size < 40"), "p_partkey"),
            "order customer": (t("orders"), "o_custkey", t("customer").where("c_acctbal > 0"), "c_custkey"),
        }
    )


@query("""SELECT o_orderkey, lag(o_orderkey) OVER w AS previous, lead(o_orderkey) OVER w AS following FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def j19_neighbours(spark, d):
    return joins.neighbours(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey").select("o_orderkey", "previous", "following")


@query("""SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS joined FROM conversations GROUP BY conv_id""")
def j10_ordered_text(spark, d):
    return joins.ordered_text(table(spark, d, "conversations"), ["conv_id"], ["turn"], "text")


@query("""SELECT o_custkey AS k, 'unexpected' AS side FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20) GROUP BY 1
  UNION ALL SELECT c_custkey, 'missing' FROM customer WHERE c_nationkey < 20 AND c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def d1_set_differences(spark, d):
    expected = table(spark, d, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("k"))
    return joins.set_differences(expected, table(spark, d, "orders").select(F.col("o_custkey").alias("k")), "k")


# sequences


@query(f"""WITH {EV}, n AS (SELECT *, CASE WHEN "start" - lag("end") OVER (PARTITION BY user_id ORDER BY "start", event_id) > 7200 THEN 1 ELSE 0 END AS f FROM ev),
  s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY "start", event_id) AS session FROM n)
  SELECT event_id, CAST(session AS BIGINT) AS session, CAST((row_number() OVER (PARTITION BY user_id, session ORDER BY "start", event_id) - 1) // 4 AS BIGINT) AS part FROM s""")
def w11_sessions(spark, d):
    return sequence.sessions(events(spark, d), USER, ["start", "event_id"], gap=7200.0, most=4).select("event_id", "session", "part")


@query("""SELECT event_id, CAST((row_number() OVER w - 1) // 8 AS BIGINT) AS batch, printf('frm-%04d', row_number() OVER w) AS label FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def w8_batches(spark, d):
    rows = sequence.chunks(table(spark, d, "events"), USER, ["event_id"], 8)
    return sequence.numbered(rows, USER, ["event_id"], "frm").select("event_id", "batch", "label")


@query("""SELECT conv_id, turn FROM conversations WHERE regexp_matches(text, '[.!?。！？]["''”’)\\]]*\\s*$')""".replace("\\\\", "\\"))
def w3_sentence_boundaries(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "text", F.col("turn").alias("end"))
    return sequence.sentence_boundaries(rows, ["conv_id"]).select("conv_id", F.col("boundary").alias("turn"))


@query("""WITH RECURSIVE b AS (SELECT o_custkey AS k, list_sort(list_distinct(list(floor(o_totalprice % 1800)))) AS b FROM orders GROUP BY o_custkey),
  t AS (SELECT k, 1 AS n, CAST(0.0 AS DOUBLE) AS s, b, CASE WHEN 0.0 + 120 >= 1800.0 THEN 1800.0 ELSE CAST(coalesce(list_max(list_filter(b, lambda x: x > 0 + 1e-6 AND x <= 120 + 1e-9)), list_min(list_filter(b, lambda x: x > 120 AND x <= 180 + 1e-9)), 180.0) AS DOUBLE) END AS e FROM b
    UNION ALL
    SELECT k, n + 1, e, b, CASE WHEN e + 120 >= 1800.0 OR e + 180 >= 1800.0 - 1e-9 THEN 1800.0 ELSE CAST(coalesce(list_max(list_filter(b, lambda x: x > e + 1e-6 AND x <= e + 120 + 1e-9)), list_min(list_filter(b, lambda x: x > e + 120 AND x <= e + 180 + 1e-9)), e + 180) AS DOUBLE) END FROM t WHERE e < 1800.0)
  SELECT k, n, s AS core_start, e AS core_end, greatest(s - 10, 0.0) AS context_start, least(e + 10, 1800.0) AS context_end FROM t""")
def w5_tiles(spark, d):
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.array_sort(F.collect_set(F.floor(F.col("o_totalprice") % 1800).cast("double"))).alias("boundaries"))
    return sequence.tile(rows.withColumn("duration", F.lit(1800.0)), "k")


@query(f"""WITH {EV}, h AS (SELECT event_id, "start" AS s, "end" AS e FROM ev WHERE "end" - "start" >= 4)
  SELECT event_id, 0 AS half, s AS "start", (s + e) / 2 AS "end" FROM h UNION ALL SELECT event_id, 1, (s + e) / 2, e FROM h""")
def w9_halves(spark, d):
    return sequence.halves(events(spark, d).select("event_id", "start", "end"))


@query(f"""WITH {EV}, s AS (SELECT event_id, "start" AS s, "end" - "start" AS l FROM ev WHERE "start" < "end"),
  o AS (SELECT event_id, s, unnest(CASE WHEN l < 1 THEN [0.5 * l] ELSE [0.2 * l, 0.5 * l, 0.8 * l] END) AS x FROM s
    UNION ALL SELECT event_id, s, k * 900.0 FROM s, range(1, 60) t(k) WHERE k * 900.0 < l)
  SELECT DISTINCT event_id, round(s + x, 6) AS t FROM o""")
def w12_sample_times(spark, d):
    return sequence.sample_times(events(spark, d), ["event_id"], every=900.0)


@query("""WITH RECURSIVE o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, length(text) AS l FROM conversations),
  f AS (SELECT conv_id, i, 0 AS block, l AS total, 1 AS first FROM o WHERE i = 1
    UNION ALL SELECT o.conv_id, o.i, CASE WHEN f.total + o.l > 2000 THEN f.block + 1 ELSE f.block END, CASE WHEN f.total + o.l > 2000 THEN o.l ELSE f.total + o.l END, 0
    FROM f JOIN o ON o.conv_id = f.conv_id AND o.i = f.i + 1)
  SELECT conv_id, block, min(i) AS first, max(i) AS last, CAST(max(total) AS BIGINT) AS total FROM f GROUP BY conv_id, block""")
def w10_packed_blocks(spark, d):
    rows = table(spark, d, "conversations").withColumn("size", F.length("text"))
    return sequence.pack(rows, ["conv_id"], ["turn"], "size", 2000)


@query("""WITH n AS (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)
  SELECT p_partkey, CASE WHEN n = 1 THEN p_name ELSE substr(p_name, 1, 96) || '-' || n END AS unique_id FROM n""")
def w17_unique_ids(spark, d):
    return sequence.unique_ids(table(spark, d, "part"), [], ["p_partkey"], "p_name").select("p_partkey", "unique_id")


@query("""WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
  SELECT user_id, event_id FROM r WHERE n <= 7 OR i IN (SELECT CAST(round_even(k * (n - 1) / 6.0, 0) AS BIGINT) FROM range(0, 7) t(k))""")
def w19_evenly_spaced(spark, d):
    return sequence.evenly_spaced(table(spark, d, "events").select("user_id", "event_id"), USER, ["event_id"], 7)


@query("""WITH RECURSIVE t AS (SELECT conv_id, turn * 2.0 AS s, string_split(text, ' ') AS w FROM conversations),
  cues AS (SELECT conv_id, CAST(s + k * 0.5 AS DOUBLE) AS "start", CAST(s + 3 AS DOUBLE) AS "end", array_to_string(w[1:CAST(ceil(len(w) * (k + 1) / 3) AS BIGINT)], ' ') AS text FROM t, (SELECT unnest([0, 1, 2]) AS k)),
  numbered AS (SELECT *, regexp_split_to_array(trim(text), '[ \\t\\n\\x0B\\f\\r]+') AS words, row_number() OVER (PARTITION BY conv_id ORDER BY "start", "end", text) AS n FROM cues),
  walk AS (SELECT conv_id, CAST(1 AS BIGINT) AS n, [{'s': "start", 'e': "end", 'text': text, 'words': words}] AS kept FROM numbered WHERE n = 1
    UNION ALL SELECT conv_id, n, CASE WHEN s < kept[-1].e AND words = kept[-1].words THEN kept
        WHEN s < kept[-1].e AND len(words) > len(kept[-1].words) AND words[1:len(kept[-1].words)] = kept[-1].words
          THEN list_append(kept[1:len(kept) - 1], {'s': least(s, kept[-1].s), 'e': greatest(e, kept[-1].e), 'text': text, 'words': words})
        ELSE list_append(kept, {'s': s, 'e': e, 'text': text, 'words': words}) END
    FROM (SELECT w.conv_id, c.n, w.kept, c."start" AS s, c."end" AS e, c.text, c.words FROM walk w JOIN numbered c ON c.conv_id = w.conv_id AND c.n = w.n + 1)),
  done AS (SELECT conv_id, kept FROM walk QUALIFY n = max(n) OVER (PARTITION BY conv_id))
  SELECT conv_id, CAST(generate_subscripts(kept, 1) - 1 AS INTEGER) AS n, unnest(kept).s AS "start", unnest(kept).e AS "end", unnest(kept).text AS text FROM done""")
def w1_scroll_dedup(spark, d):
    words = F.split("text", " ")
    cues = table(spark, d, "conversations").select("conv_id", "turn", (F.col("turn") * 2.0).alias("start"), (F.col("turn") * 2.0 + 3).alias("end"), words.alias("w"))
    # each turn rolls in over three cues
    cues = cues.select("conv_id", F.explode(F.array(*[F.struct((F.col("start") + k * 0.5).alias("start"), F.col("end").alias("end"), F.array_join(F.slice("w", F.lit(1), F.ceil(F.size("w") * (k + 1) / 3).cast("int")), " ").alias("text")) for k in range(3)])).alias("c"))
    return sequence.scroll_dedup(cues.select("conv_id", "c.*"), ["conv_id"])


# selection


@query("""SELECT p_brand, p_partkey, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 2""")
def o3_top_of_topic(spark, d):
    return selection.top(table(spark, d, "part"), ["p_brand"], "p_retailprice", ["p_partkey"], 2).select("p_brand", "p_partkey", "rank")


@query("""SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice - CASE WHEN p_size > 40 THEN 5 ELSE 0 END DESC, p_partkey) AS INTEGER) AS rank FROM part""")
def o1_ranked(spark, d):
    rows = table(spark, d, "part").withColumn("demoted", F.col("p_size") > 40)
    return selection.ranked(rows, ["p_brand"], "p_retailprice", ["p_partkey"], "demoted").select("p_partkey", "rank")


@query("""SELECT p_partkey, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 4 AS page, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 4 > 0 AS continuation FROM part""")
def o20_pages(spark, d):
    return selection.paginated(table(spark, d, "part"), ["p_brand"], ["p_partkey"]).select("p_partkey", "page", "continuation")


@query("""WITH k AS (SELECT DISTINCT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN 'ocr' ELSE 'frame' END AS kind FROM lineitem),
  c AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS a, count(*) FILTER (WHERE kind <> 'ocr') OVER (PARTITION BY l_orderkey) AS o,
    row_number() OVER (PARTITION BY l_orderkey, kind = 'ocr' ORDER BY l_linenumber) AS n FROM k)
  SELECT l_orderkey, l_linenumber, greatest(0, a - greatest(3, o)) AS omitted FROM c WHERE kind <> 'ocr' OR n <= 3 - o""")
def o21_capped_evidence(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "N", "ocr").otherwise("frame").alias("kind")).distinct()
    return selection.capped_evidence(rows, ["l_orderkey"], "kind", ["l_linenumber"], 3).select("l_orderkey", "l_linenumber", "omitted")


@query("""SELECT p_partkey, CASE WHEN p_size > 40 THEN 'meta' WHEN p_retailprice < 950 THEN 'low score' ELSE 'capacity' END AS reason FROM part
  WHERE p_partkey NOT IN (SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 2)""")
def o11_omissions(spark, d):
    part = table(spark, d, "part")
    chosen = selection.top(part, ["p_brand"], "p_retailprice", ["p_partkey"], 2)
    reasons = {"meta": F.col("p_size") > 40, "low score": F.col("p_retailprice") < 950}
    return selection.omissions(part, chosen, "p_partkey", reasons, "capacity").select("p_partkey", "reason")


@query("""WITH RECURSIVE c AS (SELECT p_partkey AS id FROM part WHERE p_size = 50 UNION SELECT (c.id // 3) FROM c WHERE c.id > 0) SELECT DISTINCT id FROM c""")
def o14_prerequisites(spark, d):
    part = table(spark, d, "part")
    edges = part.where("p_partkey > 0").select(F.col("p_partkey").alias("id"), F.expr("p_partkey div 3").alias("needs"))
    return selection.prerequisites_closed(part.where("p_size = 50").select(F.col("p_partkey").alias("id")), edges)


@query("""WITH RECURSIVE e AS (SELECT p_brand, p_partkey AS id, p_size, lag(p_partkey) OVER (PARTITION BY p_brand, p_partkey % 7 ORDER BY p_partkey) AS needs FROM part),
  g AS (SELECT p_brand, list({'id': id, 'needs': needs} ORDER BY p_size, id) AS items, count(*) AS n FROM e GROUP BY p_brand),
  walk AS (SELECT p_brand, items, n, CAST([] AS BIGINT[]) AS done, 0 AS k, CAST(NULL AS BIGINT) AS id FROM g
    UNION ALL SELECT p_brand, items, n, list_append(done, following), k + 1, following
    FROM (SELECT *, list_filter(items, lambda i: NOT list_contains(done, i.id) AND (i.needs IS NULL OR list_contains(done, i.needs)))[1].id AS following FROM walk WHERE k < n))
  SELECT p_brand, id, CAST(k - 1 AS INTEGER) AS position FROM walk WHERE k > 0""")
def o13_teaching_order(spark, d):
    part = table(spark, d, "part")
    rows = part.select("p_brand", F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("start"))
    # each needs the one before it of its remainder, and so all of those
    before = F.lag("id").over(Window.partitionBy("p_brand", F.pmod("id", F.lit(7))).orderBy("id"))
    edges = rows.select("p_brand", "id", before.alias("needs")).where("needs is not null")
    return selection.teaching_order(rows, "p_brand", edges)


@query("""WITH RECURSIVE best AS (SELECT l_suppkey, l_partkey AS unit, l_orderkey % 64 AS frame, max(l_quantity) AS score FROM lineitem GROUP BY ALL),
  wanted AS (SELECT l_suppkey, unit, list(frame ORDER BY score DESC, frame) AS frames, row_number() OVER (PARTITION BY l_suppkey ORDER BY unit) AS n FROM best GROUP BY l_suppkey, unit),
  walk AS (SELECT l_suppkey, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS unit, CAST(NULL AS BIGINT) AS frame, CAST([] AS BIGINT[]) AS used FROM (SELECT DISTINCT l_suppkey FROM lineitem)
    UNION ALL SELECT l_suppkey, n, unit, found, CASE WHEN found IS NULL THEN used ELSE list_append(used, found) END
    FROM (SELECT w.l_suppkey, x.n, x.unit, w.used, list_filter(x.frames, lambda f: NOT list_contains(w.used, f))[1] AS found FROM walk w JOIN wanted x ON x.l_suppkey = w.l_suppkey AND x.n = w.n + 1))
  SELECT l_suppkey, unit, frame FROM walk WHERE frame IS NOT NULL""")
def o15_assigned_frames(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", F.col("l_partkey").alias("unit"), (F.col("l_orderkey") % 64).alias("frame"), F.col("l_quantity").alias("score"))
    return selection.assign_without_reuse(rows.withColumn("order", F.col("unit")), "l_suppkey", "order")


@query("""SELECT p_partkey, round(0.35 + 0.25 * (p_size / 50.0) + 0.20 * least(1.0, (p_partkey % 5) / 3.0) + 0.20 - CASE WHEN p_size > 45 THEN 0.5 ELSE 0.0 END, 9) AS score FROM part""")
def p17_unit_score(spark, d):
    score = selection.unit_score(F.col("p_size") / 50.0, F.col("p_partkey") % 5, F.when(F.col("p_size") > 45, 0.5).otherwise(0.0))
    return table(spark, d, "part").select("p_partkey", F.round(score, 9).alias("score"))


# resolution


@query("""SELECT doc_id, substr(sha256(text), 1, 16) AS asset_id FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents WHERE text IS NOT NULL) WHERE n = 1""")
def d2_first_of_content(spark, d):
    return resolution.first_of_content(table(spark, d, "documents").where("text is not null"), "text", ["doc_id"]).select("doc_id", "asset_id")


@query("""WITH RECURSIVE sums AS (SELECT label, vec_id, list_transform(range(64), lambda k: list_reduce(list_prepend(CAST(0 AS DOUBLE), [CAST(embedding[i] AS DOUBLE) FOR i IN range(1, len(embedding) + 1) IF (i - 1) % 64 = k]), lambda a, x: a + x)) AS s FROM embeddings),
  bits AS (SELECT label, vec_id, list_reduce(list_prepend(CAST(0 AS HUGEINT), list_transform(s, lambda x: CAST(CASE WHEN x > 0 THEN 1 ELSE 0 END AS HUGEINT))), lambda a, x: a * 2 + x) AS b FROM sums),
  turns AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM bits),
  walk AS (SELECT label, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS vec_id, CAST(NULL AS BIGINT) AS leader, CAST([] AS STRUCT(o BIGINT, b HUGEINT)[]) AS leaders FROM (SELECT DISTINCT label FROM embeddings)
    UNION ALL SELECT label, n, vec_id, coalesce(near, vec_id), CASE WHEN near IS NULL THEN list_append(leaders, {'o': vec_id, 'b': b}) ELSE leaders END
    FROM (SELECT w.label, t.n, t.vec_id, t.b, w.leaders, list_filter(w.leaders, lambda l: bit_count(xor(l.b, t.b)) <= 24)[1].o AS near FROM walk w JOIN turns t ON t.label = w.label AND t.n = w.n + 1))
  SELECT label, vec_id, leader FROM walk WHERE vec_id IS NOT NULL""")
def d3_leaders(spark, d):
    # the signs of 64 sums, each of every 64th dimension
    sums = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.aggregate(F.filter("embedding", lambda _, i: i % 64 == k), F.lit(0.0), lambda acc, x: acc + x))
    bits = F.aggregate(sums, F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")))
    return resolution.leaders(table(spark, d, "embeddings").select("label", "vec_id", bits.alias("bits")), ["label"], "vec_id", "bits", 24)


@query("""WITH q AS (SELECT p_brand, p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'not ' || p_name ELSE p_name END AS t, p_type AS ql, p_partkey % 10 AS unit FROM part),
  k AS (SELECT *, regexp_replace(lower(regexp_replace(t, '\\bnot\\b', ' ', 'g')), '[^\\w]+', '', 'g') AS c, regexp_matches(t, '\\bnot\\b') AS neg FROM q)
  SELECT a.p_brand, least(a.p_partkey, b.p_partkey) AS left_id, greatest(a.p_partkey, b.p_partkey) AS right_id
  FROM k a JOIN k b ON a.p_brand = b.p_brand AND a.c = b.c AND a.ql = b.ql AND NOT a.neg AND b.neg AND a.unit <> b.unit""".replace("\\\\", "\\"))
def j17_conflicts(spark, d):
    rows = table(spark, d, "part").select("p_brand", F.col("p_partkey").alias("id"), (F.col("p_partkey") % 10).alias("unit_id"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("not "), F.col("p_name"))).otherwise(F.col("p_name")).alias("text"), F.array("p_type").alias("qualifiers"))
    return resolution.conflicting_claims(rows, ["p_brand"])


@query(f"""WITH {EV}, u AS (SELECT *, CAST(event_id AS VARCHAR) AS id FROM ev WHERE "start" < "end"),
  fresh AS (SELECT *, CASE WHEN "start" < max("end") OVER (PARTITION BY user_id, event_type ORDER BY "start", id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM u),
  named AS (SELECT *, sum(f) OVER (PARTITION BY user_id, event_type ORDER BY "start", id ROWS UNBOUNDED PRECEDING) AS g FROM fresh)
  SELECT user_id, arg_min(id, ("start", id)) AS id, string_agg(id, ',' ORDER BY "start", id) AS members, 'concept' AS kind, min("start") AS "start", max("end") AS "end", CAST(1 AS INTEGER) AS n_claims FROM named GROUP BY user_id, event_type, g""")
def r1_merged_units(spark, d):
    ev = events(spark, d).where("start < end")
    claims = F.array(F.struct(F.col("event_type").alias("text"), F.array(F.lit("q")).alias("qualifiers")))
    found = resolution.merge_units(ev.select("user_id", F.col("event_id").cast("string").alias("id"), F.lit("concept").alias("kind"), "start", "end", claims.alias("claims")), USER)
    return found.withColumn("members", F.array_join("members", ","))


@query("""WITH s AS (SELECT l_orderkey, list_distinct(list(l_suppkey)) AS a, list_distinct(list(l_partkey % 100)) AS b FROM lineitem GROUP BY l_orderkey)
  SELECT l_orderkey, round(len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE), 9) AS jaccard FROM s""")
def a17_jaccard(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("a"), F.collect_set(F.col("l_partkey") % 100).alias("b"))
    return rows.select("l_orderkey", F.round(resolution.jaccard(F.col("a"), F.col("b")), 9).alias("jaccard"))


# verification


@query("""SELECT o_orderpriority, string_agg(c, ',' ORDER BY c) AS codes FROM (SELECT o_orderpriority, o_orderstatus || '=' || count(*) AS c FROM orders GROUP BY o_orderpriority, o_orderstatus) GROUP BY o_orderpriority""")
def a1_counts_by_code(spark, d):
    return verification.counts_by(table(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus")


@query("""WITH c AS (SELECT l_orderkey, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS s, l_linestatus = 'O' AND l_returnflag = 'N' AS g FROM lineitem)
  SELECT l_orderkey, bool_or(g) AS grounded, count(*) AS n_checks, CASE WHEN min(s) = 0 THEN 'contradicted' WHEN min(s) = 1 THEN 'insufficient' WHEN bool_or(g) THEN 'supported' ELSE 'insufficient' END AS verdict FROM c GROUP BY l_orderkey""")
def a9_worst_verdict(spark, d):
    verdict = F.when(F.col("l_returnflag") == "R", "contradicted").when(F.col("l_returnflag") == "A", "insufficient").otherwise("supported")
    kind = F.when(F.col("l_linestatus") == "O", "grounding").otherwise("numbers")
    return verification.worst_verdict(table(spark, d, "lineitem").select("l_orderkey", kind.alias("kind"), verdict.alias("verdict")), ["l_orderkey"])


@query("""WITH p AS (SELECT conv_id, turn, regexp_extract_all(text, '\\d+(?:\\.\\d+)?') AS n, regexp_extract_all(coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), ''), '\\d+(?:\\.\\d+)?') AS e FROM conversations)
  SELECT conv_id, turn, CASE WHEN len(list_filter(n, lambda x: NOT list_contains(e, x))) = 0 THEN 'supported' WHEN len(e) > 0 THEN 'contradicted' ELSE 'insufficient' END AS verdict FROM p""".replace("\\\\", "\\"))
def v4_numbers(spark, d):
    rows = joins.neighbours(table(spark, d, "conversations"), ["conv_id"], ["turn"], "text")
    return rows.select("conv_id", "turn", verification.check_numbers(F.col("text"), F.coalesce("previous", F.lit(""))).alias("verdict"))


@query("""WITH f AS (SELECT l_orderkey AS k, l_linenumber AS id, min(epoch(l_shipdate)) AS t FROM lineitem GROUP BY ALL)
  SELECT a.k, a.id AS before_id, b.id AS after_id FROM f a JOIN f b ON a.k = b.k AND b.id = a.id + 1 WHERE a.t > b.t""")
def v5_step_order(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("id"), F.unix_timestamp("l_shipdate").alias("t"))
    edges = rows.select("k", F.col("id").alias("before_id"), (F.col("id") + 1).alias("after_id")).distinct()
    return verification.step_order_faults(edges, rows, ["k"]).select("k", "before_id", "after_id")


@query("""WITH s AS (SELECT l_orderkey, list_distinct(list(l_linenumber)) AS seen FROM lineitem GROUP BY l_orderkey),
  m AS (SELECT l_orderkey, unnest(generate_series(list_min(seen), list_max(seen))) AS x, seen FROM s)
  SELECT l_orderkey, string_agg(x, ',' ORDER BY x) AS missing FROM m WHERE NOT list_contains(seen, x) GROUP BY l_orderkey""")
def a22_missing_steps(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("step"))
    return verification.missing_steps(rows, ["l_orderkey"]).select("l_orderkey", F.array_join("missing", ",").alias("missing"))


@query("""WITH t AS (SELECT l_orderkey, bool_or(l_linestatus = 'F') AS body, bool_or(l_linestatus = 'O') AS summary FROM lineitem WHERE l_quantity > 20 GROUP BY 1)
  SELECT o_orderkey AS claim_id, CASE WHEN body THEN 'on_body' WHEN summary THEN 'on_summary' WHEN o_totalprice < 20000 OR o_orderpriority = '1-URGENT' THEN 'omitted' WHEN o_orderstatus <> 'F' THEN 'unsupported' ELSE 'missing' END AS status
  FROM orders LEFT JOIN t ON l_orderkey = o_orderkey""")
def j15_coverage(spark, d):
    orders, k = table(spark, d, "orders"), F.lit("s").alias("k")
    claims = orders.select(k, F.col("o_orderkey").alias("claim_id"), F.col("o_orderpriority").alias("topic_id"))
    pages = table(spark, d, "lineitem").where("l_quantity > 20").select(k, F.when(F.col("l_linestatus") == "F", "body").otherwise("summary").alias("page_type"), F.col("l_orderkey").alias("claim_id"))
    small = orders.where("o_totalprice < 20000").select(k, F.lit(None).cast("string").alias("topic_id"), F.col("o_orderkey").alias("claim_id"), F.lit("small").alias("reason"))
    urgent = orders.where("o_orderpriority = '1-URGENT'").select(k, F.col("o_orderpriority").alias("topic_id"), F.lit(None).cast("long").alias("claim_id"), F.lit("topic").alias("reason")).distinct()
    verdicts = orders.select(k, F.col("o_orderkey").alias("claim_id"), F.when(F.col("o_orderstatus") == "F", "supported").otherwise("insufficient").alias("verdict"))
    return verification.coverage_report(claims, pages, small.unionByName(urgent), verdicts, ["k"]).select("claim_id", "status")


@query("""SELECT p_partkey, unnest(list_filter([CASE WHEN NOT p_size BETWEEN 1 AND 45 THEN 'size' END, CASE WHEN NOT length(p_name) <= 12 THEN 'name' END], lambda x: x IS NOT NULL)) AS rule FROM part""")
def v1_constraint_faults(spark, d):
    return verification.constraint_faults(table(spark, d, "part"), ["p_partkey"], {"size": F.col("p_size").between(1, 45), "name": F.length("p_name") <= 12})


# text and JSON


@query("""SELECT doc_id, CAST(greatest(1, length(regexp_replace(text, '[^\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{3000}-\\x{303F}\\x{FF00}-\\x{FFEF}]', '', 'g')) + ceil(length(regexp_replace(text, '[\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{3000}-\\x{303F}\\x{FF00}-\\x{FFEF}]', '', 'g')) / 4.0)) AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL""".replace("\\\\", "\\"))
def p19_token_estimate(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


ANY_OF = lambda names: " OR ".join(f"contains(text, '{x}')" for x in names)


@query(rf"""SELECT conv_id, turn, regexp_matches(text, '(?i)(?:^|[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}])(?:(?:not|never|no)(?:$|[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}])|(?:can|do|does|did|is|are|was|were|will|would|should|could|have|has|had)n''t)') OR {ANY_OF(T.CJK_NEGATIONS)} AS negated,
  regexp_matches(text, '(?i)\d+(?:\.\d+)?\s*(?:cm|mm|kg|m/s|%)') OR {ANY_OF(T.UNIT_SIGNS)} AS has_units FROM conversations""")
def t3_negation_units(spark, d):
    rows = table(spark, d, "conversations")
    return rows.select("conv_id", "turn", T.has_negation(F.col("text")).alias("negated"), T.has_units(F.col("text")).alias("has_units"))


@query("""SELECT event_id, (event_id % 70) * 60.0 + (event_id % 60) + 0.25 AS seconds FROM events WHERE event_id % 70 < 60""")
def t6_timestamps(spark, d):
    stamp = F.format_string("%02d:%02d.250", F.col("event_id") % 70, F.col("event_id") % 60)
    return table(spark, d, "events").select("event_id", T.parse_timestamp(stamp).cast("decimal(25,2)").alias("seconds")).where("seconds is not null")


@query("""SELECT page_id, 'https://www.youtube.com/watch?v=abcdefghijk&t=' || page_id || 's' AS link FROM pages WHERE page_id % 3 < 2""")
def p20_seek_links(spark, d):
    url = F.when(F.col("page_id") % 3 == 0, "https://youtu.be/abcdefghijk?si=x").when(F.col("page_id") % 3 == 1, "https://m.youtube.com/watch?x=1&v=abcdefghijk").otherwise("https://www.youtube.com/watch?v=abcdefghijk&list=p")
    return table(spark, d, "pages").select("page_id", T.seek_link(url, F.col("page_id") + 0.7).alias("link")).where("link is not null")


@query("""SELECT p_partkey, substr(sha256(p_name || chr(0) || p_brand), 1, 32) AS digest, sha256('plan' || chr(0) || p_type) AS cache_key FROM part""")
def t32_digests(spark, d):
    return table(spark, d, "part").select("p_partkey", T.digest(F.col("p_name"), F.col("p_brand")).alias("digest"), budget.cache_key(F.lit("plan"), F.col("p_type")).alias("cache_key"))


@query("""SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1)) AS host, CASE WHEN regexp_matches(url, '[.?]pdf') THEN 'pdf' ELSE 'page' END AS kind FROM pages""")
def s19_url_parts(spark, d):
    return table(spark, d, "pages").select("page_id", F.lower(F.regexp_extract("url", r"^[a-z]+://([^/:?#]*)", 1)).alias("host"), F.when(F.col("url").rlike("[.?]pdf"), "pdf").otherwise("page").alias("kind"))


@query("""SELECT event_id, CAST(props->>'$.k' AS DOUBLE) AS k_seconds, props->>'$.k' AS k_id FROM events""")
def c3_coerced_json(spark, d):
    return table(spark, d, "events").select("event_id", coerce.seconds(F.col("props"), "k").alias("k_seconds"), coerce.identifier(F.col("props"), "k").alias("k_id"))


@query("""SELECT conv_id, turn, CASE WHEN lower(text) LIKE '%unreadable%' OR lower(text) LIKE '%ocr%' THEN 'unreadable_text' WHEN lower(text) LIKE '%step%' THEN 'missing_step' ELSE 'audio_visual_conflict' END AS kind FROM conversations""")
def t30_request_kind(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.request_kind(F.col("text")).alias("kind"))


# budgets, resuming, evaluation


@query("""WITH r AS (SELECT o_orderkey, o_custkey, count(*) OVER w AS total_calls, round(sum(o_totalprice) OVER w, 2) AS total_cost FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)),
  b AS (SELECT *, CASE WHEN total_calls > 12 THEN 'calls' WHEN total_cost > 2000000 THEN 'cost' END AS breach FROM r)
  SELECT b.o_orderkey, total_calls, total_cost, breach, EXISTS (SELECT 1 FROM b c WHERE c.o_custkey = b.o_custkey AND c.total_calls <= b.total_calls AND c.breach IS NOT NULL) AS paused FROM b""")
def b1_budget_replay(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.lit(1).alias("calls"), F.col("o_totalprice").alias("cost"))
    found = budget.replay(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], {"calls": 12, "cost": 2_000_000})
    return found.select("o_orderkey", "total_calls", F.round("total_cost", 2).alias("total_cost"), "breach", "paused")


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_id % 30 + 0.5 ELSE least(8.0, 0.25 * pow(2.0, event_id % 9)) END AS delay FROM events""")
def b2_retry_delay(spark, d):
    return table(spark, d, "events").select("event_id", budget.retry_delay(F.col("event_id") % 9 + 1, F.when(F.col("event_id") % 4 == 0, F.col("event_id") % 30 + 0.5).cast("double")).alias("delay"))


@query("""SELECT arg_min(event_id, event_id) AS event_id, min(event_type) <> max(event_type) AS conflict FROM events GROUP BY user_id, floor(value)""")
def b4_idempotent(spark, d):
    rows = table(spark, d, "events").withColumn("request", F.floor("value"))
    return budget.idempotent(rows, ["user_id", "request"], ["event_id"], "event_type").select("event_id", "conflict")


@query("""WITH RECURSIVE down AS (SELECT p_partkey FROM part WHERE p_size = 50 UNION SELECT p.p_partkey FROM down JOIN part p ON p.p_partkey // 2 = down.p_partkey AND p.p_partkey > 1)
  SELECT p_partkey AS stage FROM down""")
def b6_invalidated(spark, d):
    part = table(spark, d, "part")
    edges = part.where("p_partkey > 1").select(F.expr("p_partkey div 2").alias("stage"), F.col("p_partkey").alias("next"))
    return budget.invalidated(edges, part.where("p_size = 50").select(F.col("p_partkey").alias("stage")))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND c_mktsegment IS NOT NULL THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment, c_nationkey, c_custkey % 2 = 0 AS changed FROM customer""")
def b8_resumed(spark, d):
    customer = table(spark, d, "customer")
    given = customer.where("c_custkey % 2 = 0").select("c_custkey", F.lit("NEW").alias("c_mktsegment"), F.lit(None).cast("int").alias("c_nationkey"))
    return budget.resumed(customer, given, "c_custkey", ["c_mktsegment", "c_nationkey"])


@query("""SELECT lang, count(*) AS n, round(avg(quality), 9) AS mean_quality, sum(toxic) AS sum_toxic FROM labels JOIN documents USING (doc_id) GROUP BY lang""")
def a4_scorecard(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return budget.scorecard(rows, ["lang"], ["quality"], ["toxic"]).withColumn("mean_quality", F.round("mean_quality", 9))


@query("""SELECT doc_id, (quality + toxic) / 2.0 AS score, greatest(quality, toxic) AS images, 1 - abs(quality - toxic) * 1.0 AS agreement FROM labels""")
def a6_merged_raters(spark, d):
    labels = table(spark, d, "labels")
    one = lambda r, c: labels.select("doc_id", F.lit(r).alias("rater"), F.col(c).cast("double").alias("score"), F.col(c).alias("images"))
    return budget.merged_raters(one("a", "quality").unionByName(one("b", "toxic")), ["doc_id"], ["score"], ["images"], ["score"]).withColumn("agreement", F.col("agreement").cast("decimal(12,1)"))


# streaming forms over the table


@query("""WITH o AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events),
  s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM o)
  SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, g""")
def st1_session_totals(spark, d):
    return live.session_totals(table(spark, d, "events")).select("user_id", "n", F.round("total", 4).alias("total"))

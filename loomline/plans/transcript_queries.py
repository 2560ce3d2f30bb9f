"""Transcripts bound to the harness tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import transcripts
from .queries import EV, USER, events, query, timelines

#: Seconds of a recording: shorter than the events' time, so that some are cut.
CUT = 20 * 86400.0

RECOGNISED = f"""{EV}, seg AS (SELECT user_id, event_id AS id, "start", "end", ("end" - "start") / 4 AS q FROM ev WHERE event_id % 3 <> 0),
  w AS (SELECT user_id, id, "start", "end", [{{'word': 'w' || k, 's': "start" + k * q - id % 5, 'e': "start" + (k + 1) * q + id % 3}} FOR k IN range(4)] AS words FROM seg),
  clipped AS (SELECT user_id, id, "start", least("end", {CUT}) AS "end",
      list_filter(list_transform(words, lambda x: {{'word': x.word, 's': greatest("start", x.s), 'e': least(least("end", {CUT}), x.e)}}), lambda x: x.s < x.e) AS words,
      len(list_filter(words, lambda x: x.s < "start" OR x.e > least("end", {CUT}) OR NOT greatest("start", x.s) < least(least("end", {CUT}), x.e))) > 0 AS cut
    FROM w WHERE "start" < least("end", {CUT}))"""


def recognised(spark, d):
    quarter = (F.col("end") - F.col("start")) / 4
    word = lambda k: F.struct(F.lit(f"w{k}").alias("word"), (F.col("start") + k * quarter - F.col("id") % 5).alias("start"), (F.col("start") + (k + 1) * quarter + F.col("id") % 3).alias("end"))
    rows = events(spark, d).where("event_id % 3 <> 0").select("user_id", F.col("event_id").alias("id"), "start", "end")
    return transcripts.clip_recognised(rows.withColumn("words", F.array(*map(word, range(4)))), recordings(spark, d), USER)


def recordings(spark, d):
    return timelines(spark, d).select("user_id", F.lit(CUT).alias("duration"))


@query(f"""WITH {RECOGNISED} SELECT user_id, id, "end", cut, CAST(len(words) AS INTEGER) AS n_words, coalesce(list_aggregate(list_transform(words, lambda x: x.word), 'string_agg', ','), '') AS words,
  round(coalesce(list_sum(list_transform(words, lambda x: x.e - x.s)), 0), 6) AS word_seconds FROM clipped""")
def i9_clipped_words(spark, d):
    seconds = F.aggregate("words", F.lit(0.0), lambda a, x: a + x["end"] - x["start"])
    return recognised(spark, d).select("user_id", "id", "end", "cut", F.size("words").alias("n_words"), F.array_join(F.transform("words", lambda x: x["word"]), ",").alias("words"), F.round(seconds, 6).alias("word_seconds"))


@query(f"""WITH {RECOGNISED}, fresh AS (SELECT *, CASE WHEN "start" > max("end") OVER (PARTITION BY user_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS f FROM clipped),
  isl AS (SELECT user_id, min("start") AS s, max("end") AS e FROM (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS g FROM fresh) GROUP BY user_id, g),
  edge AS (SELECT user_id, coalesce(lag(e) OVER (PARTITION BY user_id ORDER BY s), 0) AS "start", s AS "end" FROM isl
    UNION ALL SELECT user_id, max(e), {CUT} FROM isl GROUP BY user_id
    UNION ALL SELECT DISTINCT user_id, 0, {CUT} FROM events WHERE user_id NOT IN (SELECT user_id FROM isl))
  SELECT user_id, CAST("start" AS DOUBLE) AS "start", CAST("end" AS DOUBLE) AS "end" FROM edge WHERE "start" < "end" """)
def i9_unrecognised(spark, d):
    return transcripts.recognised_coverage(recognised(spark, d), recordings(spark, d), USER)[1].select("user_id", "start", "end")


HEARD = f"""{EV}, cap AS (SELECT user_id, event_id AS id, "start", "end", event_type || ' ' || coalesce(lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id), '') AS text FROM ev),
  shown AS (SELECT user_id, event_id AS ord, "start" AS t, CASE WHEN event_id % 2 = 0 THEN 'BUY' ELSE 'SEE' END AS canonical FROM ev WHERE event_id % 5 = 0),
  near AS (SELECT cap.user_id, cap.id, cap.text, max(canonical = 'BUY') AS buy, max(canonical = 'SEE') AS see FROM cap JOIN shown ON cap.user_id = shown.user_id AND cap."start" < cap."end"
      AND cap."end" > t - 1800 AND cap."start" < t + 1800 GROUP BY ALL),
  done AS (SELECT *, CASE WHEN buy THEN replace(replace(text, 'purchase', 'BUY'), 'add', 'BUY') ELSE text END AS one FROM near)"""


@query(f"""WITH {HEARD}, both_ AS (SELECT *, CASE WHEN see THEN replace(replace(replace(one, 'view', 'SEE'), 'click', 'SEE'), 'iew', 'SEE') ELSE one END AS two FROM done)
  SELECT user_id, id, text AS before, two AS text FROM both_ WHERE two <> text""")
def j9_corrected_captions(spark, d):
    following = F.coalesce(F.lead("event_type").over(Window.partitionBy("user_id").orderBy("event_id")), F.lit(""))
    rows = events(spark, d).select("user_id", F.col("event_id").alias("id"), "start", "end", F.concat_ws(" ", "event_type", following).alias("text"))
    shown = events(spark, d).where("event_id % 5 = 0").select("user_id", F.col("event_id").alias("ord"), F.when(F.col("event_id") % 2 == 0, "BUY").otherwise("SEE").alias("canonical"), F.col("start").alias("center"))
    rules = spark.createDataFrame([("BUY", ["add", "purchase"]), ("SEE", ["iew", "view", "click"])], "canonical string, variants array<string>")
    return transcripts.correct_by_headwords(rows, shown, rules, USER, window=3600.0).select("user_id", "id", "before", "text")

"""Review logs bound to the harness tables: a user's captions are pages, every third event is an edit of one of them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import review
from .queries import query, table

REPLAYED = """RECURSIVE pg AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS ordinal, event_type AS title FROM events WHERE event_id % 3 <> 0),
  st AS (SELECT user_id, list({'id': 'p' || event_id, 'ordinal': ordinal, 'title': title, 'locked': event_id % 17 = 0, 'frames': '', 'allowed': 'f' || event_id} ORDER BY event_id) AS pages FROM pg GROUP BY user_id),
  dg AS (SELECT user_id, pages, CAST(list_sum(list_transform(pages, lambda p: CAST('0x' || substr(md5(p.id || '|' || p.ordinal || '|' || p.title || '||' || p.locked || '|' || p.frames), 1, 12) AS BIGINT))) AS VARCHAR) AS digest FROM st),
  ed AS (SELECT user_id, event_id AS edit, row_number() OVER o AS n, (row_number() OVER o - 1) // 2 AS named, target, ['lock', 'edit_copy', 'delete', 'pick_asset', 'merge'][event_id // 3 % 5 + 1] AS op,
      CASE WHEN event_id % 2 = 0 THEN 'f' || target ELSE 'f0' END AS frame, CASE WHEN event_id % 4 = 0 THEN digest END AS base
    FROM (SELECT user_id, event_id, max(CASE WHEN event_id % 3 <> 0 THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS target FROM events) LEFT JOIN dg USING (user_id)
    WHERE event_id % 3 = 0 WINDOW o AS (PARTITION BY user_id ORDER BY event_id)),
  walk AS (
    SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS edit, CAST(0 AS BIGINT) AS revision, CAST(NULL AS VARCHAR) AS reason, pages FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN st USING (user_id)
    UNION ALL
    SELECT user_id, n, edit, revision + CASE WHEN reason IS NULL THEN 1 ELSE 0 END, reason,
      CASE WHEN reason IS NOT NULL THEN pages WHEN op = 'delete' THEN list_filter(pages, lambda p: p.id <> page.id)
        ELSE list_transform(pages, lambda p: CASE WHEN p.id <> page.id THEN p ELSE {'id': p.id, 'ordinal': p.ordinal, 'title': CASE WHEN op = 'edit_copy' THEN 'new-' || edit ELSE p.title END,
          'locked': p.locked OR op = 'lock', 'frames': CASE WHEN op = 'pick_asset' THEN frame ELSE p.frames END, 'allowed': p.allowed} END) END
    FROM (SELECT *, CASE WHEN named <> revision THEN 'stale revision'
          WHEN base IS NOT NULL AND base <> CAST(list_sum(list_transform(pages, lambda p: CAST('0x' || substr(md5(p.id || '|' || p.ordinal || '|' || p.title || '||' || p.locked || '|' || p.frames), 1, 12) AS BIGINT))) AS VARCHAR) THEN 'stale digest'
          WHEN op = 'merge' THEN 'op not allowed' WHEN page IS NULL THEN 'unknown page' WHEN page.locked AND op <> 'lock' THEN 'page is locked'
          WHEN op = 'pick_asset' AND frame <> page.allowed THEN 'frames not allowed' WHEN op = 'delete' AND len(pages) = 1 THEN 'last page' END AS reason
      FROM (SELECT w.user_id, e.n, e.edit, w.revision, w.pages, e.named, e.op, e.frame, e.base, list_filter(w.pages, lambda p: p.id = 'p' || e.target)[1] AS page
        FROM walk w JOIN ed e ON e.user_id = w.user_id AND e.n = w.n + 1)))"""


def pages(spark, d):
    e, user = F.col("event_id"), Window.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, d, "events").where("event_id % 3 <> 0")
    none = F.array().cast("array<string>")
    name = lambda x: F.concat(F.lit(x), e.cast("string"))
    return rows.select(F.col("user_id").cast("string").alias("doc"), name("p").alias("page_id"), F.row_number().over(user).cast("long").alias("ordinal"), F.col("event_type").alias("title"), F.lit(None).cast("string").alias("notes"), (e % 17 == 0).alias("locked"), none.alias("frames"), F.array(name("f")).alias("allowed"), F.array(name("c")).alias("claims"))


def edits(spark, d):
    e, user = F.col("event_id"), Window.partitionBy("user_id").orderBy("event_id")
    target = F.max(F.when(e % 3 != 0, e)).over(user).cast("string")
    rows = table(spark, d, "events").select("user_id", "event_id", target.alias("target")).where("event_id % 3 = 0")
    rows = rows.withColumn("n", F.row_number().over(user) - 1).withColumn("doc", F.col("user_id").cast("string"))
    rows = rows.join(review.digests(pages(spark, d)), "doc", "left")
    op = F.element_at(F.array(*map(F.lit, ("lock", "edit_copy", "delete", "pick_asset", "merge"))), (F.floor(e / 3) % 5 + 1).cast("int"))
    frame = F.concat(F.lit("f"), F.when(e % 2 == 0, F.col("target")).otherwise("0"))
    return rows.select("doc", e.alias("edit"), F.floor(F.col("n") / 2).alias("revision"), F.when(e % 4 == 0, F.col("digest")).alias("base"), F.lit(0).cast("long").alias("op_no"), op.alias("op"), F.concat(F.lit("p"), "target").alias("page_id"), F.concat(F.lit("new-"), e.cast("string")).alias("title"), F.lit(None).cast("string").alias("notes"), F.array(frame).alias("frames"), F.lit(None).cast("array<string>").alias("page_order"))


@query(f"WITH {REPLAYED} SELECT CAST(user_id AS VARCHAR) AS doc, edit, reason IS NULL AS accepted, reason, revision FROM walk WHERE edit IS NOT NULL")
def v13_review_decisions(spark, d):
    return review.replay(pages(spark, d), edits(spark, d))[0]


@query(f"""WITH {REPLAYED}, fin AS (SELECT user_id, unnest(pages) AS p FROM walk QUALIFY n = max(n) OVER (PARTITION BY user_id))
  SELECT CAST(user_id AS VARCHAR) AS doc, p.id AS page_id, p.ordinal, p.title, p.locked, p.frames FROM fin""")
def v13_reviewed_pages(spark, d):
    return review.replay(pages(spark, d), edits(spark, d))[1].select("doc", "page_id", "ordinal", "title", "locked", F.array_join("frames", ",").alias("frames"))


@query(f"""WITH {REPLAYED}, del AS (SELECT w.user_id, w.edit, ed.target FROM walk w JOIN ed USING (user_id, edit) WHERE w.reason IS NULL AND ed.op = 'delete')
  SELECT CAST(user_id AS VARCHAR) AS doc, edit, 'p' || target AS page_id, CAST(NULL AS VARCHAR) AS claim FROM del
  UNION ALL SELECT CAST(user_id AS VARCHAR), edit, 'p' || target, 'c' || target FROM del""")
def v13_review_omissions(spark, d):
    return review.replay(pages(spark, d), edits(spark, d))[2]

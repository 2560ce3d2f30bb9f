"""Payloads of six shapes made from the parts, read back as topics and units."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import joins, payloads
from ..sources import assets
from .queries import query, table


def shaped(spark, d, shapes):
    """The k-th of the shapes (format strings over key, name, size) for the parts whose key is k modulo their number."""
    rows = table(spark, d, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("key"), "p_name", F.col("p_size").cast("string").alias("size"))
    texts = [F.replace(F.replace(F.replace(F.lit(x), F.lit("@key"), F.col("key")), F.lit("@name"), F.col("p_name")), F.lit("@size"), F.col("size")) for x in shapes]
    payload = F.element_at(F.array(*texts), (F.col("p_partkey") % len(shapes) + 1).cast("int"))
    return rows.select("p_partkey", "key", payload.alias("payload"))


TOPICS = [
    '{"topics": [{"title": " @name ", "goal": "learn @size", "start": @size, "end_seconds": "1@size.5", "evidence": ["e1", {"id": 7}, true]}]}',
    '[{"name": "@name", "objective": "o", "range": [@size, 1000], "id": @key, "speculative": false}, {"name": "again", "objective": "o", "span": {"begin": "2"}}]',
    '{"outline": null, "topics_": []}',
    '{"topics": [',
    '{"sections": [{"title": "@name"}, "x", {"heading": "", "goal": "g"}]}',
    '{"topics": [{"heading": "@name", "purpose": "p", "end": -1, "start": true}, {"title": "t", "goal": "g", "start": 500, "end": 3}]}',
]


@query("""WITH p AS (SELECT p_partkey, p_name, p_size, p_partkey % 6 AS k FROM part)
  SELECT p_partkey, 1 AS n, 'topic-' || p_partkey || '-01' AS id, p_name AS title, 'learn ' || p_size AS goal, CAST(p_size AS DOUBLE) AS "start", CAST('1' || p_size || '.5' AS DOUBLE) AS "end", 'e1,7' AS evidence, CAST(NULL AS BOOLEAN) AS speculative, CAST(NULL AS VARCHAR) AS reason FROM p WHERE k = 0
  UNION ALL SELECT p_partkey, 1, CAST(p_partkey AS VARCHAR), p_name, 'o', p_size, 1000, '', false, NULL FROM p WHERE k = 1
  UNION ALL SELECT p_partkey, 2, 'topic-' || p_partkey || '-02', 'again', 'o', 2, 400, '', true, NULL FROM p WHERE k = 1
  UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE k WHEN 2 THEN 'no list' ELSE 'not json' END FROM p WHERE k IN (2, 3)
  UNION ALL SELECT p_partkey, n, NULL, NULL, NULL, NULL, NULL, NULL, NULL, ['no goal', 'not an object', 'no title'][n] FROM p, (SELECT unnest([1, 2, 3]) AS n) WHERE k = 4
  UNION ALL SELECT p_partkey, 1, 'topic-' || p_partkey || '-01', p_name, 'p', 1, 400, '', true, NULL FROM p WHERE k = 5
  UNION ALL SELECT p_partkey, 2, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'no time' FROM p WHERE k = 5""")
def c7_topics(spark, d):
    rows = shaped(spark, d, TOPICS).select("p_partkey", "payload", F.col("key").alias("block_id"), F.lit(1.0).alias("block_start"), F.lit(400.0).alias("block_end"))
    taken, refused = payloads.topics(rows, ["p_partkey"])
    return taken.withColumn("evidence", F.array_join("evidence_ids", ",")).drop("evidence_ids").unionByName(refused, allowMissingColumns=True)


CLAIM = '{"text": " @name ", "sources": "e@size"}'
UNITS = [
    f'{{"units": [{{"kind": " Steps ", "claims": [{CLAIM}, {{"claim": "no evidence"}}, {CLAIM}], "start": 1, "end": 2}}]}}',
    f'{{"knowledgeUnits": {{"b": {{"id": "B", "claims": [{CLAIM}], "type": "recap"}}, "a": {{"claims": [{{"id": "x", "statement": "s", "evidence_ids": [1], "status": "SUPPORTED"}}, {{"id": "x", "content": "t", "citations": ["e"]}}]}}}}}}',
    f'{{"claims": [{CLAIM}], "topicId": "own", "segment_ids": ["s1", "s2"]}}',
    '{"items": {"a": 1}}',
    '{"units": [{"claims": []}, {"claims": 5}, [], {"kind": "fact", "end": 0, "claims": []}]}',
    f'{{"units": [{{"claims": [{CLAIM}], "topic_id": true}}]}}',
]


@query("""WITH p AS (SELECT p_partkey, p_name, 'e' || p_size AS e, p_partkey % 6 AS k FROM part)
  SELECT p_partkey, 1 AS n, 'unit-s' || p_partkey || '-01' AS id, 'T' AS topic_id, 's' || p_partkey AS segments, CAST(1 AS DOUBLE) AS "start", CAST(2 AS DOUBLE) AS "end", 'procedure' AS kind,
    'unit-s' || p_partkey || '-01-c01:' || p_name || ':' || e || ':draft;unit-s' || p_partkey || '-01-c03:' || p_name || ':' || e || ':draft' AS claims, CAST(NULL AS VARCHAR) AS reason FROM p WHERE k = 0
  UNION ALL SELECT p_partkey, 1, 'unit-s' || p_partkey || '-01', 'T', 's' || p_partkey, 0, 9, 'concept', 'x:s:1:supported;x-2:t:e:draft', NULL FROM p WHERE k = 1
  UNION ALL SELECT p_partkey, 2, 'B', 'T', 's' || p_partkey, 0, 9, 'recap', 'B-c01:' || p_name || ':' || e || ':draft', NULL FROM p WHERE k = 1
  UNION ALL SELECT p_partkey, 1, 'unit-s' || p_partkey || '-01', 'own', 's1,s2', 0, 9, 'concept', 'unit-s' || p_partkey || '-01-c01:' || p_name || ':' || e || ':draft', NULL FROM p WHERE k = 2
  UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'no list' FROM p WHERE k = 3
  UNION ALL SELECT p_partkey, n, NULL, NULL, NULL, NULL, NULL, NULL, NULL, ['no usable claim', 'no claims', 'not an object', 'no time'][n] FROM p, (SELECT unnest([1, 2, 3, 4]) AS n) WHERE k = 4
  UNION ALL SELECT p_partkey, 1, 'unit-s' || p_partkey || '-01', 'T', 's' || p_partkey, 0, 9, 'concept', 'unit-s' || p_partkey || '-01-c01:' || p_name || ':' || e || ':draft', NULL FROM p WHERE k = 5""")
def c8_units(spark, d):
    rows = shaped(spark, d, UNITS).select("p_partkey", "payload", F.concat(F.lit("s"), "key").alias("segment_id"), F.lit("T").alias("topic_id"), F.lit(0.0).alias("context_start"), F.lit(9.0).alias("context_end"))
    taken, refused = payloads.units(rows, ["p_partkey"])
    claims = F.array_join(F.transform("claims", lambda c: F.concat_ws(":", c["id"], c["text"], F.array_join(c["evidence_ids"], ","), c["status"])), ";")
    taken = taken.select("p_partkey", "n", "id", "topic_id", F.array_join("segment_ids", ",").alias("segments"), "start", "end", "kind", claims.alias("claims"))
    return taken.unionByName(refused, allowMissingColumns=True)


@query("""SELECT event_id, sha256('{"a":{"b":null,"y":[' || event_id || ',2.5,"é \\"x\\""]},"k":' || json_extract_string(props, '$.k') || ',"z":"' || event_type || '"}') AS digest FROM events""".replace("\\\\", "\\"))
def t32_canonical_digests(spark, d):
    k, e = F.get_json_object("props", "$.k"), F.col("event_id").cast("string")
    document = F.concat(F.lit('{ "z" : "'), "event_type", F.lit('",\n "k": '), k, F.lit(', "a": {"y": [ '), e, F.lit(', 2.5, "é \\"x\\""], "b": null} }'))
    return table(spark, d, "events").select("event_id", T.canonical_digest(document).alias("digest"))


@query("""WITH l AS (SELECT l_orderkey, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linestatus END AS status, CASE WHEN l_quantity > 45 THEN 'other' ELSE CAST(l_orderkey % 9 AS VARCHAR) END AS source FROM lineitem),
  o AS (SELECT o_orderkey, o_orderstatus, CAST(o_orderkey % 9 AS VARCHAR) AS source FROM orders WHERE o_orderkey % 11 <> 0)
  SELECT 'order' AS rule, CAST(l_orderkey AS VARCHAR) AS reference, 'status' AS field, count(*) AS n FROM l JOIN o ON l_orderkey = o_orderkey WHERE status IS DISTINCT FROM o_orderstatus GROUP BY l_orderkey
  UNION ALL SELECT 'order', CAST(l_orderkey AS VARCHAR), 'source', count(*) FROM l JOIN o ON l_orderkey = o_orderkey WHERE l.source IS DISTINCT FROM o.source GROUP BY l_orderkey""")
def j13_unequal_references(spark, d):
    key = lambda c: (F.col(c) % 9).cast("string")
    lines = table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") != 7, F.col("l_linestatus")).alias("status"), F.when(F.col("l_quantity") > 45, "other").otherwise(key("l_orderkey")).alias("source"))
    orders = table(spark, d, "orders").where("o_orderkey % 11 <> 0").select("o_orderkey", "o_orderstatus", key("o_orderkey").alias("source"))
    return joins.unequal_references({"order": (lines, "l_orderkey", orders, "o_orderkey", {"status": "o_orderstatus", "source": "source"})})


@query("""WITH f AS (SELECT doc_id, ['a/', 'b/', '../', '/'][CASE WHEN doc_id % 13 < 11 THEN doc_id % 2 + 1 ELSE doc_id % 13 - 8 END] || doc_id || ['.png', '.JPG', '.gif', '.bin'][doc_id % 4 + 1] AS path,
    CASE WHEN doc_id % 5 = 0 THEN unhex('00') WHEN doc_id % 4 = 0 THEN unhex('89504E470D0A1A0A') ELSE unhex('FFD8FF') END || encode(coalesce(text, '')) AS content FROM documents),
  c AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN 'wrong' ELSE sha256(content) END AS sha256, ['image/png', 'image/jpg', NULL, 'image/gif', 'image/jpeg'][doc_id % 5 + 1] AS mime_type FROM f)
  SELECT doc_id, fault FROM (SELECT doc_id, CASE WHEN doc_id % 13 >= 11 THEN 'outside of the root' WHEN doc_id % 6 = 5 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'hash' WHEN mime_type IS NULL THEN NULL
    WHEN doc_id % 4 < 2 AND doc_id % 5 = 0 THEN 'type' WHEN doc_id % 4 < 3 AND ['image/png', 'image/jpeg', 'image/gif'][doc_id % 4 + 1] <> CASE mime_type WHEN 'image/jpg' THEN 'image/jpeg' ELSE mime_type END THEN 'type' END AS fault FROM c)
  WHERE fault IS NOT NULL""")
def v14_asset_faults(spark, d):
    i = F.col("doc_id")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), at.cast("int"))
    folder = pick(("a/", "b/", "../", "/"), F.when(i % 13 < 11, i % 2 + 1).otherwise(i % 13 - 8))
    start = F.when(i % 5 == 0, "00").when(i % 4 == 0, "89504E470D0A1A0A").otherwise("FFD8FF")
    rows = table(spark, d, "documents").select("doc_id", F.concat(folder, i.cast("string"), pick((".png", ".JPG", ".gif", ".bin"), i % 4 + 1)).alias("path"), F.concat(F.unhex(start), F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("content"))
    claimed = rows.select("doc_id", "path", F.when(i % 7 == 0, "wrong").otherwise(F.sha2("content", 256)).alias("sha256"), pick(("image/png", "image/jpg", None, "image/gif", "image/jpeg"), i % 5 + 1).alias("mime_type"))
    return assets.asset_faults(claimed, assets.described(rows.where("doc_id % 6 <> 5").select("path", "content"))).select("doc_id", "fault")

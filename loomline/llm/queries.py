"""One query for each operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, fingerprints, html_extract, language, line_dedup, media, mixing, near_dedup, pieces, prefix_trie, storage, suffix_dedup, token_files, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = storage.materialize(media.media_columns(table(spark, sf_dir, "documents")), "media", compression="zstd")
    return media.describe_media(stored)


#: Target weights of the documents' tree; a source's domain is the last character of its name.
MIX_WEIGHTS = {"domain": {"0": 3, "1": 2, "*": 1}, "language": {"en": 10, "fr": 4, "de": 4, "es": 2, "*": 1}, "source": {"*": 1}}


def mix_levels() -> dict:
    return {"domain": F.right("source", F.lit(1)), "language": F.col("lang"), "source": F.col("source")}


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the texts are read once, to count their tokens
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", mixing.count_tokens(F.col("text")).alias("n"))
    docs = storage.materialize(docs, "counted")
    return mixing.mix(docs, mix_levels(), MIX_WEIGHTS, tokens=F.col("n")).select("row.doc_id", "domain", "language", "source", "epoch", "n_tokens", "take_tokens")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), with_ids=False)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.identify(docs)
    return found.select("row.doc_id", language.held_out_of(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=2, similarity_percent=80)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), window=400, stored=False)
    kept = F.col("n_bytes") - F.col("n_removed")
    return found.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", kept.alias("n_kept"), (F.col("n_removed") > 0).alias("has_repeats"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), with_ids=False)


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.aligned_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return found.select("row.doc_id", "held_out", "score", "predicted")


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_media_columns": op2_media_columns,
    "op3_mixing": op3_mixing,
    "op4_token_files": op4_token_files,
    "op5_language_id": op5_language_id,
    "op6_near_dedup": op6_near_dedup,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_pieces": op8_pieces,
    "op9_html_extract": op9_html_extract,
    "op10_fingerprints": op10_fingerprints,
    "op11_token_alignment": op11_token_alignment,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_toxicity": op13_toxicity,
}

SQL = {
    "op1_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, line, pos,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
common AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT keyed.doc_id, count(*) AS n_lines, count(common.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE common.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common ON keyed.k = common.k
GROUP BY keyed.doc_id
""",
    "op3_mixing": r"""
WITH docs AS (
  SELECT doc_id, coalesce(right(source, 1), '') AS domain, coalesce(lang, '') AS language, coalesce(source, '') AS source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens
  FROM documents),
rows AS (SELECT * FROM docs WHERE n_tokens > 0),
leaves AS (SELECT domain, language, source, CAST(sum(n_tokens) AS HUGEINT) AS tokens FROM rows GROUP BY ALL),
d0 AS (
  SELECT domain, sum(tokens) * 2 AS capacity,
         CAST(CASE domain WHEN '0' THEN 3 WHEN '1' THEN 2 ELSE 1 END AS HUGEINT) AS w,
         (SELECT sum(tokens) * 60 // 100 FROM leaves) AS given
  FROM leaves GROUP BY domain),
d1 AS (
  SELECT *, coalesce(sum(capacity) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
         sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
  FROM d0 WINDOW o AS (ORDER BY CAST(capacity AS DOUBLE) / CAST(w AS DOUBLE), domain)),
d2 AS (SELECT *, capacity * weight_left <= (given - full_before) * w AS is_full FROM d1),
d3 AS (
  SELECT domain, CASE WHEN is_full THEN capacity
    ELSE (given - coalesce(sum(capacity) FILTER (WHERE is_full) OVER (), 0)) * w // sum(w) FILTER (WHERE NOT is_full) OVER () END AS budget
  FROM d2),
l0 AS (
  SELECT domain, language, sum(tokens) * 2 AS capacity,
         CAST(CASE language WHEN 'en' THEN 10 WHEN 'fr' THEN 4 WHEN 'de' THEN 4 WHEN 'es' THEN 2 ELSE 1 END AS HUGEINT) AS w,
         any_value(budget) AS given
  FROM leaves JOIN d3 USING (domain) GROUP BY domain, language),
l1 AS (
  SELECT *, coalesce(sum(capacity) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
         sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
  FROM l0 WINDOW o AS (PARTITION BY domain ORDER BY CAST(capacity AS DOUBLE) / CAST(w AS DOUBLE), language)),
l2 AS (SELECT *, capacity * weight_left <= (given - full_before) * w AS is_full FROM l1),
l3 AS (
  SELECT domain, language, CASE WHEN is_full THEN capacity
    ELSE (given - coalesce(sum(capacity) FILTER (WHERE is_full) OVER p, 0)) * w // sum(w) FILTER (WHERE NOT is_full) OVER p END AS budget
  FROM l2 WINDOW p AS (PARTITION BY domain)),
s0 AS (
  SELECT domain, language, source, tokens, tokens * 2 AS capacity, CAST(1 AS HUGEINT) AS w, budget AS given
  FROM leaves JOIN l3 USING (domain, language)),
s1 AS (
  SELECT *, coalesce(sum(capacity) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
         sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
  FROM s0 WINDOW o AS (PARTITION BY domain, language ORDER BY CAST(capacity AS DOUBLE) / CAST(w AS DOUBLE), source)),
s2 AS (SELECT *, capacity * weight_left <= (given - full_before) * w AS is_full FROM s1),
s3 AS (
  SELECT domain, language, source, tokens, CASE WHEN is_full THEN capacity
    ELSE (given - coalesce(sum(capacity) FILTER (WHERE is_full) OVER p, 0)) * w // sum(w) FILTER (WHERE NOT is_full) OVER p END AS budget
  FROM s2 WINDOW p AS (PARTITION BY domain, language)),
epochs AS (
  SELECT doc_id, domain, language, source, n_tokens, CAST(e.epoch AS BIGINT) AS epoch,
         CAST(CASE WHEN e.epoch < budget // tokens THEN tokens ELSE budget % tokens END AS BIGINT) AS leaf_tokens
  FROM rows JOIN s3 USING (domain, language, source), (SELECT unnest([0, 1, 2]) AS epoch) e
  WHERE e.epoch <= budget // tokens),
placed AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, language, source, epoch ORDER BY md5('1:' || epoch || ':' || doc_id)) - n_tokens AS before
  FROM epochs)
SELECT doc_id, domain, language, source, epoch, n_tokens, CAST(least(n_tokens, leaf_tokens - before) AS BIGINT) AS take_tokens
FROM placed WHERE before < leaf_tokens
""",
    "op12_prefix_trie": r"""
WITH steps AS (  -- what a byte does to a cyclic redundancy check
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS after
  FROM (SELECT unnest(range(0, 256)) AS i)),
numbered AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS at,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT conv_id, count(*) AS n FROM numbered GROUP BY conv_id),
hashed AS (
  SELECT conv_id, n, conv_id - conv_id % 20 AS base,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                         lambda c, b: xor(c // 256, after[xor(c % 256, b) + 1])), 4294967295) % 4 AS h
  FROM sizes, steps),
convs AS (
  SELECT c.conv_id, base, h, least(h, coalesce(s.n, 0)) AS opening, least(h, coalesce(s.n, 0)) + greatest(c.n - h, 0) AS length
  FROM hashed c LEFT JOIN sizes s ON s.conv_id = c.base),
turns AS (
  SELECT c.conv_id, t.at AS depth, role, text FROM convs c JOIN numbered t ON t.conv_id = c.base WHERE t.at <= opening
  UNION ALL
  SELECT c.conv_id, t.at - h + opening, role, text FROM convs c JOIN numbered t USING (conv_id) WHERE t.at > h),
prefixes AS (
  SELECT conv_id, depth, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY depth) AS prefix,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
  FROM turns
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
nodes AS (
  SELECT depth, prefix, min(conv_id) AS node, count(*) AS n_convs, any_value(words) AS words FROM prefixes GROUP BY depth, prefix),
members AS (SELECT p.conv_id, p.depth, n.node, n.n_convs, n.words FROM prefixes p JOIN nodes n USING (depth, prefix)),
tops AS (  -- each node by its smallest member, with the node above it
  SELECT m.conv_id, m.depth, m.n_convs, m.words, u.node AS parent FROM members m LEFT JOIN members u ON u.conv_id = m.conv_id AND u.depth = m.depth - 1 WHERE m.node = m.conv_id),
children AS (SELECT parent AS conv_id, depth - 1 AS depth, count(*) AS n FROM tops WHERE depth > 0 GROUP BY ALL),
ends AS (
  SELECT m.node AS conv_id, m.depth, string_agg(CAST(m.conv_id AS VARCHAR), ',' ORDER BY m.conv_id) AS ids
  FROM members m JOIN convs c ON c.conv_id = m.conv_id AND c.length = m.depth GROUP BY ALL),
below AS (
  SELECT m.node AS conv_id, m.depth, count(*) FILTER (WHERE c.n IS NULL) AS n_leaves, sum((t.n_convs - 1) * t.words) AS saved
  FROM tops t LEFT JOIN children c ON c.conv_id = t.conv_id AND c.depth = t.depth
  JOIN members m ON m.conv_id = t.conv_id AND m.depth <= t.depth GROUP BY ALL)
SELECT t.conv_id, CAST(t.depth AS BIGINT) AS depth, t.parent AS parent_conv_id, t.n_convs, coalesce(c.n, 0) AS n_children, b.n_leaves,
       CAST(b.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM tops t LEFT JOIN children c USING (conv_id, depth) LEFT JOIN ends e USING (conv_id, depth) JOIN below b USING (conv_id, depth)
""",
}

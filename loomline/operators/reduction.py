"""Reduction of a source's units: claims merged, edges between units, outlines, gaps and renumbering.

Claims are (keys, unit, claim, text, status, evidence array, qualifiers array), edges (keys, owner, from_id,
to_id, kind), units (keys, id, kind, topic, start, end).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import sequence

#: Ids that a merged claim keeps, and the share of the shorter range from which topics conflict.
MOST_IDS, HEAVY = 20, 0.5


def merged_status(left: Column, right: Column) -> Column:
    """unresolved if one of both is, else contradicted if one is, else the left one."""
    either = lambda x: (left == x) | (right == x)
    return F.when(either("unresolved"), "unresolved").when(either("contradicted"), "contradicted").otherwise(left)


def merged_ids(left: Column, right: Column, most: int = MOST_IDS) -> Column:
    """Distinct ids of both, the left ones first, at most `most`."""
    return F.slice(F.array_distinct(F.concat(left, right)), 1, most)


def split_status(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, status of windows (status, n_units, error) that were cut apart: failed if a part is, else degraded if a part is or
    none has units, else complete; and `error`: the parts' errors in order of `part`."""
    errors = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("error") != "", F.struct("part", "error")))), lambda x: x["error"]), "; ")
    found = rows.groupBy(*keys).agg(F.bool_or(F.col("status") == "failed").alias("_f"), F.bool_or(F.col("status") == "degraded").alias("_d"), F.sum("n_units").alias("_n"), errors.alias("error"))
    status = F.when(F.col("_f"), "failed").when(F.col("_d") | (F.col("_n") == 0), "degraded").otherwise("complete")
    return found.select(*keys, status.alias("status"), F.substring("error", 1, 400).alias("error"))


def native_merged(claims: DataFrame, native: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Claims (keys, claim, start, end of the unit, status, evidence) with the evidence of native ones (the same columns)
    of the same id whose unit overlaps; supported if the native one is and has evidence. The last native one by
    start of an id counts; no claims are added."""
    other = native.select(*keys, "claim", *(F.col(c).alias(f"_{c}") for c in ("start", "end", "status", "evidence")))
    met = claims.join(other, [*keys, "claim"]).where((F.col("_end") > F.col("start")) & (F.col("_start") < F.col("end")))
    last = met.groupBy(*keys, "claim").agg(F.max_by(F.struct("_status", "_evidence"), F.struct("_start", "_end")).alias("n"))
    found = claims.join(last, [*keys, "claim"], "left")
    sure = (F.col("n._status") == "supported") & (F.size("n._evidence") > 0)
    evidence = F.when(F.col("n").isNull(), F.col("evidence")).otherwise(F.array_distinct(F.concat("evidence", "n._evidence")))
    return found.select(*keys, "claim", F.when(sure, "supported").otherwise(F.col("status")).alias("status"), evidence.alias("evidence"))


def concepts_meet(left: DataFrame, right: DataFrame, pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs (keys, left_id, right_id) of which a concept of one unit is one of the other, or within it; (keys, id, concept) each."""
    a = left.where("concept <> ''").select(*keys, F.col("id").alias("left_id"), F.col("concept").alias("_a"))
    b = right.where("concept <> ''").select(*keys, F.col("id").alias("right_id"), F.col("concept").alias("_b"))
    met = pairs.join(a, [*keys, "left_id"]).join(b, [*keys, "right_id"]).where(F.col("_a").contains(F.col("_b")) | F.col("_b").contains(F.col("_a")))
    return met.select(pairs.columns).distinct()


def concepts_of(claims: DataFrame, keys: Sequence[str]) -> DataFrame:
    return claims.select(*keys, F.col("unit").alias("id"), T.normalize_concept(F.col("text")).alias("concept")).distinct()


def justified_edges(units: DataFrame, claims: DataFrame, keys: Sequence[str], *, of_kind: str, edge: str) -> DataFrame:
    """Edges (keys, from_id, to_id, kind) between successive units of one kind, by (start, id), of one topic: if a concept of
    theirs is the same or within the other's; for step_before also if the second's first step follows the first's last one."""
    w = Window.partitionBy(*keys).orderBy("start", "id")
    own = units.where(F.col("kind") == of_kind).withColumn("right_id", F.lead("id").over(w)).withColumn("_topic", F.lead("topic").over(w))
    pairs = own.where("topic = _topic and topic <> ''").select(*keys, F.col("id").alias("left_id"), "right_id")
    concepts = concepts_of(claims, keys)
    found = concepts_meet(concepts, concepts, pairs, keys)
    if edge == "step_before":
        steps = claims.withColumn("_step", T.step_index(F.col("text"))).groupBy(*keys, "unit").agg(F.min("_step").alias("first"), F.max("_step").alias("last"))
        a = steps.select(*keys, F.col("unit").alias("left_id"), "last")
        b = steps.select(*keys, F.col("unit").alias("right_id"), "first")
        found = found.unionByName(pairs.join(a, [*keys, "left_id"]).join(b, [*keys, "right_id"]).where("first = last + 1").select(pairs.columns)).distinct()
    return found.select(*keys, F.col("left_id").alias("from_id"), F.col("right_id").alias("to_id"), F.lit(edge).alias("kind"))


def recap_sources(units: DataFrame, claims: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, recap, source): of each recap the first other unit by `n` of which a claim's concept is within one of the recap's, or
    the other way round; the empty concept is within every one. A recap of empty concepts only has no source.

    Of the sources of a key with one concept only the first is joined.
    """
    own = claims.select(*keys, F.col("unit").alias("id"), T.normalize_concept(F.col("text")).alias("c")).distinct().join(units.select(*keys, "id", "kind", "n"), [*keys, "id"])
    recaps = own.where("kind = 'recap'").select(*keys, F.col("id").alias("recap"), F.col("c").alias("_r"))
    full = recaps.where("_r <> ''").select(*keys, "recap").distinct()
    sources = own.where("kind <> 'recap'").groupBy(*keys, "c").agg(F.min(F.struct("n", "id")).alias("s"))
    recaps = recaps.join(full, [*keys, "recap"], "left_semi")
    met = within(sources, recaps, keys, "c", "_r").unionByName(within(recaps, sources, keys, "_r", "c"))
    met = met.unionByName(sources.where("c = ''").drop("c").join(recaps.select(*keys, "recap").distinct(), list(keys)).select(*keys, "recap", "s"))
    return met.groupBy(*keys, "recap").agg(F.min("s")["id"].alias("source"))


def within(inner: DataFrame, outer: DataFrame, keys: Sequence[str], text: str, whole: str) -> DataFrame:
    """Pairs (keys, recap, s) of rows whose non-empty text is part of the other's whole: they meet at the text's first three
    characters, which the whole has somewhere, and not as all pairs of a key."""
    grams = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(whole)), lambda i: F.array(*(F.substr(F.col(whole), i, F.lit(k)) for k in (1, 2, 3))))))
    heads = inner.where(F.col(text) != "").withColumn("_g", F.substring(text, 1, 3))
    return heads.join(outer.where(F.col(whole) != "").withColumn("_g", F.explode(grams)), [*keys, "_g"]).where(F.col(whole).contains(F.col(text))).select(*keys, "recap", "s")


def owned_edges(edges: DataFrame, units: DataFrame, claims: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct edges with `owner`: the unit that an edge begins at, if it is neither the old owner nor a claim; else the old one."""
    is_claim = claims.select(*keys, F.col("claim").alias("from_id")).distinct().withColumn("_claim", F.lit(True))
    is_unit = units.select(*keys, F.col("id").alias("from_id")).distinct().withColumn("_unit", F.lit(True))
    found = edges.join(is_claim, [*keys, "from_id"], "left").join(is_unit, [*keys, "from_id"], "left")
    moves = (F.col("from_id") != F.col("owner")) & F.col("_claim").isNull() & F.col("_unit").isNotNull()
    return found.withColumn("owner", F.when(moves, F.col("from_id")).otherwise(F.col("owner"))).select(*keys, "owner", "from_id", "to_id", "kind").distinct()


def outline(topics: DataFrame, timelines: DataFrame, key: str) -> DataFrame:
    """topics (key, n, id, title, start, end) -> (key, id, title, start, end, follows): each in order of n, unless it conflicts with one
    that is kept: another title, and the same range or half of the shorter one in common. A timeline (key, duration) without
    topics has a placeholder. Ids are made unique by (start, end, id); `follows` is the id before.

    A topic is tested against what a source kept, so the topics of one source are folded in one row.
    """
    kind = "array<struct<n: bigint, id: string, title: string, start: double, end: double>>"

    def conflict(a: Column, b: Column) -> Column:
        overlap = F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"])
        shorter = F.least(a["end"] - a["start"], b["end"] - b["start"])
        same = (F.abs(a["start"] - b["start"]) < 1e-6) & (F.abs(a["end"] - b["end"]) < 1e-6)
        return (overlap > 0) & (shorter > 0) & (same | (overlap >= HEAVY * shorter)) & (a["title"] != b["title"])

    def step(kept: Column, x: Column) -> Column:
        return F.when(F.exists(kept, lambda y: conflict(y, x)), kept).otherwise(F.concat(kept, F.array(x)))

    items = F.array_sort(F.collect_list(F.struct(F.col("n").cast("long").alias("n"), "id", "title", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))))
    kept = topics.groupBy(key).agg(items.cast(kind).alias("items")).select(key, F.explode(F.aggregate("items", F.array().cast(kind), step)).alias("t")).select(key, "t.*")
    bare = timelines.join(topics.select(key).distinct(), key, "left_anti").select(key, F.lit(0).cast("long").alias("n"), F.lit("topic-unverified").alias("id"), F.lit("未覆盖主题").alias("title"), F.lit(0.0).alias("start"), F.col("duration").cast("double").alias("end"))
    named = sequence.unique_ids(kept.unionByName(bare), [key], ["start", "end", "id"], "id")
    w = Window.partitionBy(key).orderBy("start", "end", "id", "n")
    return named.withColumn("follows", F.lag("unique_id").over(w)).select(key, F.col("unique_id").alias("id"), "title", "start", "end", "follows")


def coverage_marked(units: DataFrame, covered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Claims of units (keys, start, end, status) beyond the covered end (keys, covered_end), with `gap_start` of what is
    not covered: units past it, and those across it, have draft and supported claims unresolved."""
    rows = units.join(covered, list(keys))
    past, across = F.col("start") >= F.col("covered_end") - 1e-6, F.col("end") > F.col("covered_end") + 1e-6
    status = F.when((past | across) & F.col("status").isin("draft", "supported"), "unresolved").otherwise(F.col("status"))
    return rows.withColumn("status", status).withColumn("gap_start", F.when(past, F.col("start")).when(across, F.col("covered_end"))).drop("covered_end")


def mark_unresolved(status: Column) -> Column:
    return F.when(status == "draft", "unresolved").otherwise(status)


def renumbered(units: DataFrame, claims: DataFrame, edges: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """units (keys, n, id), claims (keys, n of the unit, m, id) and edges (keys, n, from_id, to_id) with unique ids: later ones of
    a name are numbered. An edge's ends follow the new id of its own unit, or of the first claim of that name in it."""
    new_units = sequence.unique_ids(units, keys, ["n"], "id")
    new_claims = sequence.unique_ids(claims, keys, ["n", "m"], "id")
    first = new_claims.groupBy(*keys, "n", F.col("id").alias("_old")).agg(F.min_by("unique_id", "m").alias("_claim"))
    found = edges.join(new_units.select(*keys, "n", F.col("id").alias("_unit"), F.col("unique_id").alias("_new")), [*keys, "n"])
    for end in ("from_id", "to_id"):
        found = found.join(first.withColumnRenamed("_old", end), [*keys, "n", end], "left")
        found = found.withColumn(end, F.when(F.col(end) == F.col("_unit"), F.col("_new")).otherwise(F.coalesce("_claim", end))).drop("_claim")
    return new_units, new_claims, found.drop("_unit", "_new")


def best_snippets(rows: DataFrame, keys: Sequence[str], kinds: Sequence[str], *, most: int = 80) -> DataFrame:
    """(keys, kind, snippet) the text with the highest score of each kind, the first of equal ones by n, cut to `most`; `place` is
    that of the kind in kinds."""
    place = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    n = F.row_number().over(Window.partitionBy(*keys, "kind").orderBy(F.desc("score"), "n"))
    return rows.withColumn("_n", n).where("_n = 1").select(*keys, "kind", F.substring("text", 1, most).alias("snippet"), place.alias("place")).where("place > 0")


def strongest(rows: DataFrame, keys: Sequence[str], kinds: Sequence[str], weights: Column) -> DataFrame:
    """(keys, kind, strength): the kind with the greatest sum of weights; of equal ones the first in kinds; other if none is over 0."""
    sums = rows.groupBy(*keys).agg(*(F.sum(F.when(F.col("kind") == k, weights).otherwise(0.0)).alias(f"_{k}") for k in kinds))
    top = F.greatest(*(F.col(f"_{k}") for k in kinds))
    name = F.coalesce(*(F.when((F.col(f"_{k}") == top) & (top > 0), F.lit(k)) for k in kinds), F.lit("other"))
    return sums.select(*keys, name.alias("kind"), top.alias("strength"))

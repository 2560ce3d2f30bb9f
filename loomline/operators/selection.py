"""Scored and capped selection, ordering by prerequisites, pagination and omissions."""

from __future__ import annotations

import heapq
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .steps import Steps, reachable, tasks_for

#: The weights of a unit's and of a frame's score.
UNIT_WEIGHTS = {"topic": 0.35, "importance": 0.25, "evidence": 0.20, "novelty": 0.20}
FRAME_WEIGHTS = {"relevance": 0.45, "legibility": 0.30, "completeness": 0.15, "closeness": 0.10}

#: Scores of units and frames in a task.
SCORES = 250_000


def unit_score(importance: Column, n_evidence: Column, penalty: Column) -> Column:
    w = UNIT_WEIGHTS
    return w["topic"] + w["importance"] * importance + w["evidence"] * F.least(F.lit(1.0), n_evidence / 3.0) + w["novelty"] - penalty


def frame_score(relevance: Column, legibility: Column, completeness: Column, distance: Column, half: Column) -> Column:
    """distance: seconds from the unit's middle, half: half of its length."""
    w = FRAME_WEIGHTS
    closeness = F.greatest(F.lit(0.0), 1.0 - distance / F.greatest(half, F.lit(1.0)))
    return w["relevance"] * F.coalesce(relevance, F.lit(0.6)) + w["legibility"] * F.coalesce(legibility, F.lit(0.6)) + w["completeness"] * F.coalesce(completeness, F.lit(0.6)) + w["closeness"] * closeness


def ranked(rows: DataFrame, keys: Sequence[str], score: str, order: Sequence[str], demoted: str | None = None) -> DataFrame:
    """rows with `rank` by score (5 less if demoted) downwards, then by `order`."""
    value = F.col(score) - (F.when(F.col(demoted), 5.0).otherwise(0.0) if demoted else 0.0)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(value.desc(), *order)))


def top(rows: DataFrame, keys: Sequence[str], score: str, order: Sequence[str], n: int) -> DataFrame:
    return ranked(rows, keys, score, order).where(F.col("rank") <= n)


def paginated(rows: DataFrame, keys: Sequence[str], order: Sequence[str], size: int = 4) -> DataFrame:
    """rows with `page` (from 0) and `continuation` (not the first page of its key)."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return rows.withColumn("page", F.floor(n / size)).withColumn("continuation", F.col("page") > 0)


def capped_evidence(rows: DataFrame, keys: Sequence[str], kind: str, order: Sequence[str], most: int) -> DataFrame:
    """All rows that aren't `ocr`, then `ocr` rows in order up to `most` in all; `omitted` counts the rest by key."""
    w = Window.partitionBy(*keys)
    counted = rows.withColumn("_other", F.sum((F.col(kind) != "ocr").cast("int")).over(w)).withColumn("_all", F.count(F.lit(1)).over(w))
    n = F.row_number().over(Window.partitionBy(*keys, F.col(kind) == "ocr").orderBy(*order))
    kept = counted.withColumn("_n", n).where((F.col(kind) != "ocr") | (F.col("_n") <= most - F.col("_other")))
    return kept.withColumn("omitted", F.greatest(F.lit(0), F.col("_all") - F.greatest(F.lit(most), F.col("_other")))).drop("_n", "_other", "_all")


def omissions(candidates: DataFrame, selected: DataFrame, key: str, reasons: Mapping[str, Column], otherwise: str) -> DataFrame:
    """Candidates that aren't selected, with the first reason that holds."""
    reason = F.lit(otherwise)
    for name in reversed(list(reasons)):
        reason = F.when(reasons[name], F.lit(name)).otherwise(reason)
    return candidates.join(selected.select(key).distinct(), key, "left_anti").withColumn("reason", reason)


def prerequisites_closed(selected: DataFrame, edges: DataFrame) -> DataFrame:
    """Selected ids and all that they need: edges (id, needs). Stops when a step adds nothing."""
    return reachable(selected, edges.select("id", F.col("needs").alias("next")))


def pedagogical(rows: DataFrame, keys: Sequence[str], group: Column) -> DataFrame:
    """rows (id, start) with `position` from 1: by group, then (start, id)."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(group, "start", "id")))


def representatives(rows: DataFrame, keys: Sequence[str], classes: Sequence[str]) -> DataFrame:
    """The one row of each key whose kind comes first in classes (other kinds last), then with the highest score, then by (start, id)."""
    rank = F.lit(len(classes))
    for i, name in reversed(list(enumerate(classes))):
        rank = F.when(F.col("kind") == name, F.lit(i)).otherwise(rank)
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(rank, F.desc("score"), "start", "id"))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def grouped_pages(rows: DataFrame, keys: Sequence[str], *, size: int = 2, most: int = 2) -> DataFrame:
    """rows (id, kind, position) with `page_id`: examples of a key in groups of `size`, at most `most` groups, each
    named by its first; if there are none, the first `size` others are one group. Rows beyond are dropped; keys with one row stay as they are."""
    w = Window.partitionBy(*keys)
    example = F.col("kind") == "example"
    n = F.row_number().over(Window.partitionBy(*keys, example).orderBy("position", "id")) - 1
    found = rows.withColumn("_all", F.count(F.lit(1)).over(w)).withColumn("_any", F.sum(example.cast("int")).over(w)).withColumn("_g", F.floor(n / size))
    grouped = F.when(F.col("_any") > 0, example & (F.col("_g") < most)).otherwise(F.col("_g") < 1)
    found = found.where((F.col("_all") < 2) | grouped)
    first = F.first("id").over(Window.partitionBy(*keys, "_g").orderBy("position", "id"))
    return found.withColumn("page_id", F.when(F.col("_all") < 2, F.col("id")).otherwise(first)).drop("_all", "_any", "_g")


def demoted_duplicates(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Losers (keys, id) of duplicate pairs (left_id, right_id, left_score, right_score, left_example, right_example,
    left_start, right_start), in the order of (left_id, right_id): a pair with a loser is left out. The lower score
    loses, of equal ones the example, then the later start, then the right one. The pairs of a key are folded in one row."""
    left = F.col("left_score") < F.col("right_score")
    same = F.col("left_score") == F.col("right_score")
    left = left | (same & F.col("left_example") & ~F.col("right_example"))
    alike = same & (F.col("left_example") == F.col("right_example"))
    left = left | (alike & (F.col("left_start") > F.col("right_start")))
    rows = pairs.select(*keys, F.struct("left_id", "right_id", F.when(left, F.col("left_id")).otherwise(F.col("right_id")).alias("loser")).alias("p"))
    kind = f"array<{dict(pairs.dtypes)['left_id']}>"

    def step(lost: Column, p: Column) -> Column:
        seen = F.array_contains(lost, p["left_id"]) | F.array_contains(lost, p["right_id"])
        return F.when(seen, lost).otherwise(F.concat(lost, F.array(p["loser"])))

    folded = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("p")).alias("ps"))
    return folded.select(*keys, F.explode(F.aggregate("ps", F.array().cast(kind), step)).alias("id"))


def budgeted(candidates: DataFrame, edges: DataFrame, keys: Sequence[str], *, target: int, most: int, caps: Mapping[str, int]) -> DataFrame:
    """Candidates (id, topic, kind, score, mandatory) chosen for a budget, with `reason`.

    Taken are, by rank of score: mandatory ones, the best one of each topic while there is room (a reserve for every
    topic), then others up to `target`, never more of a kind than caps allows (mandatory ones count, but stay); then
    what those need (edges: keys, id, needs), which may go over the target, up to `most`. All steps are ranks over a key.
    """
    order = [F.desc("score"), F.col("id")]
    own = candidates.withColumn("_top", F.row_number().over(Window.partitionBy(*keys, "topic").orderBy(*order)) == 1)
    first = F.when(F.col("mandatory"), 0).when(F.col("_top"), 1).otherwise(2)
    own = own.withColumn("_class", first)
    of_kind = F.row_number().over(Window.partitionBy(*keys, "kind").orderBy("_class", *order))
    cap = F.lit(1 << 30)
    for name, n in caps.items():
        cap = F.when(F.col("kind") == name, F.lit(n)).otherwise(cap)
    fits = own.withColumn("_k", of_kind).where((F.col("_class") == 0) | (F.col("_k") <= cap))
    taken = fits.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_class", *order))).where((F.col("_class") == 0) | (F.col("_n") <= target))
    reason = F.when(F.col("_class") == 0, "mandatory").when(F.col("_class") == 1, "topic reserve").otherwise("score")
    # written, since four steps read it
    taken = Steps(candidates.sparkSession, "budgeted").write(taken.select(*candidates.columns, reason.alias("reason"), F.col("_n")))
    joined = F.struct(*keys, "id").alias("id")
    needed = reachable(taken.select(joined), edges.select(joined, F.struct(*keys, F.col("needs").alias("id")).alias("next"))).select("id.*")
    more = candidates.join(needed, [*keys, "id"], "left_semi").join(taken.select(*keys, "id"), [*keys, "id"], "left_anti")
    room = taken.groupBy(*keys).agg((F.lit(most) - F.count(F.lit(1))).alias("_room"))
    more = more.join(room, list(keys)).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= F.col("_room"))
    return taken.drop("_n").unionByName(more.select(*candidates.columns, F.lit("prerequisite").alias("reason")))


def trimmed(pages: DataFrame, keys: Sequence[str], classes: Sequence[str], most: int) -> DataFrame:
    """pages (id, class, score, protected): protected ones, and others by class, score and id while `most` has room."""
    rank = F.lit(len(classes))
    for i, name in reversed(list(enumerate(classes))):
        rank = F.when(F.col("class") == name, F.lit(i)).otherwise(rank)
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.when(F.col("protected"), 0).otherwise(1), rank, F.desc("score"), "id"))
    return pages.withColumn("_n", n).where(F.col("protected") | (F.col("_n") <= most)).drop("_n")


def teaching_order(rows: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """rows (key, id, start) with `position`: an order in which all that an id needs comes before it; among
    those that are ready the earliest first, by (start, id). Ids in cycles come last, in that order too.

    edges: (key, id, needs). One source's units are one group.
    """
    needs = edges.groupBy(key, "id").agg(F.collect_set("needs").alias("needs"))
    schema = ", ".join(f"{c} {t}" for c, t in rows.select(key, "id").dtypes) + ", position int"

    def order(group: pd.DataFrame) -> pd.DataFrame:
        at = {r.id: (r.start, r.id) for r in group.itertuples()}
        waits = {r.id: {x for x in (r.needs if r.needs is not None else ()) if x in at and x != r.id} for r in group.itertuples()}
        follow: dict = {}
        for i, before in waits.items():
            for x in before:
                follow.setdefault(x, []).append(i)
        ready = [at[i] for i, before in waits.items() if not before]
        heapq.heapify(ready)
        out = []
        while ready:
            _, i = heapq.heappop(ready)
            out.append(i)
            for x in follow.get(i, ()):
                waits[x].discard(i)
                if not waits[x]:
                    heapq.heappush(ready, at[x])
        out += [i for _, i in sorted(set(at.values()) - {at[i] for i in out})]
        return pd.DataFrame({key: group[key].iloc[0], "id": out, "position": range(len(out))})

    return rows.select(key, "id", "start").join(needs, [key, "id"], "left").groupBy(key).applyInPandas(order, schema)


def assign_without_reuse(scores: DataFrame, key: str, order: str) -> DataFrame:
    """scores (key, unit, order, frame, score) -> (key, unit, frame): in order, each unit takes its best
    frame (the least of equal scores) that no unit before it took; units without one are left out.

    In rounds over all keys: each unit asks for its best frame, a frame is held by the first unit in order that has asked, and
    no unit behind that one can have it any more. Once all that ask hold what they ask for, nobody before them wants it.
    Rows are dealt to tasks of about SCORES: neither the files they come in nor their number makes a task larger.
    """
    steps = Steps(scores.sparkSession, "assign")
    place = F.struct(F.col(order).alias("o"), "unit")
    # written as they come: to combine equal ones before they are dealt would keep as many as a file has
    rows = steps.write(scores.select(key, "unit", place.alias("place"), "frame", "score").where("unit is not null and frame is not null and score is not null"))
    rows = rows.repartition(tasks_for(rows, SCORES), key, "unit").groupBy(key, "unit", "frame")
    open_ = steps.write(rows.agg(F.min("place.o").alias("o"), F.max("score").alias("score")).select(key, "unit", F.struct("o", "unit").alias("place"), "frame", "score"))
    while True:
        n = tasks_for(open_, SCORES)
        asked = open_.repartition(n, key, "unit").groupBy(key, "unit").agg(F.min(F.struct((-F.col("score")).alias("s"), "frame"))["frame"].alias("frame"), F.min("place").alias("place"))
        held = steps.write(asked.repartition(n, key, "frame").groupBy(key, "frame").agg(F.min("place").alias("holder"), F.count(F.lit(1)).alias("n")))
        if held.where("n > 1").isEmpty():
            return held.select(key, F.col("holder.unit").alias("unit"), "frame")
        open_ = steps.write(open_.repartition(n, key, "frame").join(held.select(key, "frame", "holder"), [key, "frame"], "left").where("holder is null or place <= holder").drop("holder"))

"""Replay of review logs with optimistic concurrency.

A document is a list of pages. An edit names the revision (and, if it likes, the digest) of the state that it
was made on, and holds ops in order. It is accepted as a whole or not at all, and an accepted edit makes the next revision.
So the edit that makes a revision is the first legal one of those that name the one before and come after the
edit that made it: a round tries all of these at once, for all documents, and there are as many rounds as the longest
history has revisions.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from .steps import Steps

#: The ops of a review.
OPS = ("reorder", "lock", "delete", "edit_copy", "pick_asset")
#: Those that a locked page refuses.
CHANGES = ("edit_copy", "pick_asset", "delete")
PAGES = "doc string, page_id string, ordinal long, title string, notes string, locked boolean, frames array<string>, allowed array<string>, claims array<string>"
EDITS = "doc string, edit long, revision long, base string, op_no long, op string, page_id string, title string, notes string, frames array<string>, page_order array<string>"
STALE, STALE_DIGEST, NOT_ALLOWED, UNKNOWN, LOCKED, FRAMES, ORDER, LAST = "stale revision", "stale digest", "op not allowed", "unknown page", "page is locked", "frames not allowed", "not a permutation", "last page"


def page_digest() -> Column:
    """48 bits of the digest of a page; a document's digest is the sum of its pages', so it needs no order and no list."""
    text = F.concat_ws("|", "page_id", F.col("ordinal").cast("string"), F.coalesce("title", F.lit("")), F.coalesce("notes", F.lit("")), F.col("locked").cast("string"), F.array_join("frames", ","))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def digests(pages: DataFrame) -> DataFrame:
    """(doc, n_pages, digest) of the pages of each document."""
    return pages.groupBy("doc").agg(F.count(F.lit(1)).alias("n_pages"), F.sum(page_digest()).cast("string").alias("digest"))


def _judged(ops: DataFrame, pages: DataFrame, allowed_ops: Sequence[str]) -> DataFrame:
    """(doc, edit, reason) of the edits in ops (with digest and n_pages of their document): reason is null if an edit is legal."""
    earlier = Window.partitionBy("doc", "edit").orderBy("op_no").rowsBetween(Window.unboundedPreceding, -1)
    on_page = Window.partitionBy("doc", "edit", "page_id").orderBy("op_no").rowsBetween(Window.unboundedPreceding, -1)
    was = lambda op: F.coalesce(F.max(F.col("op") == op).over(on_page), F.lit(False))
    state = pages.select("doc", "page_id", F.col("locked").alias("is_locked"), F.col("allowed").alias("allowed_frames"), F.lit(True).alias("is_there"))
    ops = ops.withColumns({"gone": was("delete"), "held": was("lock"), "deleted": F.collect_set(F.when(F.col("op") == "delete", F.col("page_id"))).over(earlier)})
    # only a reorder, which lists all pages itself, needs the list of them
    asked = ops.where("op = 'reorder'").select("doc").distinct()
    listed = pages.join(asked, "doc", "left_semi").groupBy("doc").agg(F.collect_list("page_id").alias("all_pages"))
    ops = ops.join(state, ["doc", "page_id"], "left").join(listed, "doc", "left")
    of_page = F.col("op") != "reorder"
    frames = F.coalesce("frames", F.array().cast("array<string>"))
    remaining = F.array_except(F.coalesce("all_pages", F.array().cast("array<string>")), "deleted")
    fault = (
        F.when(of_page & (F.col("is_there").isNull() | F.col("gone")), UNKNOWN)
        .when(F.col("op").isin(*CHANGES) & (F.col("is_locked") | F.col("held")), LOCKED)
        .when((F.col("op") == "pick_asset") & (F.size(F.array_except(frames, F.coalesce("allowed_frames", F.array().cast("array<string>")))) > 0), FRAMES)
        .when(~of_page & ~F.coalesce(F.array_sort("page_order") == F.array_sort(remaining), F.lit(False)), ORDER)
    )
    ops = ops.withColumn("fault", fault)
    found = ops.groupBy("doc", "edit").agg(
        F.max(F.col("base").isNotNull() & ~F.col("base").eqNullSafe(F.col("digest"))).alias("other"),
        F.max(~F.coalesce(F.col("op").isin(*allowed_ops), F.lit(False))).alias("foreign"),
        F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("op_no"))).alias("fault"),
        (F.count_distinct(F.when(F.col("op") == "delete", F.col("page_id"))) >= F.max("n_pages")).alias("empties"),
    )
    reason = F.when(F.col("other"), STALE_DIGEST).when(F.col("foreign"), NOT_ALLOWED).when(F.col("fault").isNotNull(), F.col("fault")).when(F.col("empties"), LAST)
    return found.select("doc", "edit", reason.alias("reason"))


def _applied(pages: DataFrame, ops: DataFrame) -> DataFrame:
    """The pages after the legal ops of one edit a document; deleted ones are marked."""
    last = lambda c, op: F.max_by(c, F.when((F.col("op") == op) & F.col(c).isNotNull(), F.col("op_no"))).alias(f"new_{c}")
    by_page = ops.groupBy("doc", "page_id").agg(last("title", "edit_copy"), last("notes", "edit_copy"), last("frames", "pick_asset"), F.max(F.col("op") == "lock").alias("new_lock"), F.max(F.col("op") == "delete").alias("gone"))
    order = ops.where("op = 'reorder'").groupBy("doc").agg(F.max_by("page_order", "op_no").alias("page_order")).select("doc", F.posexplode("page_order").alias("place", "page_id"))
    rows = pages.join(by_page, ["doc", "page_id"], "left").join(order, ["doc", "page_id"], "left")
    new = {c: F.coalesce(f"new_{c}", c) for c in ("title", "notes", "frames")} | {"ordinal": F.coalesce(F.col("place").cast("long") + 1, "ordinal"), "locked": F.col("locked") | F.coalesce("new_lock", F.lit(False))}
    return rows.select(*(new.get(c, F.col(c)).alias(c) for c in pages.columns), F.coalesce("gone", F.lit(False)).alias("gone"))


def replay(pages: DataFrame, edits: DataFrame, *, allowed_ops: Sequence[str] = OPS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Decisions (doc, edit, accepted, reason, revision), the pages that are left, and omissions (doc, edit, page_id, claim).

    pages has the columns of PAGES (page_id once a document), edits those of EDITS, a row for each op; edit is the place
    in the log, and the ops of an edit share its revision and base. revision of a decision is the one that stands after it.
    An edit is rejected, with the first reason that holds: it names another revision than the one that stands, another
    digest than that of the pages (a null base names none), an op that isn't allowed; or its first op that fails names
    no page, changes a locked one, picks frames outside of `allowed`, or orders other than all remaining pages once
    each; or no page would stay. A new title or note that is null leaves the old one. Deleting a page omits its claims.
    Edits of unknown documents name no page. An op that is null is not allowed.
    """
    steps = Steps(pages.sparkSession, "review")
    names = [x.split()[0] for x in PAGES.split(", ")]
    empty = F.array().cast("array<string>")
    lists = {c: F.coalesce(c, empty) for c in ("frames", "allowed", "claims")}
    now = steps.write(pages.select(names).withColumns(lists | {"locked": F.coalesce("locked", F.lit(False))}))
    edits = steps.write(edits.select([x.split()[0] for x in EDITS.split(", ")]).where("doc is not null and edit is not null"))
    heads = edits.select("doc").distinct().select("doc", F.lit(0).cast("long").alias("revision"), F.lit(None).cast("long").alias("after"))
    decided, omitted, ended = [], [], []
    while True:
        known = heads.join(digests(now), "doc", "left").withColumn("n_pages", F.coalesce("n_pages", F.lit(0)))
        ops = steps.write(edits.join(known, ["doc", "revision"]).where("after is null or edit > after"))
        if ops.isEmpty():
            break
        judged = steps.write(_judged(ops, now, allowed_ops))
        first = steps.write(judged.where("reason is null").groupBy("doc").agg(F.min("edit").alias("made")))
        tried = judged.join(first, "doc", "left").where("made is null or edit <= made").join(heads.select("doc", "revision"), "doc")
        decided.append(tried.select("doc", "edit", F.col("reason").isNull().alias("accepted"), "reason", (F.col("revision") + F.col("reason").isNull().cast("long")).alias("revision")))
        done = _applied(now, ops.join(first.withColumnRenamed("made", "edit"), ["doc", "edit"], "left_semi"))
        done = steps.write(done.join(first, "doc", "left"))
        omitted.append(done.where("gone").select("doc", F.col("made").alias("edit"), "page_id", F.explode(F.concat(F.array(F.lit(None).cast("string")), "claims")).alias("claim")))
        # the pages of a document whose history ends here are not written again
        ended.append(done.where("made is null").select(names))
        now = done.where("made is not null and not gone").select(names)
        heads = heads.join(first, "doc").select("doc", (F.col("revision") + 1).alias("revision"), F.col("made").alias("after"))
        heads = steps.write(heads)
    # what was never tried named another revision than the one that stood
    every = edits.select("doc", "edit").distinct()
    empty_decisions = every.limit(0).select("doc", "edit", F.lit(False).alias("accepted"), F.lit("").alias("reason"), F.lit(0).cast("long").alias("revision"))
    tried = functools.reduce(DataFrame.unionByName, decided, empty_decisions)
    stood = F.coalesce(F.max("revision").over(Window.partitionBy("doc").orderBy("edit")), F.lit(0).cast("long"))
    found = every.join(tried, ["doc", "edit"], "left").select("doc", "edit", F.coalesce("accepted", F.lit(False)).alias("accepted"), F.when(F.col("accepted").isNull(), F.lit(STALE)).otherwise(F.col("reason")).alias("reason"), stood.alias("revision"))
    left_out = functools.reduce(DataFrame.unionByName, omitted) if omitted else now.limit(0).select("doc", F.lit(0).cast("long").alias("edit"), "page_id", F.lit("").alias("claim"))
    return found, functools.reduce(DataFrame.unionByName, ended, now), left_out


DECISIONS = "doc string, edit long, accepted boolean, reason string, revision long, digest string"


def replay_stream(edits: DataFrame, pages: DataFrame, *, allowed_ops: Sequence[str] = OPS) -> DataFrame:
    """The decisions of replay() as a stream of edits makes them, with the digest that stands after each.

    pages: a table of the documents' pages, which come to a document's state with its first edit (they are joined to the
    stream as one row a document). The state of a document is its revision and pages; the edits of one batch are taken in
    order, and one older than the last seen is rejected as stale.
    """
    import hashlib
    import json

    own = pages.groupBy("doc").agg(F.to_json(F.collect_list(F.struct("page_id", "ordinal", "title", "notes", "locked", "frames", "allowed"))).alias("pages"))
    rows = edits.join(own, "doc", "left")

    def digest(state: dict) -> str | None:
        if not state:
            return None
        text = lambda p: "|".join([p["page_id"], str(p["ordinal"]), p.get("title") or "", p.get("notes") or "", str(bool(p.get("locked"))).lower(), ",".join(p.get("frames") or [])])
        return str(sum(int(hashlib.md5(text(p).encode()).hexdigest()[:12], 16) for p in state.values()))

    def tried(state: dict, ops: list) -> tuple[dict, str | None]:
        if any(op.op not in allowed_ops for op in ops):
            return state, NOT_ALLOWED
        state = {k: dict(p) for k, p in state.items()}
        for op in ops:
            if op.op == "reorder":
                order = list(op.page_order) if op.page_order is not None else []
                if sorted(order) != sorted(state):
                    return state, ORDER
                for place, page_id in enumerate(order):
                    state[page_id]["ordinal"] = place + 1
                continue
            page = state.get(op.page_id)
            if page is None:
                return state, UNKNOWN
            if page.get("locked") and op.op in CHANGES:
                return state, LOCKED
            if op.op == "lock":
                page["locked"] = True
            elif op.op == "delete":
                del state[op.page_id]
            elif op.op == "edit_copy":
                page |= {c: getattr(op, c) for c in ("title", "notes") if getattr(op, c) is not None}
            elif op.frames is not None:
                if set(op.frames) - set(page.get("allowed") or []):
                    return state, FRAMES
                page["frames"] = list(op.frames)
        return state, None if state else LAST

    def step(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(batches))
        if kept.exists:
            revision, seen, state = kept.get[0], kept.get[1], json.loads(kept.get[2])
        else:
            listed = json.loads(got["pages"].iloc[0]) if got["pages"].notna().any() else []
            revision, seen, state = 0, None, {p["page_id"]: p for p in listed}
        out = []
        for edit, some in got.sort_values(["edit", "op_no"]).groupby("edit"):
            ops = list(some.itertuples())
            base, reason, after = ops[0].base, None, state
            if ops[0].revision != revision or (seen is not None and edit <= seen):
                reason = STALE
            elif base is not None and base != digest(state):
                reason = STALE_DIGEST
            else:
                after, reason = tried(state, ops)
            if reason is None:
                state, revision = after, revision + 1
            seen = edit if seen is None else max(seen, edit)
            out.append((key[0], edit, reason is None, reason, revision, digest(state)))
        kept.update((revision, seen, json.dumps(state)))
        yield pd.DataFrame(out, columns=["doc", "edit", "accepted", "reason", "revision", "digest"])

    return rows.groupBy("doc").applyInPandasWithState(step, DECISIONS, "revision long, seen long, pages string", "append", "NoTimeout")

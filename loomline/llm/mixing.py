"""Mixing sources to target weights over a domain-language-source tree. DataFrame functions only.

Every node shares its budget among its children by their weights. A child that has less than its
share gives the rest back to its siblings; only what the children of a node together cannot take
goes back to the node's own siblings, since a node counts with no more than its children can take.
A leaf whose budget is larger than its tokens is read for several epochs. Each epoch has an order
of its own, by a seeded hash of doc_id, and the last one gives a prefix of its tokens.

Weights and tokens are whole numbers and the sharing is exact; a node loses less than one token for
each child to rounding.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import storage

LEVELS = ("domain", "language", "source")
#: Hex digits of the order's hash by which a leaf is cut up, so that no task sorts a whole leaf.
CUT = 3


def count_tokens(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def weight_of(level: Column, weights: Mapping[str, int], otherwise: int) -> Column:
    found = F.lit(otherwise)
    for name, weight in weights.items():
        found = F.when(level == name, F.lit(weight)).otherwise(found)
    return found.cast("decimal(9,0)")


def _share(children: DataFrame, parents: list[str], child: str) -> DataFrame:
    """children (*parents, child, w, capacity, given: the parent's budget) -> (*parents, child, budget)."""
    by = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    ordered = by.orderBy(F.col("capacity").cast("double") / F.col("w").cast("double"), child)
    # in this order those that are full come first
    full_before = F.coalesce(F.sum("capacity").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("decimal(20,0)")
    weight_left = F.sum("w").over(ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)).cast("decimal(12,0)")
    full = F.col("capacity") * F.col("weight_left") <= (F.col("given") - F.col("full_before")).cast("decimal(20,0)") * F.col("w")
    marked = children.withColumn("full_before", full_before).withColumn("weight_left", weight_left).withColumn("full", full)
    used = F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(by), F.lit(0)).cast("decimal(20,0)")
    open_weight = F.sum(F.when(~F.col("full"), F.col("w"))).over(by).cast("decimal(12,0)")
    marked = marked.withColumn("rest", (F.col("given") - used).cast("decimal(20,0)")).withColumn("open_weight", open_weight)
    budget = F.when(F.col("full"), F.col("capacity")).otherwise(F.expr("cast(rest as decimal(20,0)) * w div open_weight")).cast("decimal(20,0)")
    return marked.select(*parents, child, budget.alias("budget"))


def leaf_budgets(leaves: DataFrame, weights: Mapping[str, Mapping[str, int]], *, budget_percent: int, max_epochs: int) -> DataFrame:
    """leaves (domain, language, source, tokens) -> the same and `budget`, of budget_percent of all tokens.

    weights: for each level the weights of names, with "*" for all others (1 if left out).
    """
    capacity = leaves.withColumn("capacity", (F.col("tokens") * max_epochs).cast("decimal(20,0)"))
    given = leaves.agg(F.expr(f"cast(coalesce(sum(tokens), 0) * {budget_percent} div 100 as decimal(20,0))").alias("given"))
    for depth, level in enumerate(LEVELS):
        parents = list(LEVELS[:depth])
        own = weights.get(level, {})
        w = weight_of(F.col(level), {k: v for k, v in own.items() if k != "*"}, own.get("*", 1))
        children = capacity.groupBy(*parents, level).agg(F.sum("capacity").cast("decimal(20,0)").alias("capacity")).withColumn("w", w)
        # the root's budget is one row
        children = children.join(given, parents) if parents else children.crossJoin(F.broadcast(given))
        given = _share(children, parents, level).withColumnRenamed("budget", "given")
    return leaves.join(given.withColumnRenamed("given", "budget"), list(LEVELS))


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def leaf_cuts(docs: DataFrame, budgets: DataFrame, seed: int) -> DataFrame:
    """For each leaf: whole_epochs, and of the next epoch the last key taken and the tokens before it."""
    plan = budgets.select(*LEVELS, F.expr("cast(budget div tokens as long)").alias("whole_epochs"), F.expr("cast(budget % tokens as long)").alias("rest"))
    keyed = docs.join(plan, list(LEVELS)).withColumn("key", order_key(seed, F.col("whole_epochs"), F.col("doc_id"))).withColumn("part", F.substring("key", 1, CUT))
    parts = keyed.where("rest > 0").groupBy(*LEVELS, "part", "rest").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("part")) - F.col("n")
    cut = parts.withColumn("part_before", before).where("part_before < rest and part_before + n >= rest").select(*LEVELS, "part", "part_before")
    inside = keyed.join(cut, [*LEVELS, "part"]).groupBy(*LEVELS, "part", "part_before", "rest", "key").agg(F.sum("n_tokens").alias("n"))
    before = F.col("part_before") + F.sum("n").over(Window.partitionBy(*LEVELS, "part").orderBy("key")) - F.col("n")
    last = inside.withColumn("before", before).where("before < rest").groupBy(*LEVELS).agg(F.max_by(F.struct(F.col("key").alias("last_key"), (F.col("rest") - F.col("before")).alias("last_tokens")), "key").alias("last"))
    return plan.join(last, list(LEVELS), "left").select(*LEVELS, "whole_epochs", "last.*")


def mix(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, Mapping[str, int]], *, tokens: Column | None = None, seed: int = 1, budget_percent: int = 60, max_epochs: int = 2) -> DataFrame:
    """The rows of docs that make up the mixture, once for each epoch in which they are taken.

    levels: a column of docs for each of domain, language and source; null and empty are one node.
    tokens: the number of tokens of a row (those of the column `text` if it is left out).
    Returns `row` (the input row), domain, language, source, epoch, n_tokens and take_tokens: all
    tokens of the row, or less where the leaf's budget ends. Rows without tokens are never taken.
    Rows of one doc_id have one place in the order and are cut alike. An empty table gives none.
    """
    names = {k: F.coalesce(levels[k].cast("string"), F.lit("")).alias(k) for k in LEVELS}
    rows = docs.select(F.struct("*").alias("row"), *names.values(), (count_tokens(F.col("text")) if tokens is None else tokens).alias("n_tokens")).where("n_tokens > 0")
    small = storage.materialize(rows.select("row.doc_id", *LEVELS, "n_tokens"), "mix")
    leaves = small.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    budgets = leaf_budgets(leaves, weights, budget_percent=budget_percent, max_epochs=max_epochs)
    # written first: Spark then knows their size, and broadcasts them or splits the rows of a hot leaf
    cuts = storage.materialize(leaf_cuts(small, budgets, seed), "cuts")
    # one row a leaf comes from the cuts: which rows are taken needs no order of the rows themselves
    taken = rows.join(cuts, list(LEVELS)).withColumn("key", order_key(seed, F.col("whole_epochs"), F.col("row.doc_id")))
    part = F.when(F.col("key") < F.col("last_key"), F.col("n_tokens")).when(F.col("key") == F.col("last_key"), F.least("n_tokens", "last_tokens"))
    whole = F.transform(F.sequence(F.lit(1), F.col("whole_epochs")), lambda i: F.struct((i - 1).alias("epoch"), F.col("n_tokens").alias("take")))
    whole = F.when(F.col("whole_epochs") > 0, whole).otherwise(F.array().cast("array<struct<epoch: bigint, take: bigint>>"))
    taken = taken.withColumn("part", part)
    last = F.when(F.col("part").isNotNull(), F.array(F.struct(F.col("whole_epochs").alias("epoch"), F.col("part").alias("take")))).otherwise(F.array().cast("array<struct<epoch: bigint, take: bigint>>"))
    taken = taken.select("row", *LEVELS, "n_tokens", F.explode(F.concat(whole, last)).alias("e"))
    return taken.select("row", *LEVELS, F.col("e.epoch").alias("epoch"), "n_tokens", F.col("e.take").alias("take_tokens"))

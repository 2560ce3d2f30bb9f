"""Checks of claims against their evidence, verdicts, coverage accounting and closure."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Verdicts, the worst first.
VERDICTS = ("contradicted", "insufficient", "supported")


def check_numbers(claim: Column, evidence: Column) -> Column:
    """supported if the evidence has every material number; else contradicted if it has any number, or insufficient."""
    wanted, given = T.material_numbers(claim), T.numbers(evidence)
    missing = F.size(F.array_except(wanted, given)) > 0
    return F.when(~missing, "supported").when(F.size(given) > 0, "contradicted").otherwise("insufficient")


def check_preserved(claim: Column, evidence: Column) -> Column:
    """contradicted if only one of both is negated, insufficient if only the claim has units."""
    return F.when(T.has_negation(claim) != T.has_negation(evidence), "contradicted").when(T.has_units(claim) & ~T.has_units(evidence), "insufficient").otherwise("supported")


def severity(verdict: Column) -> Column:
    found = F.lit(len(VERDICTS))
    for i, name in enumerate(VERDICTS):
        found = F.when(verdict == name, F.lit(i)).otherwise(found)
    return found


def worst_verdict(checks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """checks (keys, kind, verdict) -> the worst verdict, whether it is grounded, and the number of checks.
    A claim is supported only if all checks are, and a `grounding` check is among them. Reasons are in verdict_reasons()."""
    worst = checks.groupBy(*keys).agg(
        F.min(severity(F.col("verdict"))).alias("_s"),
        F.coalesce(F.bool_or((F.col("kind") == "grounding") & (F.col("verdict") == "supported")), F.lit(False)).alias("grounded"),
        F.count(F.lit(1)).alias("n_checks"),
    )
    names = F.array(*map(F.lit, VERDICTS))
    verdict = F.when((F.col("_s") >= 2) & ~F.col("grounded"), F.lit("insufficient")).otherwise(F.coalesce(F.get(names, F.col("_s")), F.lit("insufficient")))
    return worst.withColumn("verdict", verdict).drop("_s")


def verdict_reasons(checks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, reasons: the distinct reasons of the checks (keys, order, verdict, reason) that did not pass, in order."""
    failed = checks.where("verdict <> 'supported' and reason is not null").groupBy(*keys, "reason").agg(F.min("order").alias("order"))
    ordered = F.array_sort(F.collect_list(F.struct("order", "reason")))
    return failed.groupBy(*keys).agg(F.transform(ordered, lambda x: x["reason"]).alias("reasons"))


def closure_problems(claims: DataFrame, verdicts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, problem, ids): why verdicts (keys, claim, verdict, n_supporting) are no strict set for claims (keys, claim):
    missing and unknown claims, verdicts that are not supported, and ones without supporting evidence."""
    own = claims.select(*keys, "claim").distinct()
    parts = {
        "missing": own.join(verdicts.select(*keys, "claim"), [*keys, "claim"], "left_anti"),
        "unknown": verdicts.select(*keys, "claim").join(own, [*keys, "claim"], "left_anti"),
        "unresolved": verdicts.where("verdict <> 'supported'").select(*keys, "claim"),
        "ungrounded": verdicts.where("n_supporting = 0").select(*keys, "claim"),
    }
    found = None
    for name, part in parts.items():
        part = part.withColumn("problem", F.lit(name))
        found = part if found is None else found.unionByName(part)
    return found.groupBy(*keys, "problem").agg(F.array_sort(F.collect_set("claim")).alias("ids"))


def kept_examples(claims: DataFrame, verdicts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Claims (keys, topic, kind, claim) of examples that are not supported, in topics where a claim of another kind is."""
    judged = claims.join(verdicts.select(*keys, "claim", "verdict"), [*keys, "claim"], "left")
    sure = judged.where("kind <> 'example' and verdict = 'supported'").select(*keys, "topic").distinct()
    return judged.where("kind = 'example' and (verdict is null or verdict <> 'supported')").join(sure, [*keys, "topic"], "left_semi").drop("verdict")


def grounded_pages(strings: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, grounded: whether all non-empty strings (keys, text) of a page are among the known texts (keys, text)."""
    own = strings.where("trim(text) <> ''").join(known.select(*keys, "text").distinct().withColumn("_known", F.lit(True)), [*keys, "text"], "left")
    return own.groupBy(*keys).agg(F.every(F.col("_known").isNotNull()).alias("grounded"))


def step_order_faults(edges: DataFrame, times: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edges (keys, before_id, after_id) whose earlier step has its first evidence later; times: (keys, id, t)."""
    first = times.groupBy(*keys, "id").agg(F.min("t").alias("t"))
    a = first.withColumnsRenamed({"id": "before_id", "t": "before_t"})
    b = first.withColumnsRenamed({"id": "after_id", "t": "after_t"})
    return edges.join(a, [*keys, "before_id"]).join(b, [*keys, "after_id"]).where("before_t > after_t")


def missing_steps(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, missing: step numbers between the first and last that no row has."""
    own = steps.where("step is not null").groupBy(*keys).agg(F.collect_set("step").alias("seen"))
    missing = F.array_except(F.sequence(F.array_min("seen"), F.array_max("seen")), F.col("seen"))
    return own.select(*keys, F.array_sort(missing).alias("missing")).where(F.size("missing") > 0)


def coverage_report(claims: DataFrame, pages: DataFrame, omitted: DataFrame, verdicts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """claims (keys, claim_id) with `status`, the first that holds: on_body, on_summary, on_other,
    omitted (claim, or topic unless it is a capacity note), unsupported, missing.

    pages: (keys, page_type, claim_id); omitted: (keys, topic_id, claim_id, reason); verdicts: (keys, claim_id, verdict).
    """
    by_type = pages.groupBy(*keys, "claim_id").agg(F.collect_set("page_type").alias("types"))
    # one of two keys: as two equi-joins rather than an OR
    by_claim = omitted.where("claim_id is not null").groupBy(*keys, "claim_id").agg(F.min("reason").alias("_r1"))
    by_topic = omitted.where("claim_id is null and reason <> 'capacity'").groupBy(*keys, "topic_id").agg(F.min("reason").alias("_r2"))
    found = claims.join(by_type, [*keys, "claim_id"], "left").join(by_claim, [*keys, "claim_id"], "left").join(by_topic, [*keys, "topic_id"], "left").join(verdicts, [*keys, "claim_id"], "left")
    has = lambda t: F.coalesce(F.array_contains("types", t), F.lit(False))
    status = F.when(has("body"), "on_body").when(has("summary"), "on_summary").when(F.size(F.coalesce("types", F.array().cast("array<string>"))) > 0, "on_other")
    status = status.when(F.coalesce("_r1", "_r2").isNotNull(), "omitted").when(F.coalesce("verdict", F.lit("supported")) != "supported", "unsupported").otherwise("missing")
    return found.withColumn("status", status).drop("types", "_r1", "_r2")


def counts_by(rows: DataFrame, keys: Sequence[str], code: str) -> DataFrame:
    """keys, codes: `code=n` pairs in the order of the codes."""
    counted = rows.groupBy(*keys, code).agg(F.count(F.lit(1)).alias("n"))
    parts = F.array_sort(F.collect_list(F.concat(F.col(code), F.lit("="), F.col("n").cast("string"))))
    return counted.groupBy(*keys).agg(F.array_join(parts, ",").alias("codes"))


def constraint_faults(rows: DataFrame, id_columns: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """(id columns, rule) for each rule that a row does not meet; a null result counts as not met."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return rows.select(*id_columns, F.explode(failed).alias("rule"))


def references_by_type(pages: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, claim, content, summary, other): sorted pages (page, type, claim) of each type that name a known claim."""
    kind = F.when(F.col("type").isin("content", "summary"), F.col("type")).otherwise("other")
    rows = pages.withColumn("_t", kind).join(known.select(*keys, "claim").distinct(), [*keys, "claim"])
    return rows.groupBy(*keys, "claim").agg(*(F.array_sort(F.collect_list(F.when(F.col("_t") == t, F.col("page")))).alias(t) for t in ("content", "summary", "other")))


def topic_coverage(references: DataFrame, topics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, topic, body, summaries, missing) from references (claim, content, summary) and topics (claim, topic): claims of a
    topic on content pages, on summary pages, and whether none is on one. Only for keys that have a summary page."""
    rows = references.join(topics, [*keys, "claim"])
    has = rows.where(F.size("summary") > 0).select(*keys).distinct()
    on = lambda c: F.array_sort(F.collect_list(F.when(F.size(c) > 0, F.col("claim"))))
    found = rows.join(has, list(keys), "left_semi").groupBy(*keys, "topic").agg(on("content").alias("body"), on("summary").alias("summaries"))
    return found.where(F.size("body") > 0).withColumn("missing", F.size("summaries") == 0)

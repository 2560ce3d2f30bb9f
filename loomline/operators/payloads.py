"""Rows out of the answers of models: lists found where they may be, fields by their aliases, and why an item is refused.

Payloads are read as VARIANT, so that numbers, texts, lists and objects stay what they are in the JSON. An object's
values come in the order of its keys.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .steps import Steps, tasks_for

#: Where lists are, what fields are called, and what kinds and statuses there are.
UNITS, TOPICS = ("units", "knowledge_units", "knowledgeUnits", "items"), ("topics", "outline", "sections")
TITLE = ("title", "name", "heading", "topic")
GOAL = ("goal", "student_goal", "studentGoal", "learning_goal", "learning_objective", "objective", "teaching_goal", "teachingGoal", "purpose")
EVIDENCE = ("evidence_ids", "evidenceIds", "evidence", "citations", "sources")
START = ("start_seconds", "startSeconds", "start", "start_time", "begin_seconds")
END = ("end_seconds", "endSeconds", "end", "end_time", "finish_seconds")
SPAN = ("time_range", "timeRange", "range", "span")
KINDS = ("concept", "example", "procedure", "comparison", "warning", "recap")
KIND_ALIASES = {
    "definition": "concept", "fact": "concept", "explanation": "concept", "knowledge": "concept", "sample": "example", "instance": "example",
    "process": "procedure", "steps": "procedure", "step": "procedure", "contrast": "comparison", "versus": "comparison", "caution": "warning",
    "note": "warning", "review": "recap", "summary": "recap",
}
STATUSES = ("draft", "supported", "contradicted", "insufficient", "unresolved")
MODALITIES, PROVENANCES = ("audio", "visual", "both"), ("source", "generated-practice")
CLAIM = "struct<id: string, text: string, evidence_ids: array<string>, status: string, qualifiers: array<string>, modality: string, provenance: string>"


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_object(v: Column) -> Column:
    return F.coalesce(kind(v).startswith("OBJECT"), F.lit(False))


def is_list(v: Column) -> Column:
    return F.coalesce(kind(v).startswith("ARRAY"), F.lit(False))


def elements(v: Column) -> Column:
    return F.when(is_list(v), F.try_variant_get(v, "$", "array<variant>"))


def fields(v: Column) -> Column:
    """An object's values by name; null of anything else."""
    return F.when(is_object(v), F.try_variant_get(v, "$", "map<string, variant>"))


def field(values: Column, names: Sequence[str]) -> Column:
    """The first of the names that an object (its fields) has a value for, as a variant."""
    found = F.transform(F.array(*map(F.lit, names)), lambda n: F.try_element_at(values, n))
    return F.get(F.filter(found, lambda x: x.isNotNull() & ~F.is_variant_null(x)), F.lit(0))


def as_text(v: Column) -> Column:
    """A text that isn't blank, trimmed."""
    found = F.when(kind(v) == "STRING", T.strip(F.try_variant_get(v, "$", "string")))
    return F.when(found != "", found)


def as_identifier(v: Column) -> Column:
    """A text of 1 to 100 characters, or a whole number."""
    text = as_text(v)
    return F.when(F.length(text) <= 100, text).when((kind(v) == "BIGINT") | kind(v).rlike(r"^DECIMAL\(\d+,0\)$"), F.try_variant_get(v, "$", "string"))


def as_seconds(v: Column) -> Column:
    """A finite number or a text of one, not negative."""
    number = F.when(kind(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, "$", "double"))
    spelled = F.when(as_text(v).rlike(r"^\d+(?:\.\d+)?$"), as_text(v).try_cast("double"))
    return F.when((F.coalesce(number, spelled) >= 0) & (F.coalesce(number, spelled) < float("inf")), F.coalesce(number, spelled))


def as_ids(v: Column) -> Column:
    """Identifiers of a text, or of a list of texts, numbers and objects with an id; null of anything else."""

    def one(x: Column) -> Column:
        inner = F.coalesce(*(F.when(~F.coalesce(F.try_variant_get(x, f"$.{n}", "string"), F.lit("")).isin("", "0", "false"), F.try_variant_get(x, f"$.{n}", "variant")) for n in ("id", "evidence_id")))
        return F.when(is_object(x), as_identifier(inner)).otherwise(as_identifier(x))

    listed = F.filter(F.transform(elements(v), one), lambda x: x.isNotNull())
    return F.when(kind(v) == "STRING", F.array_compact(F.array(as_identifier(v)))).otherwise(listed)


def with_interval(rows: DataFrame, values: str, start: Column, end: Column) -> DataFrame:
    """rows with `time`, a struct (start, end) from fields or a span, a list or object; sides that are missing are the
    given ones. Null if empty. Step by step, so that a field is looked up once."""
    rows = rows.withColumns({"_s": field(F.col(values), START), "_e": field(F.col(values), END), "_span": field(F.col(values), SPAN)})
    rows = rows.withColumns({"_pair": F.when(F.size(elements(F.col("_span"))) >= 2, elements(F.col("_span"))), "_object": fields(F.col("_span"))})
    inner = {"_s": ("start_seconds", "startSeconds", "start", "begin"), "_e": ("end_seconds", "endSeconds", "end", "finish")}
    rows = rows.withColumns({f"{c}{c}": F.coalesce(F.get("_pair", F.lit(k)), field(F.col("_object"), names)) for k, (c, names) in enumerate(inner.items())})
    rows = rows.withColumns({c: F.coalesce(as_seconds(F.col(c)), as_seconds(F.col(f"{c}{c}"))) for c in inner})
    low, high = F.coalesce("_s", start), F.coalesce("_e", end)
    rows = rows.withColumn("time", F.when(low < high, F.struct(low.alias("start"), high.alias("end"))))
    return rows.drop("_s", "_e", "_span", "_pair", "_object", "_s_s", "_e_e")


def found_list(v: Column, names: Sequence[str], *, keyed: bool = False, bare: Sequence[str] = ()) -> Column:
    """The list that a payload is, or has under the first of the names that it has at all. If wanted, an object of objects
    is the list of its values (keyed), and an object with one of the fields `bare` is its own only item."""
    found = F.when(is_list(v), elements(v))
    for name in names:
        value = F.try_variant_get(v, f"$.{name}", "variant")
        own = elements(value)
        if keyed:
            values = F.map_values(F.try_variant_get(F.when(is_object(value), value), "$", "map<string, variant>"))
            own = F.coalesce(own, F.when((F.size(values) > 0) & F.forall(values, is_object), values))
        found = found.when(is_object(v) & value.isNotNull(), own)
    if bare:
        has = F.lit(False)
        for name in bare:
            has = has | F.try_variant_get(v, f"$.{name}", "variant").isNotNull()
        found = found.when(is_object(v) & has, F.array(v))
    return found


def _items(payloads: DataFrame, keys: Sequence[str], find: Callable[[Column], Column]) -> DataFrame:
    """payloads with (n, v, m) for each item from 1 and its fields, and `fault`; of a payload without a list one row that has
    only that. Few and small files may hold many payloads, so they are dealt out by their keys first, to a number of tasks
    that Spark doesn't lower: the bytes are few, the work on them is not."""
    tasks = 4 * payloads.sparkSession.sparkContext.defaultParallelism
    rows = payloads.repartition(tasks, *keys).withColumn("v", F.try_parse_json("payload")).withColumn("items", find(F.col("v")))
    rows = rows.withColumn("fault", F.when(F.col("v").isNull(), "not json").when(F.col("items").isNull(), "no list")).drop("v")
    rows = rows.select("*", F.posexplode_outer("items").alias("n", "v")).drop("items", "payload").where("n is not null or fault is not null")
    return rows.withColumns({"n": F.col("n") + 1, "m": fields(F.col("v"))})


def _settled(rows: DataFrame, keys: Sequence[str], reasons: Mapping[str, Column], columns: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Items are settled once and written: a filter on the reason would be pushed down to the JSON, with all the columns
    that it looks at worked out anew at each place where it names them."""
    reason = F.coalesce("fault", *(F.when(F.coalesce(c, F.lit(True)), F.lit(name)) for name, c in reasons.items()))
    done = Steps(rows.sparkSession, "payloads").write(rows.select(*keys, "n", reason.alias("_reason"), *(c.alias(name) for name, c in columns.items())))
    return done.where("_reason is null").drop("_reason"), done.where("_reason is not null").select(*keys, "n", F.col("_reason").alias("reason"))


def topics(payloads: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Topics of payloads (keys, payload, block_id, block_start, block_end), and (keys, n, reason) of what is refused.

    A topic: keys, n, id, title, goal, start, end, evidence_ids, speculative. n is the place of an item in its list, null of
    a payload that is no JSON or has no list; an item without title, goal or a time that is not empty is refused.
    """
    rows = _items(payloads, keys, lambda v: found_list(v, TOPICS))
    v, m = F.col("v"), F.col("m")
    rows = with_interval(rows, "m", F.col("block_start"), F.col("block_end"))
    rows = rows.withColumns({"title": field(m, TITLE), "goal": field(m, GOAL), "ids": field(m, EVIDENCE), "id": field(m, ("id", "topic_id", "topicId")), "flag": field(m, ("speculative", "is_speculative", "isSpeculative"))})
    rows = rows.withColumns({"title": F.when(is_object(v), as_text(F.col("title"))), "goal": as_text(F.col("goal")), "ids": F.coalesce(as_ids(F.col("ids")), F.array().cast("array<string>")), "id": as_identifier(F.col("id"))})
    named, flag = F.format_string("topic-%s-%02d", "block_id", "n"), F.col("flag")
    speculative = F.when(kind(flag) == "BOOLEAN", F.try_variant_get(flag, "$", "boolean")).when(F.size("ids") == 0, True)
    columns = {"id": F.substring(F.coalesce("id", named), 1, 100), "title": F.substring("title", 1, 160), "goal": F.substring("goal", 1, 400), "start": F.col("time.start"), "end": F.col("time.end"), "evidence_ids": F.col("ids"), "speculative": speculative}
    return _settled(rows, keys, {"not an object": ~is_object(v), "no title": F.col("title").isNull(), "no goal": F.col("goal").isNull(), "no time": F.col("time").isNull()}, columns)


CLAIM_FIELDS = {"ids": (*EVIDENCE, "evidence_id"), "status": ("status", "claim_status"), "qualifiers": ("qualifiers",), "text": ("text", "claim", "statement", "content"), "cid": ("id", "claim_id", "claimId"), "modality": ("modality",), "provenance": ("provenance",)}


def _claims(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, claims) of rows (keys, n, id, listed): claims with a text and evidence, their ids told apart by a suffix."""
    found = rows.select(*keys, "n", "id", F.posexplode("listed").alias("place", "c"))
    found = found.withColumn("m", fields(F.col("c")))
    found = found.withColumns({name: field(F.col("m"), names) for name, names in CLAIM_FIELDS.items()})
    texts = {x: as_text(F.col(x)) for x in ("text", "status", "modality", "provenance")}
    words = F.filter(F.transform(elements(F.col("qualifiers")), lambda q: F.try_variant_get(q, "$", "string")), lambda q: q.isNotNull() & ~q.isin("", "0", "false"))
    found = found.withColumns(texts | {"ids": as_ids(F.col("ids")), "cid": as_identifier(F.col("cid")), "qualifiers": F.slice(words, 1, 20), "status": F.lower(as_text(F.col("status")))})
    usable = F.col("text").isNotNull() & (F.size("ids") > 0)
    named = F.concat(F.substring("id", 1, 80), F.format_string("-c%02d", F.col("place") + 1))
    own = lambda x, allowed: F.when(F.col(x).isin(*allowed), F.col(x)).alias(x)
    made = F.struct(F.substring(F.coalesce("cid", named), 1, 100).alias("id"), F.substring("text", 1, 4000).alias("text"), F.slice("ids", 1, 20).alias("evidence_ids"), F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise("draft").alias("status"), "qualifiers", own("modality", MODALITIES), own("provenance", PROVENANCES)).cast(CLAIM)
    # claims without a text or evidence are left out of the list: a filter would look up all that it tests anew
    listed = found.groupBy(*keys, "n").agg(F.array_sort(F.collect_list(F.when(usable, F.struct("place", made.alias("c"))))).alias("listed"))

    def apart(done: Column, x: Column) -> Column:
        used = F.transform(done, lambda y: y["id"])
        suffixed = F.transform(F.sequence(F.lit(2), F.size(done) + 2), lambda k: F.concat(F.substr(x["id"], F.lit(1), 99 - F.length(k.cast("string"))), F.lit("-"), k.cast("string")))
        name = F.when(F.array_contains(used, x["id"]), F.get(F.filter(suffixed, lambda s: ~F.array_contains(used, s)), F.lit(0))).otherwise(x["id"])
        return F.concat(done, F.array(x.withField("id", name))).cast(f"array<{CLAIM}>")

    listed = listed.select(*keys, "n", F.when(F.size("listed") > 0, F.transform("listed", lambda x: x["c"])).alias("listed"))
    return listed.select(*keys, "n", F.aggregate("listed", F.array().cast(f"array<{CLAIM}>"), apart).alias("claims"))


def units(payloads: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Units of payloads (keys, payload, segment_id, topic_id, context_start, context_end), and (keys, n, reason) of what is refused.

    A unit: keys, n, id, topic_id, segment_ids, start, end, kind, claims. The list may be an object of objects, or the
    payload one unit. A claim needs a text and evidence; a unit needs a time that is not empty, a claim, a topic and a
    segment. keys tell the payloads apart.
    """
    rows = _items(payloads, keys, lambda v: found_list(v, UNITS, keyed=True, bare=("claims", "kind")))
    v, m = F.col("v"), F.col("m")
    rows = with_interval(rows, "m", F.coalesce("context_start", F.lit(0.0)), F.col("context_end"))
    rows = rows.withColumns({"id": field(m, ("id", "unit_id", "unitId")), "listed": field(m, ("claims",)), "ids": field(m, ("segment_ids", "segmentIds", "segment_id")), "topic": field(m, ("topic_id", "topicId")), "own": field(m, ("kind", "type", "unit_kind", "unitKind"))})
    named = F.when(F.coalesce("segment_id", F.lit("")) != "", F.format_string("unit-%s-%02d", "segment_id", "n")).otherwise(F.format_string("unit-%02d", "n"))
    given = T.strip(F.col("topic_id"))
    rows = rows.withColumns({"id": F.coalesce(as_identifier(F.col("id")), named), "listed": elements(F.col("listed")), "ids": as_ids(F.col("ids")), "topic": F.coalesce(as_identifier(F.col("topic")), F.when(F.length(given).between(1, 100), given)), "own": F.lower(as_text(F.col("own"))), "whole": is_object(v)}).drop("v", "m", "context_start", "context_end")
    # written, since both sides of the join read them, and the claims' filter would look up their lists anew
    rows = Steps(rows.sparkSession, "units").write(rows)
    rows = rows.repartition(tasks_for(rows, least=4), *keys, "n")
    rows = rows.join(_claims(rows, keys), [*keys, "n"], "left")
    segments = F.when(F.size("ids") > 0, F.slice("ids", 1, 20)).when(F.col("segment_id").isNotNull(), F.array("segment_id"))
    aliases = F.create_map(*(F.lit(x) for pair in KIND_ALIASES.items() for x in pair))
    columns = {"id": F.substring("id", 1, 100), "topic_id": F.col("topic"), "segment_ids": segments, "start": F.col("time.start"), "end": F.col("time.end"), "kind": F.when(F.col("own").isin(*KINDS), F.col("own")).otherwise(F.coalesce(F.try_element_at(aliases, "own"), F.lit("concept"))), "claims": F.col("claims")}
    reasons = {"not an object": ~F.col("whole"), "no time": F.col("time").isNull(), "no claims": F.col("listed").isNull(), "no usable claim": F.col("claims").isNull(), "no topic": F.col("topic").isNull(), "no segment": segments.isNull()}
    return _settled(rows, keys, reasons, columns)

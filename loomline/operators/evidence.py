"""Evidence of a timeline: captions, accepted frames and their text regions, and what cites them.

Captions are (keys, id, start, end, text), frames (keys, id, asset, requested, stamped, actual,
reject_reason), regions (keys, id, parent, text). Orders are given by columns, never by how rows lie.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals, joins

#: The lengths of a clip that may be asked for, the scenes of a rapid change and their mean length.
MIN_CLIP, MAX_CLIP = 5.0, 30.0
RAPID_SCENES, RAPID_SECONDS = 3, 3.0
#: Checks whose failure is critical.
CRITICAL = ("number", "negation", "condition", "proper_name", "translation", "step", "image_text", "contradiction", "unknown_ref", "grounding")


def occurrence_time() -> Column:
    """Where a frame was taken, else where it is stamped, else where it was asked for."""
    return F.coalesce("actual", "stamped", "requested")


def accepted(frames: DataFrame, assets: DataFrame) -> DataFrame:
    """Frames without a reason to reject them (an empty one is none) whose asset has the role frame, with their time `t`."""
    kept = frames.where(F.coalesce("reject_reason", F.lit("")) == "")
    return kept.join(assets.where("role = 'frame'").select("asset"), "asset", "left_semi").withColumn("t", occurrence_time())


def in_range(windows: DataFrame, captions: DataFrame, frames: DataFrame, regions: DataFrame, keys: Sequence[str], *, width: float) -> DataFrame:
    """windows (keys, window, start, end) -> (keys, window, id, n): captions that overlap it, accepted frames (with `t`)
    inside it, then regions of those frames; n counts from 1, by (start, id) within each of the three."""
    spans = captions.select(*keys, "id", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    own = joins.range_join(windows, spans, keys, width=width).select(*keys, "window", "id", F.col("r_start").alias("_at"), F.lit(0).alias("_kind"))
    inside = joins.point_join(frames.select(*keys, "id", "t"), windows, keys, width=width).select(*keys, "window", "id", F.col("t").alias("_at"), F.lit(1).alias("_kind"))
    texts = inside.withColumnRenamed("id", "parent").join(regions.select(*keys, "parent", "id"), [*keys, "parent"]).select(*keys, "window", "id", "_at", F.lit(2).alias("_kind"))
    found = own.unionByName(inside).unionByName(texts).dropDuplicates([*keys, "window", "id"])
    n = F.row_number().over(Window.partitionBy(*keys, "window").orderBy("_kind", "_at", "id"))
    return found.select(*keys, "window", "id", n.alias("n"))


def index(captions: DataFrame, regions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, id, text) of captions and regions, and of frames with the texts of their regions by id, joined by a space."""
    of_frames = regions.groupBy(*keys, F.col("parent").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]).alias("t"))
    own = captions.select(*keys, "id", "text").unionByName(regions.select(*keys, "id", "text"))
    return own.unionByName(of_frames.select(*keys, "id", F.trim(F.array_join("t", " ")).alias("text")))


def universe(*parts: DataFrame) -> DataFrame:
    """Distinct (keys, id) of all parts."""
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.distinct()


def gap_rows(spans: DataFrame, timelines: DataFrame, issues: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Gaps (keys, gap, start, end, reason): what no span covers, then issues (keys, order, reason, start, end) cut to
    the timeline; an issue without a range is one of the whole timeline, one outside it is none."""
    open_ = intervals.holes(spans, timelines, keys).select(*keys, F.lit(0).alias("_part"), F.col("start").alias("_at"), "start", "end", F.lit("uncovered").alias("reason"))
    cut = lambda c: F.greatest(F.lit(0.0), F.least("duration", c))
    ranged = F.col("start").isNotNull() & F.col("end").isNotNull() & (F.col("start") < F.col("end"))
    rows = issues.join(timelines, list(keys)).select(*keys, F.lit(1).alias("_part"), F.col("order").cast("double").alias("_at"), F.when(ranged, cut("start")).otherwise(F.lit(0.0)).alias("start"), F.when(ranged, cut("end")).otherwise(F.col("duration")).alias("end"), "reason")
    found = open_.unionByName(rows.where("start < end"))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("_part", "_at"))
    return found.select(*keys, F.format_string("gap-%04d", n).alias("gap"), "start", "end", "reason")


def clip_seconds(clips: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Summed lengths of clips; a missing end counts as 0, a negative length as none."""
    length = F.greatest(F.lit(0.0), F.coalesce("end", F.lit(0.0)) - F.coalesce("start", F.lit(0.0)))
    return clips.groupBy(*keys).agg(F.sum(length).alias("seconds"))


def rapid_changes(units: DataFrame, scenes: DataFrame, keys: Sequence[str], *, width: float, seconds: float = RAPID_SECONDS) -> DataFrame:
    """(keys, id) of units (start, end) that at least three scenes overlap, of a mean length under `seconds`."""
    spans = scenes.select(*keys, F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    met = joins.range_join(units, spans, keys, width=width).groupBy(*keys, "id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("r_end") - F.col("r_start")).alias("mean"))
    return met.where((F.col("n") >= RAPID_SCENES) & (F.col("mean") < seconds)).select(*keys, "id")


def refinement_gate(requests: DataFrame) -> DataFrame:
    """Requests with their range cut to the window and a `decision`.

    Reads start, end, modality, kind, rounds, max_rounds, duration, context_start, context_end, video,
    images, audio, frames_left, seconds_left; the budget is that before the request.
    """
    start, end = F.greatest("start", "context_start"), F.least("end", "context_end")
    length, mode = end - start, F.col("modality")
    decision = (
        F.when(F.col("rounds") >= F.col("max_rounds"), "round_limit")
        .when((F.col("start") < 0) | (F.col("end") > F.col("duration") + 1e-9) | (F.col("end") <= F.col("start")) | (end <= start), "out_of_range")
        .when((mode == "clip") & ~F.col("video"), "modality_not_allowed")
        .when((mode == "clip") & ((length < MIN_CLIP) | (length > MAX_CLIP)), "clip_duration")
        .when((mode == "clip") & (F.col("seconds_left") < length), "budget_exhausted")
        .when((mode == "frame") & ~F.col("images"), "modality_not_allowed")
        .when((mode == "audio") & ~F.col("audio"), "modality_not_allowed")
        .when((mode == "frame") & (F.col("frames_left") <= 0), "budget_exhausted")
        .otherwise("accepted")
    )
    inside = ~decision.isin("round_limit", "out_of_range")
    return requests.withColumn("decision", decision).withColumn("cut_start", F.when(inside, start).otherwise(F.col("start"))).withColumn("cut_end", F.when(inside, end).otherwise(F.col("end")))


def aligned_citations(citations: DataFrame, captions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Citations (keys, start, end of the unit, id) without captions that do not overlap their unit; other ids pass."""
    spans = captions.select(*keys, "id", F.col("start").alias("_s"), F.col("end").alias("_e"))
    return citations.join(spans, [*keys, "id"], "left").where(F.col("_s").isNull() | ((F.col("_e") > F.col("start")) & (F.col("_s") < F.col("end")))).drop("_s", "_e")


def page_excerpts(pages: DataFrame, citations: DataFrame, captions: DataFrame, keys: Sequence[str], *, seconds: float = 30.0, most: int = 6, width: float = 60.0) -> DataFrame:
    """(keys, page, n, text): the first `most` captions that a page cites, in the order of its citations (page, order,
    id); of a page that cites none, those in the `seconds` after its `start`."""
    cited = citations.join(captions.select(*keys, "id", "text"), [*keys, "id"]).select(*keys, "page", F.col("order").cast("double").alias("_at"), F.col("id").alias("_id"), "text")
    bare = pages.where("start is not null").join(cited.select(*keys, "page").distinct(), [*keys, "page"], "left_anti")
    spans = captions.select(*keys, F.col("id").alias("_id"), F.col("start").alias("r_start"), F.col("end").alias("r_end"), "text")
    near = joins.range_join(bare.withColumn("end", F.col("start") + seconds), spans, keys, width=width).select(*keys, "page", F.col("r_start").alias("_at"), "_id", "text")
    n = F.row_number().over(Window.partitionBy(*keys, "page").orderBy("_at", "_id"))
    return cited.unionByName(near).withColumn("n", n).where(F.col("n") <= most).select(*keys, "page", "n", "text")


def allowed_frames(page_frames: DataFrame, page_claims: DataFrame, citations: DataFrame, frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct (keys, page, id): accepted frames that a page shows, or that a claim (keys, claim, id) of it cites."""
    cited = page_claims.join(citations, [*keys, "claim"]).select(*keys, "page", "id")
    return page_frames.select(*keys, "page", "id").unionByName(cited).join(frames.select(*keys, "id"), [*keys, "id"], "left_semi").distinct()


def with_parents(cited: DataFrame, regions: DataFrame, frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct frames (keys, id) that are cited, or whose regions are ("ev-" before an id is left out)."""
    bare = cited.select(*keys, F.regexp_replace("id", "^ev-", "").alias("id"))
    parents = regions.join(bare, [*keys, "id"], "left_semi").select(*keys, F.col("parent").alias("id"))
    return frames.select(*keys, "id").join(bare.unionByName(parents), [*keys, "id"], "left_semi").distinct()


def page_citations(page_claims: DataFrame, citations: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, page, cited): sorted distinct known ids that the claims of a page cite."""
    found = page_claims.join(citations, [*keys, "claim"]).join(known, [*keys, "id"], "left_semi")
    return found.groupBy(*keys, "page").agg(F.array_sort(F.collect_set("id")).alias("cited"))


def merged_catalogue(seen: DataFrame, pulled: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows seen, and the first of the pulled ones of each id that is not among them."""
    first = F.row_number().over(Window.partitionBy(*keys, "id").orderBy(order))
    new = pulled.withColumn("_n", first).where("_n = 1").drop("_n").join(seen.select(*keys, "id"), [*keys, "id"], "left_anti")
    return seen.unionByName(new)


def labelled_gaps(parts: Mapping[str, DataFrame]) -> DataFrame:
    """Gaps of several modalities with their `modality`."""
    found = None
    for name, part in parts.items():
        part = part.withColumn("modality", F.lit(name))
        found = part if found is None else found.unionByName(part)
    return found


def page_seek(pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, seek) of pages (type, time): the least time; of a summary page only if all its times are one."""
    w = pages.groupBy(*keys).agg(F.min("type").alias("_type"), F.min("time").alias("_t"), F.count_distinct("time").alias("_n"))
    return w.select(*keys, F.when((F.col("_type") != "summary") | (F.col("_n") == 1), F.col("_t")).alias("seek"))


def quality_status(mode: Column, labels: Column) -> Column:
    """Status of a deck from its mode and the distinct labels of its pages."""
    verified = F.size(F.array_except(labels, F.array(F.lit("verified")))) == 0
    only = F.array_contains(labels, "evidence-only")
    return F.when(mode == "evidence-only", "evidence-only").when(only, "evidence-only").when(verified, "verified").otherwise("review_required")


def is_critical(provenance: Column, checks: Column) -> Column:
    """Whether a claim from the source failed a critical check (array of struct kind, passed)."""
    return (provenance == "source") & F.exists(checks, lambda c: ~c["passed"] & c["kind"].isin(*CRITICAL))


def sample_kinds(text: Column, provenance: Column, checks: Column) -> Column:
    """Kinds of checks of a claim that a person should look at, in order, each once."""
    kinds = ("step", "translation", "image_text", "contradiction", "unknown_ref")
    failed = F.filter(checks, lambda c: c["kind"].isin(*kinds) & (~c["passed"] | (c["kind"] == "step")))
    number = F.when(text.rlike(r"(?U)\d"), F.array(F.lit("number"))).otherwise(F.array().cast("array<string>"))
    practice = F.when(provenance == "generated-practice", F.array(F.lit("generated_practice"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(F.lit("grounding")), number, practice, F.transform(failed, lambda c: c["kind"])))

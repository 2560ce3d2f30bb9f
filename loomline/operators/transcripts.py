"""Transcripts: recognised speech cut to the recording, and captions corrected by what the screen shows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import intervals, joins

WORDS = "array<struct<word: string, start: double, end: double>>"


def clip_recognised(segments: DataFrame, durations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Segments (start, end, words array<struct<word, start, end>>) cut to the duration of their key (durations: keys, duration).

    A segment that begins at or after the end, or is empty once cut, is left out. Words are cut to their segment; one that
    lies outside of it goes, and `cut` says that a word went or was cut. Segments of a key without duration are left out.
    """
    end = F.least("end", "duration")
    rows = segments.join(durations.select(*keys, "duration"), list(keys)).where(F.col("start") < end)

    def inside(w: Column) -> Column:
        return F.struct(w["word"].alias("word"), F.greatest("start", w["start"]).alias("start"), F.least(end, w["end"]).alias("end"))

    words = F.coalesce("words", F.array().cast(WORDS))
    kept = F.filter(F.transform(words, inside), lambda w: w["start"] < w["end"]).cast(WORDS)
    cut = F.exists(words, lambda w: (w["start"] < F.col("start")) | (w["end"] > end) | ~(F.greatest("start", w["start"]) < F.least(end, w["end"])))
    return rows.select(*(c for c in segments.columns if c not in ("end", "words")), end.alias("end"), kept.alias("words"), cut.alias("cut"))


def recognised_coverage(clipped: DataFrame, durations: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Of chunks that may overlap: (keys, duration, covered) in seconds, and the stretches (keys, start, end) without speech."""
    spans = clipped.select(*keys, "start", "end")
    return intervals.covered_seconds(spans, durations, list(keys)), intervals.holes(spans, durations, list(keys))


def _matches(text: Column, variants: Column, form: Column, rank: Column) -> Column:
    """(rank, longer first, at, size, form) of each place of each variant in a text."""
    kind = "array<struct<rank: bigint, back: int, at: int, size: int, form: string>>"

    def places(v: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - F.length(v) + 1)), lambda i: (F.length(v) > 0) & (F.substr(text, i, F.length(v)) == v))
        return F.transform(starts, lambda i: F.struct(rank.cast("long").alias("rank"), (-F.length(v)).alias("back"), i.cast("int").alias("at"), F.length(v).alias("size"), form.alias("form")))

    return F.flatten(F.transform(variants, places)).cast(kind)


def correct_by_headwords(captions: DataFrame, headwords: DataFrame, rules: DataFrame, keys: Sequence[str], *, window: float = 45.0) -> DataFrame:
    """Captions (keys, id, start, end, text) whose text has misheard forms of words shown near them.

    headwords: keys, ord, canonical, center: a word on the screen at a time; it is near a caption that overlaps the
    `window` seconds around it. rules: canonical, variants: what is heard for it. Headwords are taken by ord, the variants
    of one from the longest on, each from the left; a range of characters that one has claimed is not replaced again, and
    what is put in is not searched. Returns the corrected captions: keys, id, before, text and forms (the canonical of
    each replaced range, from the left). A caption with nothing to correct, or without text, has no row.
    """
    half = max(1.0, window / 2)
    shown = headwords.join(rules.select("canonical", "variants"), "canonical").select(*keys, "ord", "canonical", "variants", (F.col("center") - half).alias("r_start"), (F.col("center") + half).alias("r_end"))
    near = joins.range_join(captions.select(*keys, "id", "start", "end", "text"), shown, keys, width=max(60.0, window))
    found = near.select(*keys, "id", "text", _matches(F.col("text"), F.col("variants"), F.col("canonical"), F.col("ord")).alias("m")).where(F.size("m") > 0)
    by_caption = found.groupBy(*keys, "id", "text").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("m")))).alias("m"))
    kind = by_caption.schema["m"].dataType.simpleString()

    def claim(claimed: Column, x: Column) -> Column:
        taken = F.exists(claimed, lambda y: (y["at"] < x["at"] + x["size"]) & (x["at"] < y["at"] + y["size"]))
        return F.when(taken, claimed).otherwise(F.concat(claimed, F.array(x))).cast(kind)

    claims = F.aggregate("m", F.array().cast(kind), claim)
    ordered = F.array_sort(F.transform(claims, lambda x: F.struct(x["at"].alias("at"), x["size"].alias("size"), x["form"].alias("form"))))
    done = by_caption.select(*keys, "id", "text", ordered.alias("claims"))

    def put(acc: Column, x: Column) -> Column:
        between = F.substr(F.col("text"), acc["at"], x["at"] - acc["at"])
        return F.struct(F.concat(acc["out"], between, x["form"]).alias("out"), (x["at"] + x["size"]).cast("int").alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    text = F.aggregate("claims", start, put, lambda acc: F.concat(acc["out"], F.substr(F.col("text"), acc["at"], F.length("text"))))
    return done.select(*keys, "id", F.col("text").alias("before"), text.alias("text"), F.transform("claims", lambda x: x["form"]).alias("forms")).where("text <> before")

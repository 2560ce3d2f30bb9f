"""Half-open intervals [start, end) by key: union, holes, cover, partition, clips and time bases.

Inputs have the key columns and `start`, `end` (seconds, double). Windows are by key, so a timeline
is sorted in one task; timelines of different keys are independent.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .steps import Steps

TILING, COVERAGE = 1e-9, 1e-6


def usable(spans: DataFrame) -> DataFrame:
    """Intervals that are finite, not negative and not empty; NaN never joins."""
    finite = [~F.isnan(c) & (F.col(c) < float("inf")) for c in ("start", "end")]
    return spans.where(finite[0] & finite[1] & (F.col("start") >= 0) & (F.col("start") < F.col("end")))


def _reach(keys: Sequence[str]) -> Column:
    """The largest end of the rows before, by (start, end)."""
    before = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    return F.max("end").over(before)


def merged(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union: touching intervals become one; empty and reversed ones are left out."""
    ordered = Window.partitionBy(*keys).orderBy("start", "end")
    begins = spans.where("start < end").withColumn("_new", F.coalesce((F.col("start") > _reach(keys)).cast("int"), F.lit(1)))
    islands = begins.withColumn("_island", F.sum("_new").over(ordered))
    return islands.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def clipped(spans: DataFrame, duration: Column) -> DataFrame:
    """Intervals cut to [0, duration)."""
    cut = spans.withColumn("start", F.greatest("start", F.lit(0.0))).withColumn("end", F.least("end", duration))
    return cut.where("start < end")


def holes(spans: DataFrame, durations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What the union leaves of [0, duration): durations has the keys and `duration`; 0 or less has no holes."""
    whole = durations.where("duration > 0").select(*keys, "duration")
    islands = merged(clipped(spans.join(whole, list(keys)), F.col("duration")).select(*keys, "start", "end"), keys)
    marks = islands.unionByName(whole.select(*keys, F.lit(0.0).alias("start"), F.lit(0.0).alias("end")))
    marks = marks.unionByName(whole.select(*keys, F.col("duration").alias("start"), F.col("duration").alias("end")))
    ordered = Window.partitionBy(*keys).orderBy("start", "end")
    gaps = marks.select(*keys, F.max("end").over(ordered).alias("start"), F.lead("start").over(ordered).alias("end"))
    return gaps.where("start < end")


def covered_seconds(spans: DataFrame, durations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, duration, covered (the duration less its holes) and ratio (0 where the duration is 0)."""
    open_seconds = holes(spans, durations, keys).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("_open"))
    found = durations.select(*keys, "duration").join(open_seconds, list(keys), "left")
    covered = F.greatest(F.col("duration") - F.coalesce("_open", F.lit(0.0)), F.lit(0.0))
    found = found.withColumn("covered", covered)
    return found.withColumn("ratio", F.when(F.col("duration") > 0, F.col("covered") / F.col("duration")).otherwise(F.lit(0.0))).drop("_open")


def overlap_flags(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """spans with `overlaps`: whether any other interval of the key strictly overlaps the row's."""
    ordered = Window.partitionBy(*keys).orderBy("start", "end")
    found = F.coalesce(_reach(keys) > F.col("start"), F.lit(False)) | F.coalesce(F.lead("start").over(ordered) < F.col("end"), F.lit(False))
    return spans.withColumn("overlaps", found)


def partition_ranges(spans: DataFrame, durations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A partition of [0, duration) without gaps: ranges are clipped, contained ones dropped, overlaps
    trimmed, fillers put in, and all numbered (`n` from 1, `filler`)."""
    whole = durations.where("duration > 0").select(*keys, "duration")
    inside = clipped(spans.join(whole, list(keys)), F.col("duration")).select(*keys, "start", "end")
    cursor = F.coalesce(_reach(keys), F.lit(0.0))
    trimmed = inside.select(*keys, F.greatest("start", cursor).alias("start"), "end", F.lit(False).alias("filler")).where("start < end")
    fillers = holes(inside, whole, keys).select(*keys, "start", "end", F.lit(True).alias("filler"))
    ordered = Window.partitionBy(*keys).orderBy("start")
    return trimmed.unionByName(fillers).withColumn("n", F.row_number().over(ordered))


def tiling_faults(windows: DataFrame, durations: DataFrame, keys: Sequence[str], tolerance: float = TILING) -> DataFrame:
    """One row for each place where windows fail to tile [0, duration): overlap, gap, first or last."""
    ordered = Window.partitionBy(*keys).orderBy("start", "end")
    before, after = F.lag("end").over(ordered), F.lead("start").over(ordered)
    rows = windows.join(durations.select(*keys, "duration"), list(keys)).withColumn("_before", before).withColumn("_after", after)
    fault = (
        F.when(F.col("_before").isNull() & (F.abs("start") > tolerance), "first")
        .when(F.col("_before") - F.col("start") > tolerance, "overlap")
        .when(F.col("start") - F.col("_before") > tolerance, "gap")
        .when(F.col("_after").isNull() & (F.abs(F.col("end") - F.col("duration")) > tolerance), "last")
    )
    return rows.select(*keys, "start", "end", fault.alias("fault")).where("fault is not null")


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_end > b_start) & (b_end > a_start)


def overlap_seconds(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def overlap_ratio(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Overlap by the shorter interval."""
    shorter = F.greatest(F.least(a_end - a_start, b_end - b_start), F.lit(COVERAGE))
    return overlap_seconds(a_start, a_end, b_start, b_end) / shorter


def ranges_conflict(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """(start, end, title) of two topics: titles differ and the span is the same or half of the shorter is shared."""
    same = (a[0] == b[0]) & (a[1] == b[1])
    shorter = F.least(a[1] - a[0], b[1] - b[0])
    return (a[2] != b[2]) & (same | ((shorter > 0) & (overlap_seconds(a[0], a[1], b[0], b[1]) >= shorter / 2)))


def minimal_clip(start: Column, end: Column, low: Column, high: Column, least: float = 5.0, most: float = 30.0) -> Column:
    """Struct (start, end): the interval clamped to [low, high), widened to `least` and cut to `most` around its middle."""
    s, e = F.greatest(start, low), F.least(end, high)
    short, long = e - s < least, e - s > most
    middle = (s + e) / 2
    wide_s = F.greatest(low, F.least(middle - least / 2, high - least))
    s2 = F.when(short, wide_s).when(long, middle - most / 2).otherwise(s)
    e2 = F.when(short, F.least(high, wide_s + least)).when(long, middle + most / 2).otherwise(e)
    return F.when(s < e, F.struct(s2.alias("start"), e2.alias("end")))


def out_of_bounds(rows: DataFrame, start: str, end: str | None, duration: str) -> DataFrame:
    """Points outside [0, duration), or ranges that are reversed, empty or outside."""
    s, d = F.col(start), F.col(duration)
    bad = (s < 0) | (s >= d) if end is None else (s < 0) | (F.col(end) <= s) | (F.col(end) > d)
    return rows.where(bad | F.isnan(s))


def source_maps(spark: SparkSession, clips: DataFrame) -> DataFrame:
    """clips (id, parent, offset, speed) -> (id, scale, shift): source time = scale * local + shift.

    A clip's time is offset + speed * local in its parent, up to the root (parent null). Each step joins every map with
    that of where it has got to, so chains of n clips take log2(n) steps. A clip whose parent is missing has no map; nor
    have clips in a cycle.
    """
    steps = Steps(spark, "maps")
    now = steps.write(clips.select("id", F.col("parent").alias("up"), F.col("speed").cast("double").alias("scale"), F.col("offset").cast("double").alias("shift")))
    count = now.count()
    while count and not now.where("up is not null").isEmpty():
        above = now.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("scale").alias("_scale"), F.col("shift").alias("_shift"))
        moved = now.where("up is not null").join(above, "up").select("id", F.col("_up").alias("up"), (F.col("_scale") * F.col("scale")).alias("scale"), (F.col("_scale") * F.col("shift") + F.col("_shift")).alias("shift"))
        now = steps.write(now.where("up is null").unionByName(moved))
        # chains twice as long each time: what is not at a root by then goes in a circle
        count //= 2
    return now.where("up is null").select("id", "scale", "shift")


def inverse_map(local: Column, scale: Column, shift: Column) -> Column:
    """Local time of a source time; null for a map without length."""
    return F.try_divide(local - shift, scale)


def mapped_range(start: Column, end: Column, scale: Column, shift: Column) -> Column:
    """A local range in source time."""
    return F.struct((start * scale + shift).alias("start"), (end * scale + shift).alias("end"))

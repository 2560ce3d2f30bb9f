"""Range, band, best-overlap and adjacency joins, and reference closure.

Range joins are dealt by time buckets: an interval goes to each bucket that it touches, and a pair
is kept in the bucket where the later of the two begins, so it comes out once and no key's timeline
has to meet in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Widths in a bucket of a point join: spans of two widths come to 1.25 copies instead of 3, for some more pairs that are tried.
COARSE = 8


def _buckets(start: Column, end: Column, width: float, closed: bool = False) -> Column:
    last = F.floor(end / width)
    if not closed:
        # a half-open interval that ends on a bucket's border does not touch it
        last = F.when((end / width == last) & (last > F.floor(start / width)), last - 1).otherwise(last)
    return F.explode(F.sequence(F.floor(start / width), last))


def range_join(left: DataFrame, right: DataFrame, keys: Sequence[str], *, width: float) -> DataFrame:
    """Pairs of left (start, end) and right (r_start, r_end) of one key that strictly overlap. Intervals that are
    empty or not finite overlap nothing. width: seconds of a bucket, of the size of the intervals: an interval is in each that it touches."""
    finite = lambda a, b: (F.col(a) > float("-inf")) & (F.col(b) < float("inf")) & (F.col(a) < F.col(b))
    a = left.where(finite("start", "end")).withColumn("_b", _buckets(F.col("start"), F.col("end"), width))
    b = right.where(finite("r_start", "r_end")).withColumn("_b", _buckets(F.col("r_start"), F.col("r_end"), width))
    own = F.floor(F.greatest("start", "r_start") / width) == F.col("_b")
    return a.join(b, [*keys, "_b"]).where(own & (F.col("end") > F.col("r_start")) & (F.col("r_end") > F.col("start"))).drop("_b")


def point_join(points: DataFrame, spans: DataFrame, keys: Sequence[str], *, width: float) -> DataFrame:
    """Points `t` with the spans (start, end) of the key with start <= t < end."""
    # a span of about a width is copied to the fewer buckets, the wider they are
    width = COARSE * width
    a = points.withColumn("_b", F.floor(F.col("t") / width))
    b = spans.where("start < end").withColumn("_b", _buckets(F.col("start"), F.col("end"), width))
    return a.join(b, [*keys, "_b"]).where("start <= t and t < end").drop("_b")


def band_join(points: DataFrame, spans: DataFrame, keys: Sequence[str], *, reach: float) -> DataFrame:
    """Points `t` with the spans that come within `reach` seconds, ends included."""
    width = max(reach, 1.0) * 4
    a = points.withColumn("_b", F.floor(F.col("t") / width))
    b = spans.withColumn("_b", _buckets(F.col("start") - reach, F.col("end") + reach, width, closed=True))
    return a.join(b, [*keys, "_b"]).where((F.col("t") >= F.col("start") - reach) & (F.col("t") <= F.col("end") + reach)).drop("_b")


def best_overlap(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, right_id: str, *, width: float) -> DataFrame:
    """left with the right_id that it overlaps longest (then earliest, then least id); where there is
    none the key's first one by (r_start, r_end, right_id)."""
    pairs = range_join(left.select(*keys, left_id, "start", "end"), right, keys, width=width)
    seconds = F.least("end", "r_end") - F.greatest("start", "r_start")
    best = pairs.groupBy(*keys, left_id).agg(F.min_by(right_id, F.struct(-seconds, "r_start", right_id)).alias("_best"))
    first = right.groupBy(*keys).agg(F.min_by(right_id, F.struct("r_start", "r_end", right_id)).alias("_first"))
    found = left.join(best, [*keys, left_id], "left").join(first, list(keys), "left")
    return found.withColumn(right_id, F.coalesce("_best", "_first")).drop("_best", "_first")


def neighbours(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """rows with `previous` and `following`: the value of the rows beside it in the stated order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("previous", F.lag(value).over(w)).withColumn("following", F.lead(value).over(w))


def missing_references(rules: Mapping[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """(rule, reference, n): references of each rule's rows that its target lacks. Null refers to nothing.

    rules: name -> (rows, column, target, target's column). Empty if all references are closed.
    """
    found = None
    for name, (rows, column, target, key) in rules.items():
        wanted = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("reference")).agg(F.count(F.lit(1)).alias("n"))
        known = target.select(F.col(key).cast("string").alias("reference")).distinct()
        own = wanted.join(known, "reference", "left_anti").select(F.lit(name).alias("rule"), "reference", "n")
        found = own if found is None else found.unionByName(own)
    return found


def unequal_references(rules: Mapping[str, tuple[DataFrame, str, DataFrame, str, Mapping[str, str]]]) -> DataFrame:
    """(rule, reference, field, n): what rows state of a row that they refer to, other than it says itself.

    rules: name -> (rows, column, target, target's column, field of rows -> field of target): a source, a duration, a
    hash. Nulls are equal to nulls only. References without a target are those of missing_references(). A target with
    several rows of a key agrees if one of them does.
    """
    found = None
    for name, (rows, column, target, key, fields) in rules.items():
        for field, own in fields.items():
            stated = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("reference"), F.col(field).cast("string").alias("stated")).agg(F.count(F.lit(1)).alias("n"))
            known = target.select(F.col(key).cast("string").alias("reference"), F.col(own).cast("string").alias("known")).distinct()
            there = stated.join(known.select("reference").distinct(), "reference", "left_semi")
            same = (there["reference"] == known["reference"]) & there["stated"].eqNullSafe(known["known"])
            other = there.join(known, same, "left_anti").groupBy("reference").agg(F.sum("n").alias("n"))
            part = other.select(F.lit(name).alias("rule"), "reference", F.lit(field).alias("field"), "n")
            found = part if found is None else found.unionByName(part)
    return found


def set_differences(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one of both has: `missing` from found, or `unexpected` in it."""
    a, b = expected.select(key).distinct(), found.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("unexpected")))


def ordered_text(rows: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, separator: str = " ") -> DataFrame:
    """keys with `joined`: the texts in the stated order."""
    parts = F.array_sort(F.collect_list(F.struct(*order, text)))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x[text]), separator).alias("joined"))

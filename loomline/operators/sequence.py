"""Sequences: sessions, chunks, numbering, sampling, tiling, packing and caption folds."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .steps import Steps

#: The lengths of a core, and the text that ends a sentence.
CORE_SECONDS, MAX_CORE_SECONDS, CONTEXT_SECONDS = 120.0, 180.0, 10.0
SENTENCE_END = r"""[.!?。！？]["'”’)\]]*\s*$"""


def sessions(rows: DataFrame, keys: Sequence[str], order: Sequence[str], *, gap: float, most: int) -> DataFrame:
    """rows (start, end) with `session` and `part`: a new session where the gap to the row before is
    over `gap`; each is cut into parts of `most` rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.coalesce((F.col("start") - F.lag("end").over(w) > gap).cast("int"), F.lit(0))
    found = rows.withColumn("_new", new).withColumn("session", F.sum("_new").over(w)).drop("_new")
    inside = Window.partitionBy(*keys, "session").orderBy(*order)
    return found.withColumn("part", F.floor((F.row_number().over(inside) - 1) / most))


def chunks(rows: DataFrame, keys: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """rows with `batch`: every `size` rows of a key, from 0."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], prefix: str) -> DataFrame:
    """rows with `label`: prefix-0001 and so on by key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("label", F.format_string(f"{prefix}-%04d", F.row_number().over(w)))


def sentence_boundaries(captions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct ends of captions (text, end) that end a sentence."""
    return captions.where(F.col("text").rlike("(?U)" + SENTENCE_END)).select(*keys, F.col("end").alias("boundary")).distinct()


def choose_cut(cursor: Column, duration: Column, boundaries: Column, core: float = CORE_SECONDS, most: float = MAX_CORE_SECONDS) -> Column:
    """End of the core that begins at cursor: all that is left if it fits, else the last boundary by
    the target, else the first one by the limit, else the limit."""
    target, limit = F.least(duration, cursor + core), F.least(duration, cursor + most)
    inside = F.filter(boundaries, lambda b: (b > cursor + 1e-6) & (b <= limit + 1e-9))
    early = F.array_max(F.filter(inside, lambda b: b <= target + 1e-9))
    late = F.array_min(F.filter(inside, lambda b: b > target))
    return F.when((F.abs(limit - duration) < 1e-9) | (target >= duration), duration).otherwise(F.coalesce(early, late, limit))


def tile(timelines: DataFrame, key: str, *, core: float = CORE_SECONDS, most: float = MAX_CORE_SECONDS, context: float = CONTEXT_SECONDS) -> DataFrame:
    """timelines (key, duration, boundaries array<double>) -> cores that tile [0, duration).

    Returns key, n (from 1), core_start, core_end, context_start, context_end. Two cuts always advance
    by more than `core`, as the last boundary before it was taken by the first one: the fold inside one
    row has twice as many steps as cores of that length.
    """
    steps = F.sequence(F.lit(1), (2 * F.ceil(F.col("duration") / F.lit(core)) + 2).cast("int"))
    start = F.struct(F.lit(0.0).alias("cursor"), F.array().cast("array<struct<s: double, e: double>>").alias("out"))

    def step(acc: Column, _: Column) -> Column:
        cut = choose_cut(acc["cursor"], F.col("duration"), F.col("boundaries"), core, most)
        grown = F.struct(cut.alias("cursor"), F.concat(acc["out"], F.array(F.struct(acc["cursor"].alias("s"), cut.alias("e")))).alias("out"))
        return F.when(acc["cursor"] < F.col("duration"), grown).otherwise(acc)

    cores = timelines.where("duration > 0").select(key, "duration", F.aggregate(steps, start, step, lambda acc: acc["out"]).alias("cores"))
    cores = cores.select(key, "duration", F.posexplode("cores").alias("n", "c"))
    return cores.select(key, (F.col("n") + 1).alias("n"), F.col("c.s").alias("core_start"), F.col("c.e").alias("core_end"), F.greatest(F.col("c.s") - context, F.lit(0.0)).alias("context_start"), F.least(F.col("c.e") + context, F.col("duration")).alias("context_end"))


def halves(windows: DataFrame, least: float = 4.0) -> DataFrame:
    """Windows (start, end) of at least `least` seconds as two rows cut in the middle, with `half`."""
    middle = (F.col("start") + F.col("end")) / 2
    parts = F.array(F.struct(F.lit(0).alias("half"), F.col("start").alias("s"), middle.alias("e")), F.struct(F.lit(1).alias("half"), middle.alias("s"), F.col("end").alias("e")))
    rest = [c for c in windows.columns if c not in ("start", "end")]
    return windows.where(F.col("end") - F.col("start") >= least).select(*rest, F.explode(parts).alias("p")).select(*rest, F.col("p.half").alias("half"), F.col("p.s").alias("start"), F.col("p.e").alias("end"))


def sample_times(scenes: DataFrame, keys: Sequence[str], *, every: float = 30.0) -> DataFrame:
    """Times to sample of scenes (start, end): at 20, 50 and 80 % (50 % below one second), and every
    `every` seconds; inside the scene, to six digits, distinct."""
    length = F.col("end") - F.col("start")
    shares = F.when(length < 1.0, F.array(F.lit(0.5))).otherwise(F.array(*map(F.lit, (0.2, 0.5, 0.8))))
    steps = F.when(length > every, F.transform(F.sequence(F.lit(1), F.floor(length / every).cast("int")), lambda i: i * F.lit(every))).otherwise(F.array().cast("array<double>"))
    offsets = F.concat(F.transform(shares, lambda x: x * length), F.filter(steps, lambda x: x < length))
    return scenes.where("start < end").select(*keys, F.explode(F.array_distinct(F.transform(offsets, lambda x: F.round(F.col("start") + x, 6)))).alias("t"))


def pack(rows: DataFrame, keys: Sequence[str], order: Sequence[str], size: str, limit: int) -> DataFrame:
    """keys, block, first, last, total: greedy packing in order. A block ends before it would pass the
    limit; a row over the limit is a block by itself. The state of a key is one row's array."""
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(size).cast("long").alias("_size"))))
    start = F.struct(F.array().cast("array<struct<n: bigint, total: bigint>>").alias("out"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("total"))

    def step(acc: Column, x: Column) -> Column:
        full = (acc["n"] > 0) & (acc["total"] + x["_size"] > limit)
        closed = F.concat(acc["out"], F.array(F.struct(acc["n"].alias("n"), acc["total"].alias("total"))))
        out = F.when(full, closed).otherwise(acc["out"])
        n, total = F.when(full, F.lit(0).cast("long")).otherwise(acc["n"]), F.when(full, F.lit(0).cast("long")).otherwise(acc["total"])
        return F.struct(out.alias("out"), (n + 1).alias("n"), (total + x["_size"]).alias("total"))

    def finish(acc: Column) -> Column:
        return F.when(acc["n"] > 0, F.concat(acc["out"], F.array(F.struct(acc["n"].alias("n"), acc["total"].alias("total"))))).otherwise(acc["out"])

    blocks = rows.groupBy(*keys).agg(items.alias("items")).select(*keys, F.posexplode(F.aggregate("items", start, step, finish)).alias("block", "b"))
    last = F.sum("b.n").over(Window.partitionBy(*keys).orderBy("block"))
    return blocks.select(*keys, "block", (last - F.col("b.n") + 1).alias("first"), last.alias("last"), F.col("b.total").alias("total"))


def scroll_dedup(cues: DataFrame, keys: Sequence[str]) -> DataFrame:
    """cues (start, end, text) without rolling repeats: by (start, end, text), while a cue overlaps the
    last kept one, equal words are dropped (its time is not extended) and a longer text that begins
    with the kept one's words replaces it over both intervals."""
    items = F.array_sort(F.collect_list(F.struct("start", "end", "text")))
    kind = "array<struct<start: double, end: double, text: string>>"

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        words, kept = F.split(F.trim(x["text"]), r"\s+"), F.split(F.trim(last["text"]), r"\s+")
        overlap = (F.size(acc) > 0) & (x["start"] < last["end"])
        longer = (F.size(words) > F.size(kept)) & (F.slice(words, 1, F.size(kept)) == kept)
        joined = F.struct(F.least(last["start"], x["start"]).alias("start"), F.greatest(last["end"], x["end"]).alias("end"), x["text"].alias("text"))
        # try_element_at keeps the empty array's last element null
        return F.when(overlap & (words == kept), acc).when(overlap & longer, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    def safe(acc: Column, x: Column) -> Column:
        return F.when(F.size(acc) == 0, F.array(x).cast(kind)).otherwise(step(acc, x).cast(kind))

    kept = F.aggregate("items", F.array().cast(kind), safe)
    return cues.groupBy(*keys).agg(items.alias("items")).select(*keys, F.posexplode(kept).alias("n", "c")).select(*keys, "n", "c.*")


def unique_ids(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """rows with `unique_id`, in order: the first keeps its name, later ones get the first of -2, -3 and so
    on that is not taken yet. Names are stripped and cut to 100 characters, with their suffix; blank ones are "id".

    Only names that are alike in 80 characters without ending numbers can meet; the rows of each such
    family are one sorted run, of which the ids are held.
    """
    base = F.substring(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""), 1, 100)
    base = F.when(base == "", "id").otherwise(base)
    family = F.regexp_replace(F.substring("_base", 1, 80), r"(?:-[0-9]*)+$", "")
    group = [*keys, "_family"]
    dealt = rows.withColumn("_base", base).withColumn("_family", family).repartition(*group).sortWithinPartitions(*group, *order)
    columns = rows.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, used, at = None, set(), {}
        for batch in batches:
            ids = []
            for *own, base in zip(*(batch.column(c).to_pylist() for c in [*group, "_base"])):
                if own != last:
                    last, used, at = own, set(), {}
                found = base
                while found in used:
                    at[base] = at.get(base, 1) + 1
                    suffix = f"-{at[base]}"
                    found = base[: 100 - len(suffix)] + suffix
                used.add(found)
                ids.append(found)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(ids, pa.string())], names=[*columns, "unique_id"])

    return dealt.mapInArrow(work, StructType([*rows.schema.fields, StructField("unique_id", StringType())]))


def evenly_spaced(rows: DataFrame, keys: Sequence[str], order: Sequence[str], most: int) -> DataFrame:
    """At most `most` rows of a key, evenly spaced over its order; the middle rounds to even."""
    w = Window.partitionBy(*keys)
    ranked = rows.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    if most < 2:
        return ranked.where(F.col("_i") < most).drop("_i", "_n")
    picks = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.bround(k * (F.col("_n") - 1) / F.lit(most - 1)).cast("int"))
    return ranked.where((F.col("_n") <= most) | F.array_contains(picks, F.col("_i"))).drop("_i", "_n")


def halved_until_fit(cores: DataFrame, keys: Sequence[str], cost: Callable[[DataFrame], DataFrame], boundaries: DataFrame, *, least: float = 1.0) -> DataFrame:
    """cores (keys, start, end) -> the same cut until they fit, with `status`.

    cost(cores) returns them with `fits`. A core that does not fit is cut at the boundary (keys, at) nearest to its
    middle that leaves `least` on both sides, else in the middle; one of at most `least` seconds has status failed.
    Each round is a table, works on all cores that are left, and its cores are shorter: the rounds end.
    """
    steps, done = Steps(cores.sparkSession, "halves"), None
    now = steps.write(cores.select(*keys, "start", "end"))
    while not now.isEmpty():
        costed = steps.write(cost(now).select(*keys, "start", "end", "fits"))
        small = F.col("end") - F.col("start") <= least + 1e-9
        kept = costed.where(F.col("fits") | small).select(*keys, "start", "end", F.when(F.col("fits"), "scheduled").otherwise("failed").alias("status"))
        done = kept if done is None else done.unionByName(kept)
        cut = costed.where(~F.col("fits") & ~small).select(*keys, "start", "end")
        near = cut.join(boundaries.select(*keys, "at"), list(keys)).where((F.col("at") >= F.col("start") + least) & (F.col("at") <= F.col("end") - least))
        middle = F.col("start") + (F.col("end") - F.col("start")) / 2
        near = near.groupBy(*keys, "start", "end").agg(F.min_by("at", F.struct(F.abs(F.col("at") - middle), F.col("at"))).alias("at"))
        at = F.coalesce(F.col("at"), middle)
        cut = cut.join(near, [*keys, "start", "end"], "left").select(*keys, F.explode(F.array(F.struct(F.col("start"), at.alias("end")), F.struct(at.alias("start"), F.col("end")))).alias("c"))
        now = steps.write(cut.select(*keys, "c.start", "c.end"))
    return now.withColumn("status", F.lit("")) if done is None else done


def refinement_times(start: Column, end: Column, existing: Column, most: int) -> Column:
    """At most `most` times in [start, end) to look at: the middle, both quarters, the start, just before the end, then the
    existing ones; each at least a millisecond from those before it."""
    span = end - start
    candidates = F.concat(F.array(start + span / 2, start + span * 0.25, start + span * 0.75, start, F.greatest(start, end - 1e-3)), existing)

    def step(acc: Column, x: Column) -> Column:
        fits = (x >= start) & (x < end) & ~F.exists(acc, lambda y: F.abs(x - y) < 1e-3) & (F.size(acc) < most)
        return F.when(fits, F.concat(acc, F.array(x))).otherwise(acc)

    return F.aggregate(candidates, F.array().cast("array<double>"), step)


def scene_samples(scenes: DataFrame, timelines: DataFrame, keys: Sequence[str], *, every: float = 90.0) -> DataFrame:
    """Distinct (keys, t), to 3 places: starts of scenes (keys, start) over 0.1 s after the last one kept, 0 if the first is
    later than 0.1 s (or there is none), and every `every` seconds up to 0.1 s before the next scene or the timeline's end."""
    starts = scenes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.col("start").cast("double"))).alias("s"))
    rows = timelines.join(starts, list(keys), "left").withColumn("s", F.coalesce("s", F.array().cast("array<double>")))
    rows = rows.withColumn("s", F.when((F.size("s") == 0) | (F.get("s", F.lit(0)) > 0.1), F.concat(F.array(F.lit(0.0)), "s")).otherwise(F.col("s")))
    following = F.concat(F.slice("s", 2, F.size("s")), F.array(F.col("duration").cast("double")))
    rows = rows.withColumn("x", F.arrays_zip(F.col("s").alias("at"), following.alias("next")))

    def step(acc: Column, x: Column) -> Column:
        kept = F.when((F.size(acc) == 0) | (x["at"] - F.element_at(acc, -1) > 0.1), F.concat(acc, F.array(x["at"]))).otherwise(acc)
        n = F.greatest(F.ceil((x["next"] - 0.1 - x["at"]) / every) - 1, F.lit(0)).cast("int")
        more = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: x["at"] + k * every)).otherwise(F.array().cast("array<double>"))
        return F.concat(kept, more)

    times = F.aggregate("x", F.array().cast("array<double>"), step)
    return rows.select(*keys, F.explode(F.array_distinct(F.transform(times, lambda t: F.round(t, 3)))).alias("t")).where("t >= 0")

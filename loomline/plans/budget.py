"""Budget ledgers replayed from request rows, retries, cache keys, resuming and evaluation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.steps import reachable

#: Limits of a run, in the order in which a breach is reported.
LIMITS = {"calls": 100, "input_tokens": 2_000_000, "output_tokens": 500_000, "images": 500, "seconds": 3600.0, "cost": 5.0}
RETRY_BASE, RETRY_MOST = 0.25, 8.0
#: Seconds for each minute of a lecture by stage, and model calls.
SECONDS_A_MINUTE = {"ingest": 0.15, "extract_evidence": 0.35, "analyze": 1.2, "editorial": 0.25, "bind_render": 0.4}
CALLS_A_MINUTE = 1.8
STAGES = ("ingest", "evidence", "analyze", "plan", "verify", "review", "bind", "render")


def replay(requests: DataFrame, keys: Sequence[str], order: Sequence[str], limits: Mapping[str, float]) -> DataFrame:
    """requests with running totals (total_<counter>), `breach` (the first counter over its limit) and
    `paused` (a row before it, or the row itself, broke a limit)."""
    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = requests
    for name in limits:
        found = found.withColumn(f"total_{name}", F.sum(name).over(so_far))
    breach = F.coalesce(*[F.when(F.col(f"total_{name}") > limit, F.lit(name)) for name, limit in limits.items()])
    found = found.withColumn("breach", breach)
    return found.withColumn("paused", F.coalesce(F.max(F.col("breach").isNotNull()).over(so_far), F.lit(False)))


def replay_holds(events: DataFrame, keys: Sequence[str], limits: Mapping[str, float], *, expires: float) -> DataFrame:
    """events (keys, seq, at, kind, hold, one column a counter of limits) with accepted, reason, and held_<counter>: what a
    budget has consumed and holds after the event.

    kind is reserve (holds its counts under the name hold), settle (of a hold: its counts go, those of the event are
    consumed), release (its counts go) or charge (consumed at once). A hold that nothing has closed expires `expires`
    seconds after it was made, before any event of that time. Events are taken by (at, seq). The first reserve or charge
    that would go over a limit is refused with the counter's name, and all later ones with `paused`; settling and
    releasing go on. Closing what is not held (unknown, refused, closed or expired), and holding a name again, is refused
    as `not held` and `held before`.

    All requests before the first refused one are granted, so running sums over all find it, and running sums over what
    was granted are the result: two windows, no state.
    """
    keys, counters = list(keys), list(limits)
    order = [F.col("at"), F.col("rank"), F.col("seq")]
    # of each name the first reserve, and the first closing after it that comes before it expires
    names = Window.partitionBy(*keys, "hold", "kind").orderBy("at", "seq")
    rows = events.withColumn("rank", F.lit(1)).withColumn("again", (F.col("kind") == "reserve") & (F.row_number().over(names) > 1))
    made = rows.where("kind = 'reserve' and not again").select(*keys, "hold", F.struct("at", "seq").alias("made"), (F.col("at") + expires).alias("until"), *(F.col(c).alias(f"own_{c}") for c in counters))
    rows = rows.join(made, [*keys, "hold"], "left")
    closing = F.col("kind").isin("settle", "release") & F.coalesce((F.struct("at", "seq") > F.col("made")) & (F.col("at") < F.col("until")), F.lit(False))
    rows = rows.withColumn("closing", closing).withColumn("first", F.min(F.when(closing, F.struct("at", "seq"))).over(Window.partitionBy(*keys, "hold")))
    rows = rows.withColumn("closes", F.col("closing") & (F.struct("at", "seq") == F.col("first")))
    expired = rows.where("kind = 'reserve' and not again and first is null").withColumns({"at": F.col("until"), "rank": F.lit(0), "kind": F.lit("expire"), "closes": F.lit(True)})
    rows = rows.unionByName(expired)
    asks = F.col("kind").isin("reserve", "charge") & ~F.col("again")

    def change(c: str) -> Column:
        given = F.when(asks, F.col(c)).when(F.col("closes"), F.when(F.col("kind") == "settle", F.col(c)).otherwise(0) - F.col(f"own_{c}"))
        return F.coalesce(given, F.lit(0))

    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({f"sum_{c}": F.sum(change(c)).over(so_far) for c in counters})
    over = F.coalesce(*(F.when(F.col(f"sum_{c}") > limit, F.lit(c)) for c, limit in limits.items()))
    rows = rows.withColumn("breach", F.when(asks, over))
    place = F.struct("at", "rank", "seq")
    rows = rows.withColumn("stop", F.min(F.when(F.col("breach").isNotNull(), place)).over(Window.partitionBy(*keys)))
    refused = F.coalesce(place >= F.col("stop"), F.lit(False))
    # a hold that was refused can not be closed
    open_hold = F.coalesce(F.struct(F.col("made.at").alias("at"), F.lit(1).alias("rank"), F.col("made.seq").alias("seq")) < F.col("stop"), F.lit(True))
    paused = F.when(place == F.col("stop"), F.col("breach")).otherwise("paused")
    reason = F.when(F.col("again"), "held before").when(asks & refused, paused).when(F.col("kind").isin("settle", "release") & ~(F.col("closes") & open_hold), "not held")
    rows = rows.withColumn("reason", reason).withColumn("granted", F.col("reason").isNull() & ((F.col("kind") != "expire") | open_hold))
    rows = rows.withColumns({f"held_{c}": F.sum(F.when(F.col("granted"), change(c)).otherwise(0)).over(so_far) for c in counters})
    return rows.where("kind <> 'expire'").select(*events.columns, F.col("granted").alias("accepted"), "reason", *(f"held_{c}" for c in counters))


def retry_delay(attempt: Column, retry_after: Column) -> Column:
    """Seconds before an attempt (from 1), without jitter: doubling up to a cap, or what the server asks for if that is over 0."""
    return F.coalesce(F.when(retry_after > 0, retry_after), F.least(F.lit(RETRY_MOST), RETRY_BASE * F.pow(F.lit(2.0), attempt - 1)))


def status_class(code: Column) -> Column:
    """What an error's code says: of the codes that are none of these, those below 400 too, any may be tried again."""
    return F.when(code == 429, "rate_limited").when(code.isin(401, 403), "auth").when(code >= 500, "transient").when(code >= 400, "invalid").otherwise("transient")


def idempotent(requests: DataFrame, keys: Sequence[str], order: Sequence[str], fingerprint: str) -> DataFrame:
    """The first row of each request id, with `conflict`: the id came with more than one fingerprint."""
    by = Window.partitionBy(*keys)
    marked = requests.withColumn("conflict", F.min(fingerprint).over(by) != F.max(fingerprint).over(by))
    return marked.withColumn("_n", F.row_number().over(by.orderBy(*order))).where("_n = 1").drop("_n")


def cache_key(*parts: Column) -> Column:
    """SHA-256 over stage, version, configuration and sorted inputs, separated by NUL."""
    return F.sha2(F.concat_ws("\0", *parts), 256)


def invalidated(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(stage) start (stage) and all stages downstream of it over edges (stage, next), however many there are."""
    found = reachable(start.select(F.col("stage").alias("id")), edges.select(F.col("stage").alias("id"), "next"))
    return found.withColumnRenamed("id", "stage")


def stage_update(ledger: DataFrame, updates: DataFrame) -> DataFrame:
    """ledger (run, name, status, cache_key, error) with updates (run, name, status, cache_key, error): a null cache key keeps the old one, the error is replaced."""
    new = updates.select("run", "name", *(F.col(c).alias(f"_{c}") for c in ("status", "cache_key", "error")))
    found, hit = ledger.join(new, ["run", "name"], "left"), F.col("_status").isNotNull()
    return found.select("run", "name", F.coalesce("_status", "status").alias("status"), F.coalesce("_cache_key", "cache_key").alias("cache_key"), F.when(hit, F.col("_error")).otherwise(F.col("error")).alias("error"))


def stages_reset(ledger: DataFrame, names: DataFrame) -> DataFrame:
    """ledger with the stages in names (run, name) pending again, without cache key and error."""
    found, hit = ledger.join(names.select("run", "name").distinct().withColumn("_hit", F.lit(True)), ["run", "name"], "left"), F.col("_hit").isNotNull()
    return found.select("run", "name", F.when(hit, "pending").otherwise(F.col("status")).alias("status"), F.when(~hit, F.col("cache_key")).alias("cache_key"), F.when(~hit, F.col("error")).alias("error"))


def timeline_estimate(minutes: Column) -> Column:
    """Struct of seconds, calls, memory_mb and headroom_usd of a lecture, by the fixed linear model."""
    calls = F.floor(CALLS_A_MINUTE * minutes).cast("int")
    return F.struct((sum(SECONDS_A_MINUTE.values()) * 60 * minutes).alias("seconds"), calls.alias("calls"), F.least(F.lit(512.0), 8.0 * minutes).alias("memory_mb"), F.greatest(F.lit(0.0), F.greatest(F.lit(2.0), 0.08 * minutes) - 0.01 * calls).alias("headroom_usd"))


def resumed(stored: DataFrame, given: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """stored with the fields that `given` has overridden, and `changed`: whether any value differs."""
    other = given.select(key, *(F.col(f).alias(f"_{f}") for f in fields))
    found = stored.join(other, key, "left")
    differs = F.lit(False)
    for f in fields:
        differs = differs | (F.col(f"_{f}").isNotNull() & ~F.col(f).eqNullSafe(F.col(f"_{f}")))
    return found.select(key, *(F.coalesce(f"_{f}", f).alias(f) for f in fields), differs.alias("changed"))


def scorecard(scores: DataFrame, keys: Sequence[str], means: Sequence[str], sums: Sequence[str]) -> DataFrame:
    return scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"mean_{c}") for c in means), *(F.sum(c).alias(f"sum_{c}") for c in sums))


def merged_raters(scores: DataFrame, keys: Sequence[str], means: Sequence[str], most: Sequence[str], agree_on: Sequence[str]) -> DataFrame:
    """Two raters' rows (rater a or b) to one: means, maxima, and agreement = 1 - mean absolute difference."""
    pick = lambda c, r: F.max(F.when(F.col("rater") == r, F.col(c)))
    spread = sum((F.abs(pick(c, "a") - pick(c, "b")) for c in agree_on), F.lit(0.0)) / len(agree_on)
    return scores.groupBy(*keys).agg(*(((pick(c, "a") + pick(c, "b")) / 2).alias(c) for c in means), *(F.max(c).alias(c) for c in most), (1 - spread).alias("agreement"))

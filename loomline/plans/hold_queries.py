"""Holds of a budget bound to the harness tables: a user's events reserve, settle, release and charge."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import budget
from .queries import EV, USER, events, query

#: Limits of a run, and seconds after which a hold expires.
LIMITS, EXPIRES = {"calls": 12, "cost": 180}, 4 * 86400.0


@query(f"""WITH RECURSIVE {EV}, rq AS (SELECT user_id, event_id AS seq, "start" AS tm, ['reserve', 'reserve', 'settle', 'release', 'charge'][event_id % 5 + 1] AS kind,
      coalesce(max(CASE WHEN event_id % 5 < 2 THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id), -1) AS hold, 1 + event_id % 3 AS calls, event_id % 50 AS cost FROM ev),
  o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tm, seq) AS n FROM rq),
  walk AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS reason, false AS paused, CAST(0 AS HUGEINT) AS calls, CAST(0 AS HUGEINT) AS cost,
      CAST([] AS STRUCT(hold BIGINT, until_ DOUBLE, calls BIGINT, cost BIGINT)[]) AS held, CAST([] AS BIGINT[]) AS names FROM (SELECT DISTINCT user_id FROM events)
    UNION ALL
    SELECT user_id, n, seq, reason, paused OR reason IN ('calls', 'cost'), used_calls + CASE WHEN reason IS NULL AND kind IN ('charge', 'settle') THEN calls ELSE 0 END,
      used_cost + CASE WHEN reason IS NULL AND kind IN ('charge', 'settle') THEN cost ELSE 0 END,
      CASE WHEN reason IS NOT NULL OR kind = 'charge' THEN held WHEN kind = 'reserve' THEN list_append(held, {{'hold': hold, 'until_': tm + {EXPIRES}, 'calls': calls, 'cost': cost}}) ELSE list_filter(held, lambda h: h.hold <> x.hold) END,
      CASE WHEN kind = 'reserve' THEN list_append(names, hold) ELSE names END
    FROM (SELECT *, CASE WHEN kind = 'reserve' AND list_contains(names, y.hold) THEN 'held before'
          WHEN kind IN ('reserve', 'charge') THEN CASE WHEN paused THEN 'paused' WHEN used_calls + coalesce(list_sum(list_transform(held, lambda h: h.calls)), 0) + calls > {LIMITS["calls"]} THEN 'calls'
            WHEN used_cost + coalesce(list_sum(list_transform(held, lambda h: h.cost)), 0) + cost > {LIMITS["cost"]} THEN 'cost' END
          WHEN len(list_filter(held, lambda h: h.hold = y.hold)) = 0 THEN 'not held' END AS reason
      FROM (SELECT w.user_id, o.n, o.seq, o.kind, o.hold, o.tm, o.calls, o.cost, w.paused, w.calls AS used_calls, w.cost AS used_cost, w.names, list_filter(w.held, lambda h: h.until_ > o.tm) AS held
        FROM walk w JOIN o ON o.user_id = w.user_id AND o.n = w.n + 1) y) x)
  SELECT user_id, seq, reason IS NULL AS accepted, reason, CAST(calls + coalesce(list_sum(list_transform(held, lambda h: h.calls)), 0) AS BIGINT) AS held_calls,
    CAST(cost + coalesce(list_sum(list_transform(held, lambda h: h.cost)), 0) AS BIGINT) AS held_cost FROM walk WHERE seq IS NOT NULL""")
def b1_held_budget(spark, d):
    e = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, ("reserve", "reserve", "settle", "release", "charge"))), (e % 5 + 1).cast("int"))
    last = F.max(F.when(e % 5 < 2, e)).over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = events(spark, d).select("user_id", e.alias("seq"), F.col("start").alias("at"), kind.alias("kind"), F.coalesce(last, F.lit(-1)).alias("hold"), (1 + e % 3).alias("calls"), (e % 50).alias("cost"))
    return budget.replay_holds(rows, USER, LIMITS, expires=EXPIRES).select("user_id", "seq", "accepted", "reason", "held_calls", "held_cost")

"""Entity resolution: keys of claims, exact and perceptual duplicates, merging, conflicts."""

from __future__ import annotations

import bisect
import functools
import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .steps import Steps


def qualifier_key(qualifiers: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.transform(qualifiers, lambda q: F.lower(T.strip(q))), lambda q: q != "")), ",")


def concept_key(text: Column, qualifiers: Column) -> Column:
    """Concept, sorted lower-case qualifiers (stripped, without blank ones) and polarity, joined by bars."""
    marks = qualifier_key(qualifiers)
    return F.concat_ws("|", T.normalize_concept(text), marks, T.polarity(text))


def jaccard(a: Column, b: Column) -> Column:
    """Of two id arrays as sets; 0 if either is empty."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def first_of_content(rows: DataFrame, content: str, order: Sequence[str]) -> DataFrame:
    """The first row of each content, with `asset_id`: the first 16 digits of its SHA-256."""
    hashed = rows.withColumn("_sha", F.sha2(F.col(content), 256))
    first = F.row_number().over(Window.partitionBy("_sha").orderBy(*order))
    return hashed.withColumn("_n", first).where("_n = 1").withColumn("asset_id", F.substring("_sha", 1, 16)).drop("_n", "_sha")


#: Bits of a band below which bands tell too little apart, and pairs in common bands that a prefix may have, for each row.
LEAST_BITS, PAIRS = 6, 16


def _bands(rows: DataFrame, distance: int) -> DataFrame:
    """rows (b: 64 bits) once for each of distance + 1 bands, with `band`: two values that differ in at most `distance` bits
    have a band in common. One band for all where bands would be too narrow."""
    n = distance + 1
    if n == 1:
        return rows.withColumn("band", F.col("b"))
    if 64 // n < LEAST_BITS:
        return rows.withColumn("band", F.lit(0).cast("long"))
    cuts = [64 * k // n for k in range(n + 1)]
    parts = [F.shiftrightunsigned("b", at).bitwiseAND(F.lit((1 << (to - at)) - 1)) * n + k for k, (at, to) in enumerate(zip(cuts, cuts[1:]))]
    return rows.withColumn("band", F.explode(F.array(*parts)))


def leaders(rows: DataFrame, keys: Sequence[str], order: str, bits: str, distance: int = 8) -> DataFrame:
    """keys, order, leader: the first leader of the key whose 64 bits differ in at most `distance` places, or the row itself
    as a new one, as if the rows were taken in order. order is a whole number that no two rows of a key share.

    A prefix of the order is settled by itself: in rounds, a row is a leader once no earlier row near it is open. All
    other rows near its leaders then leave, so that a large group is compared with its leader and not with itself. The
    prefix is as long as its rows' pairs in common bands stay in proportion to all rows. Rows without bits lead nothing.
    """
    steps = Steps(rows.sparkSession, "leaders")
    named = rows.select(*keys, F.col(order).cast("long").alias("o"), F.col(bits).cast("long").alias("b")).where("o is not null and b is not null")
    named = steps.write(named)
    group = [*keys, "b"]
    rest = steps.write(named.groupBy(*group).agg(F.min("o").alias("o")))
    near = F.bit_count(F.col("b").bitwiseXOR(F.col("_b"))) <= distance
    share, found = 1.0, []
    while n := rest.count():
        share = min(1.0, 2 * share)
        while True:
            cut = rest.agg(F.percentile_approx("o", F.lit(share), F.lit(10_000))).first()[0] if share < 1 else None
            head = rest if cut is None else rest.where(F.col("o") <= cut)
            pairs = _bands(head, distance).groupBy(*keys, "band").count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0] or 0
            if pairs <= PAIRS * (n + 1000) or share * n < 2:
                break
            share /= 4
        head = steps.write(head)
        later = _bands(head, distance).withColumnsRenamed({"b": "_b", "o": "_o"})
        edges = steps.write(_bands(head, distance).join(later, [*keys, "band"]).where((F.col("o") < F.col("_o")) & near).select(*keys, "o", "_o").distinct())
        open_, made = head.select(*keys, "o"), []
        while not open_.isEmpty():
            held = edges.join(open_, [*keys, "o"], "left_semi").select(*keys, F.col("_o").alias("o")).distinct()
            lead = steps.write(open_.join(held, [*keys, "o"], "left_anti"))
            made.append(lead)
            led = edges.join(lead, [*keys, "o"], "left_semi").select(*keys, F.col("_o").alias("o"))
            open_ = steps.write(open_.join(lead.unionByName(led).distinct(), [*keys, "o"], "left_anti"))
        new = head.join(functools.reduce(DataFrame.unionByName, made), [*keys, "o"], "left_semi").withColumnsRenamed({"b": "_b", "o": "_o"})
        joined = _bands(rest, distance).join(_bands(new.withColumn("b", F.col("_b")), distance).drop("b"), [*keys, "band"]).where((F.col("_o") <= F.col("o")) & near)
        found.append(steps.write(joined.groupBy(*group).agg(F.min("_o").alias("leader"))))
        rest = steps.write(rest.join(found[-1], group, "left_anti"))
    if not found:
        return named.select(*keys, F.col("o").alias(order), F.col("o").alias("leader"))
    return named.join(functools.reduce(DataFrame.unionByName, found), group).select(*keys, F.col("o").alias(order), "leader")


def conflicting_claims(claims: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs (left_id < right_id) of claims (id, unit_id, text, qualifiers) of different units with one
    concept and the same qualifiers as written, but opposite polarity. Both stay."""
    rows = claims.select(*keys, "id", "unit_id", T.normalize_concept(F.col("text")).alias("_c"), F.array_join(F.array_sort(F.array_distinct("qualifiers")), ",").alias("_q"), T.polarity(F.col("text")).alias("_p"))
    left, right = rows.where("_p = 'pos'"), rows.where("_p = 'neg'").withColumnsRenamed({"id": "_id", "unit_id": "_unit"}).drop("_p")
    pairs = left.join(right, [*keys, "_c", "_q"]).where("unit_id <> _unit")
    return pairs.select(*keys, F.least("id", "_id").alias("left_id"), F.greatest("id", "_id").alias("right_id"))


def translation_duplicates(units: DataFrame, keys: Sequence[str], share: float = 0.45) -> DataFrame:
    """Pairs of units (id, start, end, script, evidence array, concept) of a topic that say the same:
    time overlap and evidence Jaccard of `share`, and Japanese with Chinese or one concept in the other.

    Units meet at each evidence id that they share, not in pairs of the topic.
    """
    rows = units.withColumn("_e", F.explode(F.array_distinct("evidence")))
    other = rows.select(*keys, "_e", *(F.col(c).alias(f"_{c}") for c in ("id", "start", "end", "script", "evidence", "concept")))
    met = rows.join(other, [*keys, "_e"]).where("id < _id").drop("_e").dropDuplicates([*keys, "id", "_id"])
    shorter = F.greatest(F.least(F.col("end") - F.col("start"), F.col("_end") - F.col("_start")), F.lit(1e-6))
    overlap = F.greatest(F.lit(0.0), F.least("end", "_end") - F.greatest("start", "_start")) / shorter
    scripts = F.array_sort(F.array("script", "_script")) == F.array(F.lit("ja"), F.lit("zh"))
    within = F.col("concept").contains(F.col("_concept")) | F.col("_concept").contains(F.col("concept"))
    found = met.where((overlap >= share) & (jaccard(F.col("evidence"), F.col("_evidence")) >= share) & (scripts | within))
    return found.select(*keys, F.col("id").alias("left_id"), F.col("_id").alias("right_id"))


def one_pass(units: list[dict]) -> list[dict]:
    """units (start, end, claims, members) after each has taken in those behind it that it can."""
    having: dict[tuple, list[int]] = {}
    for place, unit in enumerate(units):
        for claim in unit["claims"]:
            having.setdefault(claim, []).append(place)
    taken, out = set(), []
    for place, unit in enumerate(units):
        if place in taken:
            continue
        own = dict(unit, claims=set(unit["claims"]), members=list(unit["members"]))
        # places behind that share a claim, the nearest first; each is tried once
        waiting, seen, at = [], set(), place

        def look(claims: set) -> None:
            for claim in claims:
                places = having[claim]
                for k in places[bisect.bisect_right(places, at) :]:
                    if k not in seen and k not in taken:
                        seen.add(k)
                        heapq.heappush(waiting, k)

        look(own["claims"])
        while waiting:
            at = heapq.heappop(waiting)
            other = units[at]
            opposite = {(c, q, "neg" if p == "pos" else "pos") for c, q, p in other["claims"]}
            if own["end"] > other["start"] and other["end"] > own["start"] and not own["claims"] & opposite:
                taken.add(at)
                new = other["claims"] - own["claims"]
                own |= {"members": own["members"] + other["members"], "start": min(own["start"], other["start"]), "end": max(own["end"], other["end"]), "claims": own["claims"] | new}
                look(new)
        out.append(own)
    return out


def merge_units(units: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Agglomerative merge of units (id, kind, start, end, claims array<struct<text, qualifiers, evidence>>)
    to a fixpoint, in order of (start, id).

    Two units merge if neither is a recap, they are of one kind, their times overlap, no claims of theirs contradict and
    some are equal. A pass takes each unit in turn and goes once over those behind it, each tested with what the unit has
    grown to; passes go on until one changes nothing. Only units of one kind can meet, and only those of one stretch of
    time without a gap: a fold has those of one key (a source), kind and stretch. A unit looks only at those that
    have a claim of its own, found by an index of claims.
    """
    schema = ", ".join(f"{c} {t}" for c, t in units.select(*keys).dtypes) + ", id string, members array<string>, kind string, start double, end double, n_claims int"
    names = [*keys, "id", "members", "kind", "start", "end", "n_claims"]
    keyed = units.withColumn("claims", F.transform("claims", lambda c: F.struct(T.normalize_concept(c["text"]).alias("concept"), T.polarity(c["text"]).alias("polarity"), qualifier_key(c["qualifiers"]).alias("qualifiers"))))

    def folded(stretch: list[dict]) -> list[dict]:
        merged: list[dict] = []
        for row in sorted(stretch, key=lambda r: (r["start"], r["id"])) if len(stretch) > 1 else stretch:
            claims = {(c["concept"], c["qualifiers"], c["polarity"]) for c in row["claims"] or ()}
            merged.append({**row, "members": [row["id"]], "claims": claims})
        before = len(merged) + 1
        while len(merged) < before and merged[0]["kind"] != "recap":
            before, merged = len(merged), one_pass(merged)
        return [{**m, "n_claims": len(m["claims"])} for m in merged]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch: list[dict] = []
        arrow = None
        for batch in batches:
            if arrow is None:
                own = {"members": pa.list_(pa.string()), "n_claims": pa.int32()}
                arrow = pa.schema([(c, own[c] if c in own else batch.schema.field(c).type) for c in names])
            out = []
            for row in batch.to_pylist():
                if row["_new"] and stretch:
                    out += folded(stretch)
                    stretch = []
                stretch.append(row)
            yield pa.RecordBatch.from_pylist(out, arrow)
        if stretch:
            yield pa.RecordBatch.from_pylist(folded(stretch), arrow)

    # a unit alone in its stretch, as most are, needs no fold; the other stretches are told apart in a stream of sorted rows.
    # A unit without a start or an end is a stretch by itself
    timed = F.col("start").isNotNull() & F.col("end").isNotNull()
    order = ["_timed", "start", "end", "id"]
    w = Window.partitionBy(*keys, "kind").orderBy(*order)
    reach = F.max(F.when(F.col("_timed"), F.col("end"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    keyed = keyed.withColumn("_timed", timed).withColumn("_new", ~F.coalesce(F.col("_timed") & (F.col("start") < reach), F.lit(False)))
    keyed = keyed.withColumn("_last", F.lead("_new", 1, True).over(w))
    alone = keyed.where("_new and _last").select(*keys, "id", F.array("id").alias("members"), "kind", "start", "end", F.coalesce(F.size(F.array_distinct("claims")), F.lit(0)).alias("n_claims"))
    more = keyed.where("not (_new and _last)").select(*keys, "id", "kind", "start", "end", "claims", "_timed", "_new")
    return alone.unionByName(more.sortWithinPartitions(*keys, "kind", *order).mapInArrow(fold, schema))

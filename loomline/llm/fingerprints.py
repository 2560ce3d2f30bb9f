"""Document fingerprints: bottom-k sketches of word-shingle hashes. DataFrame functions only.

A sketch is the sorted array of the SIZE least distinct hashes. Sketches of parts merge into the
sketch of the whole, and two of them estimate resemblance, containment and the number of distinct
shingles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import let

WORDS, SIZE = 5, 64
#: White space between words.
WHITE_SPACE = " \t\n\x0b\x0c\r"
#: Low bits of doc_ids of one group of neighbours, and groups of one group above.
NEAR_BITS, ABOVE = 9, 4096


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """64-bit hashes of the runs of `words` words in lower case; of all words where there are fewer."""
    bare = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(WHITE_SPACE))

    def of_words(split: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(split) - (words - 1), F.lit(1)))
        hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(split, i, words)))
        return F.when(F.get(split, F.lit(0)) == "", F.array().cast("array<bigint>")).otherwise(hashes)

    return let(F.split(bare, r"[\x20\x09-\x0D]+"), of_words)


def bottom(hashes: Column, size: int = SIZE) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, size)


def merged(a: Column, b: Column, size: int = SIZE) -> Column:
    return bottom(F.concat(a, b), size)


def resemblance(a: Column, b: Column, size: int = SIZE) -> Column:
    """Jaccard estimate from the least hashes of both; 1 if both sets are empty."""
    return let(
        merged(a, b, size),
        lambda union: F.when(F.size(union) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(union, a), b)) / F.size(union)),
    )


def distinct_shingles(a: Column, size: int = SIZE) -> Column:
    """The number of distinct shingles: exact below `size`, else from the place of the largest hash kept."""
    place = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < size, F.size(a).cast("double")).otherwise((size - 1) / place)


def containment(a: Column, b: Column, size: int = SIZE) -> Column:
    """The share of a's shingles that b has too; 0 for an empty a."""
    shared = resemblance(a, b, size) * distinct_shingles(merged(a, b, size), size)
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, size)))


def merge_sketches(sketches: DataFrame, key: str, sketch: str = "sketch", size: int = SIZE) -> DataFrame:
    """The sketch of all parts with one key. Parts of a hot key are cut down in salted groups first."""
    hashes = sketches.select(key, F.explode(sketch).alias("h")).distinct().withColumn("salt", F.pmod("h", F.lit(64)))
    for by in ([key, "salt"], [key]):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("h"))
        hashes = hashes.withColumn("rank", rank).where(F.col("rank") <= size)
    return hashes.groupBy(key).agg(F.sort_array(F.collect_list("h")).alias(sketch))


def as_text(sketch: Column) -> Column:
    """16 hex digits a hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def next_below(groups: DataFrame, least: int, largest: int) -> DataFrame:
    """groups (g long, distinct, in least..largest) -> (g, below: the next smaller g, null for the least).

    Neighbours are found within groups of ABOVE, and between those by the same step on the groups.
    """
    over = F.expr(f"(g - ({least})) div {ABOVE}")
    w = Window.partitionBy("over").orderBy("g")
    found = groups.select("g", over.alias("over")).withColumn("below", F.lag("g").over(w))
    if largest - least < ABOVE:
        return found.select("g", "below")
    tops = found.groupBy("over").agg(F.max("g").alias("top"))
    steps = next_below(tops.select(F.col("over").alias("g")), 0, (largest - least) // ABOVE)
    tops_below = steps.join(tops.select(F.col("over").alias("below"), F.col("top").alias("g_below")), "below").select(F.col("g").alias("over"), "g_below")
    return found.join(tops_below, "over", "left").select("g", F.coalesce("below", "g_below").alias("below"))


def with_next(docs: DataFrame, doc_id: str, column: str, derived: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """docs with the derived columns and `next`: a struct of column and the derived ones of the row that follows by
    descending doc_id; after the last comes the first.

    Rows are dealt by ranges of 2^NEAR_BITS doc_ids, whatever their number; a range's last row takes the
    first one of the next range that has any. Equal doc_ids follow each other by `column`, rows
    without one come last. What is derived is worked out once a row, and once more for a range's first row.
    """
    least, largest = docs.agg(F.min(doc_id), F.max(doc_id)).first()
    least, largest = (0, 0) if least is None else (max(least - 1, -(1 << 63)), largest)
    top = (largest >> NEAR_BITS) - (least >> NEAR_BITS)
    place = F.coalesce(F.col(doc_id).cast("long"), F.lit(least))
    docs = docs.withColumn("_place", place).withColumn("_bare", F.col(doc_id).isNull()).withColumn("_g", F.shiftright("_place", NEAR_BITS) - F.lit(least >> NEAR_BITS))
    # the first of the rows of a range, found in the tasks before it is dealt out: the order is that of the window below
    order = F.struct(F.bitwise_not("_place").alias("p"), "_bare", column)
    firsts = docs.groupBy("_g").agg(F.min(order).alias("m")).select("_g", F.col(f"m.{column}").alias(column))
    groups = docs.select(F.col("_g").alias("g")).distinct()
    below = next_below(groups, 0, top).select(F.col("g").alias("_g"), F.coalesce("below", F.lit(top)).alias("_below"))
    made = lambda rows: rows.select("*", *(f(F.col(column)).alias(name) for name, f in derived.items()))
    following = below.join(firsts.withColumnRenamed("_g", "_below"), "_below")
    following = made(following).select("_g", F.struct(column, *derived).alias("first"))
    w = Window.partitionBy("_g").orderBy(F.col("_place").desc(), "_bare", column)
    led = made(docs).withColumn("next", F.lead(F.struct(column, *derived)).over(w))
    return led.join(following, "_g").withColumn("next", F.coalesce("next", "first")).drop("_place", "_bare", "_g", "first")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of docs (doc_id, text) and of their edited texts.

    The edited text has its last third replaced by as much of the next document's start. Returns
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    n_shingles (estimated), contained_in_edited. A null text counts as empty; two texts without
    words are alike (1), one with and one without are not (0). Rows of one doc_id follow each other by
    text, those without one come last. Texts of any length are whole. Other columns are not read; an
    empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(rows, "doc_id", "text", {"sketch": lambda text: bottom(shingle_hashes(text))})
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), (n - third).cast("int")), F.substr("next.text", F.lit(1), third))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", F.col("next.sketch").alias("next_sketch"))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sketch", "next_sketch", bottom(shingle_hashes(F.col("edited"))).alias("edited_sketch"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        distinct_shingles(F.col("sketch")).alias("n_shingles"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("contained_in_edited"),
    )

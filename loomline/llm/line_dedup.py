"""Line dedup over levelled sorted runs of line hashes. DataFrame functions only.

A run is a bucketed and sorted table (h1, h2, n, total) of 128-bit hashes of line keys: n is the number
of documents of the run that hold the line, total that of all documents when the run was made. A key is
settled once its total is at the threshold. A new batch of documents is merged with all runs, bucket by
bucket without a shuffle of theirs: keys that one of them has settled are left out (an anti-join), the
others add up their total, and are a run of level 0. When a level has two runs they are merged, again
bucket by bucket, into one run of the next level.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage
from .columns import let

#: The white space that a key loses at both ends.
WHITE_SPACE = " \t\n\x0b\x0c\r"
HASHES = "h1 long, h2 long"


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z in lower case; other letters keep their case."""
    bare = F.btrim(line, F.lit(WHITE_SPACE))
    ascii_only = F.length(bare) == F.octet_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def line_hash(line: Column, min_chars: int) -> Column:
    """128 bits of the key, or null for a key that is too short to count."""
    key = line_key(line)
    hashed = F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2"))
    return F.when(F.length(key) >= min_chars, hashed)


class LineRuns:
    """Levelled sorted runs in the shared folder. The driver holds names only."""

    def __init__(self, spark: SparkSession, min_docs: int):
        self.spark, self.min_docs = spark, min_docs
        self.name = f"line_run_{uuid.uuid4().hex}"
        self.root = storage.new_path(spark, "line-runs")
        # what a grouping by the hashes makes: it is written as it is
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.made = 0

    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def _read(self, run: str, i: int) -> DataFrame:
        return self.spark.table(run).select("h1", "h2", F.col("n").alias(f"n_{i}"), F.col("total").alias(f"total_{i}"))

    def _write(self, rows: DataFrame) -> str:
        self.made += 1
        run = f"{self.name}_{self.made}"
        rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.root}/{self.made}").saveAsTable(run)
        return run

    def _drop(self, run: str) -> None:
        self.spark.sql(f"DROP TABLE {run}")
        storage.drop(self.spark, f"{self.root}/{run.rsplit('_', 1)[1]}")

    def with_runs(self, counts: DataFrame) -> DataFrame:
        """counts (h1, h2, n) with `total`, without what a run has settled."""
        total, open_ = F.col("n"), F.lit(True)
        for i, run in enumerate(self.runs()):
            counts = counts.join(self._read(run, i), ["h1", "h2"], "left")
            total = total + F.coalesce(f"n_{i}", F.lit(0))
            open_ = open_ & (F.coalesce(f"total_{i}", F.lit(0)) < self.min_docs)
        return counts.where(open_).select("h1", "h2", "n", total.alias("total"))

    def add(self, lines: DataFrame) -> None:
        """lines: (h1, h2), one row for each document and key of the batch."""
        counts = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
        self.levels[0].append(self._write(self.with_runs(counts)))
        level = 0
        while len(self.levels[level]) > 1:
            self._compact(level)
            level += 1

    def merged(self, older: str, newer: str) -> DataFrame:
        both = self._read(older, 0).join(self._read(newer, 1), ["h1", "h2"], "full_outer")
        zero = lambda c: F.coalesce(c, F.lit(0))
        return both.select("h1", "h2", (zero("n_0") + zero("n_1")).alias("n"), F.greatest(zero("total_0"), zero("total_1")).alias("total"))

    def _compact(self, level: int) -> None:
        runs = self.levels[level]
        if level + 1 == len(self.levels):
            self.levels.append([])
        self.levels[level + 1].append(self._write(self.merged(*runs)))
        self.levels[level] = []
        for run in runs:
            self._drop(run)

    def common(self) -> DataFrame:
        """Distinct (h1, h2) of the keys in at least min_docs documents of all batches: a settled key has one run that says so."""
        found = self.spark.createDataFrame([], HASHES)
        for run in self.runs():
            found = found.unionByName(self.spark.table(run).where(F.col("total") >= self.min_docs).select("h1", "h2"))
        return found

    def close(self) -> None:
        for run in self.runs():
            self._drop(run)
        self.levels = [[]]
        storage.drop(self.spark, self.root)


def without_positions(lines: Column, dropped: Column) -> Column:
    """The lines between the sorted 0-based positions `dropped`, in time linear in the lines."""
    n, m = F.size(lines), F.size(dropped)

    def between(j: Column) -> Column:
        before = F.when(j == 0, F.lit(-1)).otherwise(F.get(dropped, j - 1))
        after = F.when(j == m, n).otherwise(F.get(dropped, j))
        return F.slice(lines, before + 2, after - before - 1)

    return F.flatten(F.transform(F.sequence(F.lit(0), m), between))


def dedup_lines(docs: DataFrame, text: str = "text", *, min_docs: int = 10, min_chars: int = 1, batches: int = 4) -> DataFrame:
    """Drop, in every document, the lines whose key at least min_docs documents hold.

    Returns one row per input row: `row` (the input row as a struct, so no column can clash),
    `n_lines`, `n_dropped`, `kept` (the other lines joined by \\n). A null text counts as empty: one
    empty line. Keys shorter than min_chars are never dropped. Each input row is a document of its
    own: repeated rows count as often as they occur. A text of any length is one row throughout.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    # rows are matched by their text, whatever their columns hold; the third part deals out the copies of one text
    ids = [F.xxhash64(body).alias("t1"), F.xxhash64(F.lit("text"), body).alias("t2"), F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind)), F.lit(1024)).alias("t3")]
    hashed = docs.select(*ids, F.transform(F.split(body, "\n"), lambda x: line_hash(x, min_chars)).alias("keys"))
    hashed = hashed.withColumn("batch", F.pmod(F.col("t1"), F.lit(batches)).cast("int"))
    with storage.Scratch(spark, "line-dedup") as scratch:
        hashed = scratch.write(hashed, "keys", "batch")
        runs = LineRuns(spark, min_docs)
        for batch in range(batches):
            keys = hashed.where(F.col("batch") == batch).select(F.explode(F.array_distinct("keys")).alias("k"))
            runs.add(keys.where("k is not null").select("k.*"))
        common = scratch.write(runs.common(), "common")
        runs.close()
        at = hashed.select("t1", "t2", "t3", F.posexplode("keys").alias("pos", "k")).where("k is not null").select("t1", "t2", "t3", "pos", "k.*")
        drops = at.join(common, ["h1", "h2"], "left_semi").groupBy("t1", "t2", "t3").agg(F.array_sort(F.collect_set("pos")).alias("drops"))
        drops = scratch.keep(drops, "line-drops")
    rows = docs.select(F.struct("*").alias("row"), *ids).join(drops, ["t1", "t2", "t3"], "left")
    body = F.coalesce(F.col(f"row.{text}"), F.lit(""))
    lines = F.split(body, "\n")
    return rows.select(
        "row",
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("drops").isNull(), body).otherwise(let(lines, lambda x: F.array_join(without_positions(x, F.col("drops")), "\n"))).alias("kept"),
    )

"""Tables of an iteration, written to the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Steps:
    """Each step is a Parquet table under spark.checkpoint.dir, so that no step works out the ones before it again.

    Without that setting a temporary folder is taken, on one machine only.
    """

    def __init__(self, spark: SparkSession, name: str):
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not root:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            root = tempfile.mkdtemp(prefix="loomline-")
        self.spark, self.path, self.paths = spark, f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}", []

    def write(self, df: DataFrame) -> DataFrame:
        self.paths.append(f"{self.path}/{len(self.paths)}")
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def all(self, like: DataFrame) -> DataFrame:
        """The rows of all steps so far."""
        return self.spark.read.schema(like.schema).parquet(*self.paths)


#: Rows that a task groups, sorts or joins.
ROWS = 50_000


def tasks_for(table: DataFrame, rows: int = ROWS, least: int = 1) -> int:
    """To how many tasks a written table (it is counted) is dealt, so that each has about so many rows and its memory
    doesn't grow with the table; at least `least` for each core, where the rows are much work and few bytes."""
    return max(least * table.sparkSession.sparkContext.defaultParallelism, -(-table.count() // rows))


def reachable(start: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (id) of start and all that edges (id, next) lead to. Goes on until a step adds nothing, however long the chain.

    An edge to what has been reached is of no further use. Only the others are read by the next step, so that it needs
    neither all edges nor all ids found before.
    """
    steps, left = Steps(start.sparkSession, "reachable"), Steps(start.sparkSession, "edges")
    last = steps.write(start.select("id").distinct())
    kind = dict(last.dtypes)["id"]
    edges = edges.select("id", F.col("next").cast(kind).alias("next"))
    while not last.isEmpty():
        edges = left.write(edges.join(last.select(F.col("id").alias("next")), "next", "left_anti").select("id", "next"))
        last = steps.write(edges.join(last, "id").select(F.col("next").alias("id")).distinct())
    return steps.all(last).distinct()

"""Files that a document names: whether they are there, are what it says, and are of the type that it says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The types of names, and the bytes that files of some types begin with.
TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "gif": "image/gif", "mp4": "video/mp4"}
BEGINNINGS = {"image/jpeg": "FFD8FF", "image/png": "89504E470D0A1A0A"}
OUTSIDE, MISSING, HASH, TYPE = "outside of the root", "missing", "hash", "type"


def read_assets(spark: SparkSession, root: str) -> DataFrame:
    """(path under the root, size, sha256, head) of all files under a folder; contents stay in the tasks.
    Spark reads no empty files, so those are as if they were missing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    # the part of the path after that of the root, whatever the scheme is written like
    base = root.rstrip("/").split("://", 1)[-1].split(":", 1)[-1].lstrip("/") + "/"
    return described(files.select(F.substring_index("path", base, -1).alias("path"), "content"))


def described(files: DataFrame) -> DataFrame:
    """(path, size, sha256, head: the first 8 bytes) of files (path, content)."""
    return files.select("path", F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"), F.substring("content", 1, 8).alias("head"))


def type_of_name(path: Column) -> Column:
    """The type that the ending of a name stands for; null of others."""
    types = F.create_map(*(F.lit(x) for pair in TYPES.items() for x in pair))
    return F.try_element_at(types, F.lower(F.regexp_extract(path, r"\.([^./]+)\z", 1)))


def asset_faults(claimed: DataFrame, files: DataFrame) -> DataFrame:
    """claimed (path, sha256, mime_type) with the first fault of each row that has one.

    files is what described() gives. A path must be relative and stay under the root, and be there; the digest must be the
    file's; a file whose name says JPEG or PNG must begin like one, and a type that is given must be the one of the name
    (a name with another ending has any type). A null type is not looked at. Repeated rows have the fault once each.
    """
    path = F.col("path")
    known = files.select("path", F.col("sha256").alias("_sha"), "head").dropDuplicates(["path"]).withColumn("_there", F.lit(True))
    rows = claimed.join(known, "path", "left").withColumn("_type", type_of_name(path))
    begins = F.lit(True)
    for kind, start in BEGINNINGS.items():
        begins = begins & (~F.col("_type").eqNullSafe(F.lit(kind)) | F.hex("head").startswith(start))
    given = F.when(F.col("mime_type") == "image/jpg", "image/jpeg").otherwise(F.col("mime_type"))
    outside = path.isNull() | path.rlike(r"^[/\\~]|(?:^|[/\\])\.\.(?:[/\\]|\z)|^[A-Za-z][A-Za-z0-9+.-]*:")
    fault = F.when(outside, OUTSIDE).when(F.col("_there").isNull(), MISSING).when(~F.col("sha256").eqNullSafe(F.col("_sha")), HASH).when(given.isNotNull() & (~begins | (F.coalesce("_type", given) != given)), TYPE)
    return rows.withColumn("fault", fault).where("fault is not null").select(*claimed.columns, "fault")

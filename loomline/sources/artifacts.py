"""Writers of artifacts: JSON and Parquet by relation, provenance, failure logs and schemas."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_artifacts(relations: Mapping[str, DataFrame], path: str, fmt: str = "json") -> None:
    """Each relation in a folder of its own; Spark's commit makes a folder whole or leaves it out."""
    for name, rows in relations.items():
        rows.write.mode("overwrite").format(fmt).save(f"{path}/{name}")


def provenance(pages: DataFrame, seeks: DataFrame) -> DataFrame:
    """pages (page_id) with `sources`: JSON of their seeks (page_id, t, link) by time."""
    listed = seeks.groupBy("page_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("t", "link")))).alias("sources"))
    return pages.join(listed, "page_id", "left").withColumn("sources", F.coalesce("sources", F.lit("[]")))


def embeddable(rows: DataFrame) -> DataFrame:
    """One JSON text a row, with < escaped so that it can stand in a page."""
    return rows.select(F.replace(F.to_json(F.struct("*")), F.lit("<"), F.lit("\\u003c")).alias("value"))


def append_failures(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def schemas(relations: Mapping[str, DataFrame]) -> dict[str, str]:
    return {name: rows.schema.json() for name, rows in relations.items()}

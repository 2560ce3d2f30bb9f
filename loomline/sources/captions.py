"""Readers of captions, recognised speech and text, probes, model output and link lists."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T

ARROW = re.compile(r"^\s*(\S+)\s+-->\s+(\S+)")
CUES = "path string, n int, kind string, start double, end double, text string"


def _seconds(value: str) -> float | None:
    m = re.fullmatch(r"(?:(\d+):)?(\d{1,3}):(\d{2})[.,](\d{1,3})", value.strip())
    if not m or int(m[2]) >= 60 or int(m[3]) >= 60:
        return None
    return int(m[1] or 0) * 3600.0 + int(m[2]) * 60.0 + int(m[3]) + int(m[4].ljust(3, "0")) / 1000.0


def _cues(content: str, zero_length: bool) -> Iterator[tuple[str, float | None, float | None, str]]:
    for block in re.split(r"\n[ \t]*\n", content.lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n")):
        lines = block.strip("\n").split("\n")
        at = next((i for i, line in enumerate(lines) if "-->" in line), None)
        if at is None:
            continue
        m = ARROW.match(lines[at])
        start, end = (_seconds(m[1]), _seconds(m[2])) if m else (None, None)
        text = " ".join(lines[at + 1 :])
        good = start is not None and end is not None and (end > start or zero_length and end == start) and text.strip()
        yield ("cue", start, end, text) if good else ("issue", start, end, lines[at])


def parse_cues(files: DataFrame, *, zero_length: bool = False) -> DataFrame:
    """files (path, content) of WebVTT or SRT -> (path, n, kind, start, end, text), cleaned.

    A malformed cue is a row of kind `issue` with its time line; notes and headers are left out.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(path, n, *cue) for path, content in zip(batch["path"], batch["content"]) for n, cue in enumerate(_cues(content or "", zero_length))]
            yield pd.DataFrame(rows, columns=["path", "n", "kind", "start", "end", "text"])

    found = files.select("path", "content").mapInPandas(work, CUES)
    return found.withColumn("text", F.when(F.col("kind") == "cue", T.clean_caption(F.col("text"))).otherwise(F.col("text")))


def read_caption_files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return parse_cues(files.select("path", F.col("content").cast("string").alias("content")))


def read_link_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files, trimmed, without blank ones and comments; the first of each video, in order."""
    lines = spark.read.text(path).select(T.strip(F.col("value")).alias("url"), F.monotonically_increasing_id().alias("line"))
    return distinct_links(lines.where("url <> '' and not startswith(url, '#')"))


def distinct_links(lines: DataFrame) -> DataFrame:
    """lines (line, url) -> the first of each source_key (youtube:<id>, or the url itself)."""
    video = T.video_id(F.col("url"))
    keyed = lines.withColumn("source_key", F.coalesce(F.concat(F.lit("youtube:"), video), F.col("url")))
    return keyed.withColumn("_n", F.row_number().over(Window.partitionBy("source_key").orderBy("line"))).where("_n = 1").drop("_n")


def parse_asr(payloads: DataFrame) -> DataFrame:
    """payloads (path, content, offset) of JSON with segments and words -> one row a segment, times moved by offset.

    aligned says whether a segment has words; one bad word drops a segment's words and flags it. alignment is that of the
    file: word if a segment has words, else sentence; none of a file without segments, which has one row of nulls.
    """
    schema = "struct<segments: array<struct<start: double, end: double, text: string, words: array<struct<word: string, start: double, end: double>>>>>"
    rows = payloads.select("path", "offset", F.posexplode_outer(F.from_json("content", schema)["segments"]).alias("n", "s"))
    good = F.forall(F.coalesce(F.col("s.words"), F.array().cast("array<struct<word: string, start: double, end: double>>")), lambda w: F.coalesce((w["start"] < w["end"]) & (w["word"] != ""), F.lit(False)))
    n_words = F.when(good, F.size(F.coalesce(F.col("s.words"), F.array().cast("array<struct<word: string, start: double, end: double>>")))).otherwise(0)
    found = rows.select("path", "n", (F.col("s.start") + F.col("offset")).alias("start"), (F.col("s.end") + F.col("offset")).alias("end"), T.strip(F.col("s.text")).alias("text"), n_words.alias("n_words"), (~good).alias("bad_words"))
    whole = Window.partitionBy("path")
    alignment = F.when(F.max("n_words").over(whole) > 0, "word").when(F.max("n").over(whole).isNotNull(), "sentence").otherwise("none")
    return found.withColumn("aligned", F.col("n_words") > 0).withColumn("alignment", alignment)


def parse_ocr_tsv(lines: DataFrame) -> DataFrame:
    """lines (path, line) of a recogniser's table -> (path, text, confidence); headers and short rows are skipped."""
    part = F.split("line", "\t")
    found = lines.where((F.size(part) >= 12) & ~F.col("line").startswith("level\t")).select("path", T.strip(F.get(part, F.lit(11))).alias("text"), F.get(part, F.lit(10)).try_cast("double").alias("_c"))
    return found.where("text <> ''").select("path", "text", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_c") / 100)).alias("confidence"))


def parse_probe(payloads: DataFrame) -> DataFrame:
    """payloads (path, content) of a media probe -> one row a stream."""
    schema = "struct<streams: array<struct<index: int, codec_type: string, codec_name: string, avg_frame_rate: string, tags: struct<language: string>>>>"
    rows = payloads.select("path", F.explode(F.from_json("content", schema)["streams"]).alias("s"))
    return rows.select("path", F.col("s.index").alias("index"), F.col("s.codec_type").alias("codec_type"), F.col("s.codec_name").alias("codec_name"), T.parse_ratio(F.col("s.avg_frame_rate")).alias("fps"), F.coalesce("s.tags.language", F.lit("und")).alias("language"))


@F.pandas_udf(StringType())
def first_json(text: pd.Series) -> pd.Series:
    """The first JSON object in a model's answer (fences and text around it left out); null if it is cut short."""
    decoder = json.JSONDecoder()

    def find(value: str | None) -> str | None:
        at = (value or "").find("{")
        if at < 0:
            return None
        try:
            return json.dumps(decoder.raw_decode(value[at:])[0], ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        except ValueError:
            return None

    return text.map(find)


def choose_track(tracks: DataFrame, keys: list[str], language: Column) -> DataFrame:
    """The best track of each key: sidecar, manual, auto; the wanted language; then as listed (ord)."""
    rank = F.when(F.col("origin") == "sidecar", 0).when(F.col("origin") == "manual", 1).when(F.col("origin") == "auto", 2).otherwise(3)
    fits = tracks.where((F.col("language") == language) | language.isNull())
    return fits.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(rank, "ord"))).where("_n = 1").drop("_n")

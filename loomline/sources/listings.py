"""Sources that list others: candidates, playlists, caption tracks, text regions and validated artifacts."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Languages that are tried after a listing's own, and the formats that can be read, the first preferred.
FALLBACK_LANGUAGES, FORMATS = ("ja", "ja-orig", "en"), ("vtt", "srt")
LANGUAGE = r"^[a-zA-Z]{2,3}(?:-[a-zA-Z0-9]+)*$"


def candidates(*parts: DataFrame) -> DataFrame:
    """Rows (n, url) of several lists, one after the other, with `part`; blank lines and comments are left out."""
    numbered = [p.select(F.lit(i).alias("part"), "n", T.strip(F.col("url")).alias("url")) for i, p in enumerate(parts)]
    return functools.reduce(DataFrame.unionByName, numbered).where("url <> '' and not startswith(url, '#')")


def expanded(rows: DataFrame, playlists: DataFrame) -> DataFrame:
    """The videos of candidates (part, n, url), lists (url, at, video) in place of their url, each video (by its id, else its
    url) once, where it came first: (key, part, n, at, url)."""
    found = rows.join(playlists, "url", "left")
    found = found.select("part", "n", F.coalesce("at", F.lit(0)).alias("at"), F.coalesce("video", "url").alias("url"))
    keyed = found.withColumn("key", F.coalesce(T.video_id(F.col("url")), "url"))
    first = keyed.groupBy("key").agg(F.min(F.struct("part", "n", "at", "url")).alias("x"))
    return first.select("key", "x.*")


def chosen_track(tracks: DataFrame, videos: DataFrame) -> DataFrame:
    """(video, manual, language, format) of the caption track to read of each video (video, language or null).

    tracks: (video, manual, language, format). Manual ones go first; then by language: the video's own, its base, its
    original, fixed ones, others in order; vtt before srt. Without a declared language it is that of the first original
    automatic track.
    """
    originals = tracks.where("not manual and endswith(language, '-orig')").groupBy("video").agg(F.min(F.regexp_replace("language", "-orig$", "")).alias("_orig"))
    own = videos.join(originals, "video", "left").select("video", F.coalesce(F.nullif("language", F.lit("")), "_orig", F.lit("")).alias("_own"))
    preferred = F.concat(F.array(F.col("_own"), F.split("_own", "-")[0], F.concat("_own", F.lit("-orig"))), F.array(*map(F.lit, FALLBACK_LANGUAGES)))
    place = F.array_position(preferred, F.col("language"))
    form = F.array_position(F.array(*map(F.lit, FORMATS)), F.col("format"))
    usable = tracks.where(F.col("language").rlike(LANGUAGE) & F.col("format").isin(*FORMATS)).join(own, "video")
    rank = F.row_number().over(Window.partitionBy("video").orderBy(F.desc("manual"), F.when(place > 0, place).otherwise(99), "language", form))
    return usable.withColumn("_r", rank).where("_r = 1").select("video", "manual", F.regexp_replace("language", "-orig$", "").alias("language"), "format")


REGIONS = "engine string, regions array<struct<bbox: array<double>, text: string, engine: string, confidence: double>>"


def text_regions(results: DataFrame, engine: str) -> DataFrame:
    """Regions of recognised text of frames (frame, asset, json): id ocr-<frame>-0001 and so on, parent, asset, bbox, text
    (stripped), engine (its own, the result's, else the given one) and confidence (0 if missing)."""
    parsed = results.select("frame", "asset", F.from_json("json", REGIONS).alias("r"))
    rows = parsed.select("frame", "asset", F.col("r.engine").alias("_engine"), F.posexplode("r.regions").alias("i", "x"))
    name = F.format_string("ocr-%s-%04d", F.col("frame").cast("string"), F.col("i") + 1)
    none = lambda c: F.nullif(c, F.lit(""))
    return rows.select(name.alias("id"), F.col("frame").alias("parent"), "asset", "x.bbox", T.strip(F.coalesce("x.text", F.lit(""))).alias("text"), F.coalesce(none(F.col("x.engine")), none(F.col("_engine")), F.lit(engine)).alias("engine"), F.coalesce("x.confidence", F.lit(0.0)).alias("confidence"))


def validated(spark: SparkSession, path: str, schema: str, rules: dict[str, Column]) -> DataFrame:
    """A JSON artifact of one schema; a missing folder, a line that does not fit or a row that breaks a rule is an error."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    broken = F.coalesce(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()), F.lit(None).cast("string"))
    return rows.where(F.when(broken.isNotNull(), F.raise_error(F.concat(F.lit("corrupt artifact: "), broken)).cast("boolean")).otherwise(True))

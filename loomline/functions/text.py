"""Text: normalisation, negation, units, numbers, time stamps, tokens, links and digests.

Patterns carry (?U), so that word characters, digits and white space are those of Unicode.
"""

from __future__ import annotations

import html
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values, as the data's producers use them.
CJK_NEGATIONS = ("不是", "不会", "不能", "不要", "并非", "并未", "没有", "从未", "绝不")
NEGATION = r"(?iU)(" + "|".join(CJK_NEGATIONS) + r"|\bnot\b|\bnever\b|\bno\b|n't)"
ENGLISH_NEGATION = r"(?iU)(?:\bnot\b|\bnever\b|\bno\b|\b(?:can|do|does|did|is|are|was|were|will|would|should|could|have|has|had)n't)"
UNITS = r"(?iU)\d+(?:\.\d+)?\s*(?:秒|分钟|小时|度|cm|mm|kg|m/s|%|％)"
UNIT_SIGNS = ("秒", "分钟", "小时", "度", "％")
CJK = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}]"
NUMBER, TEACHING_NUMBER = r"(?U)\d+(?:\.\d+)?", r"(?iU)(?:第\s*\d+|\d+\s*例|用法\s*\d+|例\s*\d+)"
TEMPORAL_MARKERS = ("然后", "接着", "随后", "之后", "step", "then", "after", "before", "next")
STEP = r"(?iU)(?:步骤\s*|step\s+)(\d+)"
PATH = r"""(?iU)(?:^|[\s"'])(?:[A-Za-z]:\\|\\\\|/|\./|\.\./)[^\s"']+\.(?:jpg|jpeg|png|webp|gif|mp4|mkv|mov|webm)"""
SAFE_TIME_LINK, SAFE_LOCAL_LINK = r"^https://www\.youtube\.com/watch\?v=[A-Za-z0-9_-]{1,64}&t=\d+s\z", r"^t=\d+s\z"
SAFE_ASSET_PATH = r"(?i)^(?!/)(?!.*[:\\])(?!.*(?:^|/)\.\.(?:/|$))[A-Za-z0-9._/-]+\.(?:jpg|jpeg|png|webp)\z"
QUALITY_MARKERS = {"draft": "[DRAFT] 待核对，不能当作已核验结论。", "evidence-only": "[EVIDENCE-ONLY] 仅证据索引，不是语义摘要，不能当作已核验结论。"}
QUALITY_PREFIXES = ("[DRAFT]", "[EVIDENCE-ONLY]")
IMAGE_TOKENS, CHARS_PER_TOKEN = 1500, 4


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def strip_negation(text: Column) -> Column:
    return F.regexp_replace(text, NEGATION, " ")


def polarity(text: Column) -> Column:
    return F.when(text.rlike(NEGATION), F.lit("neg")).otherwise(F.lit("pos"))


def normalize_concept(text: Column) -> Column:
    """Without negation, in lower case, without function characters, word runs joined."""
    bare = F.regexp_replace(F.lower(strip_negation(text)), "[是的了與与和]", "")
    return F.regexp_replace(bare, r"(?U)[^\w\x{4e00}-\x{9fff}]+", "")


def has_negation(text: Column) -> Column:
    found = text.rlike(ENGLISH_NEGATION)
    for marker in CJK_NEGATIONS:
        found = found | text.contains(marker)
    return found


def has_units(text: Column) -> Column:
    found = text.rlike(UNITS)
    for sign in UNIT_SIGNS:
        found = found | text.contains(sign)
    return found


def is_temporal(text: Column) -> Column:
    low, found = F.lower(text), F.lit(False)
    for marker in TEMPORAL_MARKERS:
        found = found | low.contains(marker)
    return found


def numbers(text: Column) -> Column:
    """All number literals, in order, with repeats."""
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


def material_numbers(text: Column) -> Column:
    """Number literals but for those that count lessons or examples anywhere in the text."""
    ordinals = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(TEACHING_NUMBER), F.lit(0)), numbers))
    return F.filter(numbers(text), lambda x: ~F.array_contains(ordinals, x))


def step_index(text: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(STEP), F.lit(1)), F.lit(1)).cast("int")


def estimate_tokens(text: Column, images: Column | int = 0) -> Column:
    """One for each CJK character, one for four others, one at least, and IMAGE_TOKENS for each image."""
    images = F.lit(images) if isinstance(images, int) else images
    other = F.length(F.regexp_replace(text, CJK, ""))
    tokens = F.length(text) - other + F.ceil(other / CHARS_PER_TOKEN)
    return (F.greatest(F.lit(1), tokens) + F.greatest(F.lit(0), images) * IMAGE_TOKENS).cast("long")


def script_profile(text: Column) -> Column:
    return F.when(text.rlike(r"[\x{3040}-\x{30FF}\x{3100}-\x{312F}]"), "ja").when(text.rlike(r"[\x{4e00}-\x{9fff}]"), "zh").otherwise("other")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?。！？])"), strip), lambda x: x != "")


def is_path(text: Column) -> Column:
    """Ends like an image or video file, with a slash or backslash somewhere, or has a path to one within."""
    return text.rlike(r"[/\\]") & (text.rlike(PATH) | F.lower(text).rlike(r"\.(?:jpg|jpeg|png|webp|gif|mp4)$"))


def is_safe_time_link(link: Column) -> Column:
    return link.rlike(SAFE_TIME_LINK) | link.rlike(SAFE_LOCAL_LINK)


def is_safe_asset_path(path: Column) -> Column:
    return path.rlike(SAFE_ASSET_PATH)


def marked_notes(label: Column, notes: Column) -> Column:
    """Notes with the marker of their quality label in front, unless they have it; verified ones as they are."""
    found = notes
    for name, marker in QUALITY_MARKERS.items():
        has = notes.contains(marker) | notes.startswith(marker.split("，")[0])
        found = F.when((label == name) & ~has, strip(F.concat(F.lit(marker + " "), notes))).otherwise(found)
    return found


def bare_notes(notes: Column) -> Column:
    """Notes without the first marker or prefix of a quality label."""
    found = notes
    for mark in reversed([*QUALITY_MARKERS.values(), *QUALITY_PREFIXES]):
        found = F.when(notes.startswith(mark), strip(F.substr(notes, F.lit(len(mark) + 1)))).otherwise(found)
    return found


def parse_timestamp(text: Column) -> Column:
    """Seconds of H:MM:SS.mmm or MM:SS.mmm (comma or dot); null if it is neither, or 60 and over."""
    pattern = r"^(?:(\d+):)?(\d{1,3}):(\d{2})[.,](\d{1,3})$"
    bare = strip(text)
    part = [F.regexp_extract(bare, pattern, i) for i in range(1, 5)]
    hours = F.when(part[0] == "", F.lit(0)).otherwise(F.try_to_number(part[0], F.lit("999999")).cast("int"))
    minutes, seconds = part[1].try_cast("int"), part[2].try_cast("int")
    millis = F.rpad(part[3], 3, "0").try_cast("int")
    return F.when(bare.rlike(pattern) & (minutes < 60) & (seconds < 60), hours * 3600.0 + minutes * 60.0 + seconds + millis / 1000.0)


def format_seconds(seconds: Column) -> Column:
    """Three digits without the zeros at the end."""
    return F.regexp_replace(F.format_string("%.3f", seconds), r"\.?0+$", "")


def parse_ratio(text: Column) -> Column:
    """a/b or a number; null if it is none, or b is 0."""
    top, bottom = (F.regexp_extract(text, r"^\s*(-?[\d.]+)\s*(?:/\s*(-?[\d.]+)\s*)?$", i) for i in (1, 2))
    top = top.try_cast("double")
    return F.when(bottom == "", top).otherwise(F.try_divide(top, bottom.try_cast("double")))


def ocr_density(text: Column, width: Column, height: Column) -> Column:
    return F.least(F.lit(1.0), F.length(strip(text)) / F.greatest(F.lit(1.0), width * height / 1000.0))


def video_id(url: Column) -> Column:
    """Id of a watch, short, embed, live or shortened link; null for playlists and other sites."""
    bare = strip(url)
    found = F.coalesce(
        *(
            F.when(bare.rlike(pattern), F.regexp_extract(bare, pattern, 1))
            for pattern in (
                r"^https?://(?:www\.|m\.|music\.)?youtube\.com/watch/?\?(?:[^#]*&)?v=([A-Za-z0-9_-]{11})(?:[&#]|$)",
                r"^https?://(?:www\.|m\.|music\.)?youtube\.com/(?:shorts|embed|live)/([A-Za-z0-9_-]{11})(?:[/?#]|$)",
                r"^https?://youtu\.be/([A-Za-z0-9_-]{11})(?:[/?#]|$)",
            )
        )
    )
    return F.when(~bare.rlike(r"[?&]list="), found)


def seek_link(url: Column, seconds: Column) -> Column:
    """The canonical link at a whole second."""
    return F.concat(F.lit("https://www.youtube.com/watch?v="), video_id(url), F.lit("&t="), F.floor(seconds).cast("string"), F.lit("s"))


def language_of_name(name: Column, given: str = "und") -> Column:
    """The language that is given, if it is one; else the last part between the dots of a file's stem that looks like
    a language (with a dash for an underscore), else its last part of two or three letters; `und` without any."""
    if given and given != "und":
        return F.lit(given)
    stem = F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), r"(?<=.)\.[^.]*\z", "")

    def last(parts: Column, pattern: str) -> Column:
        return F.try_element_at(F.filter(parts, lambda x: x.rlike(pattern)), F.lit(-1))

    dotted = F.replace(last(F.split(stem, r"\."), r"^[A-Za-z]{2,3}(?:[-_][A-Za-z]{2,4})?\z"), F.lit("_"), F.lit("-"))
    return F.coalesce(dotted, last(F.split(stem, r"[._-]"), r"^\p{L}{2,3}\z"), F.lit("und"))


def digest(*parts: Column) -> Column:
    """32 digits of the parts, separated by NUL."""
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 32)


def canonical_json(text: Column) -> Column:
    """The JSON with the keys of its objects in order, no white space, and letters as they are; null of what is no JSON."""
    return F.to_json(F.try_parse_json(text))


def canonical_digest(text: Column) -> Column:
    """SHA-256 of canonical_json(): equal for documents that differ in the order of keys and in white space only."""
    return F.sha2(canonical_json(text), 256)


def request_kind(reason: Column) -> Column:
    low = F.lower(reason)
    unreadable = low.contains("unreadable") | low.contains("ocr") | reason.contains("看不清")
    step = low.contains("missing_step") | low.contains("step") | reason.contains("步骤")
    return F.when(unreadable, "unreadable_text").when(step, "missing_step").otherwise("audio_visual_conflict")


def replace_variants(text: Column, variants: Mapping[str, str]) -> Column:
    """Each variant by its form, the longest first."""
    for variant in sorted(variants, key=lambda x: (-len(x), x)):
        text = F.replace(text, F.lit(variant), F.lit(variants[variant]))
    return text


def rules_match(text: Column, patterns: Mapping[str, str]) -> Column:
    """Names of the rules of a table (name -> pattern) that the text meets, in the table's order."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(name)) for name, p in patterns.items()]))


def rewrite(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Ordered rewrites (pattern, replacement), then white space to single spaces."""
    for pattern, new in rules:
        text = F.regexp_replace(text, pattern, new)
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    """Character references; no built-in function has their table."""
    return text.map(html.unescape, na_action="ignore")


def clean_caption(text: Column) -> Column:
    """Without tags and override blocks, references decoded, white space single."""
    bare = F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", ""), r"\{\\[^}]*\}", "")
    return strip(F.regexp_replace(unescape(bare), r"(?U)\s+", " "))


def distinct_lines(text: Column) -> Column:
    """Lines without later ones that differ in white space only."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    keys = F.transform(lines, lambda x: F.regexp_replace(x, r"(?U)\s+", ""))
    firsts = F.filter(F.transform(F.arrays_zip(lines.alias("line"), keys.alias("key")), lambda x: x), lambda x, i: F.array_position(keys, x["key"]) == i + 1)
    return F.array_join(F.transform(firsts, lambda x: x["line"]), "\n")


#: Markers of a unit's kind, the first that is found decides.
KIND_MARKERS = {"recap": ("回顾", "复习", "recap"), "example": ("例如", "比如", "example"), "procedure": ("步骤", "首先", "step"), "comparison": ("对比", "versus", "vs"), "warning": ("注意", "警告", "warning")}


def kind_of(text: Column) -> Column:
    low, found = F.lower(text), F.lit("concept")
    for name, markers in reversed(KIND_MARKERS.items()):
        hit = F.lit(False)
        for marker in markers:
            hit = hit | low.contains(marker)
        found = F.when(hit, name).otherwise(found)
    return found

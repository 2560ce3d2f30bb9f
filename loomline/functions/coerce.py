"""Permissive reading of JSON text: aliases, identifiers, seconds, id lists and intervals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T


def first_of(raw: Column, names: Sequence[str]) -> Column:
    """The first alias of the object that isn't null, as text."""
    return F.coalesce(*(F.get_json_object(raw, f"$.{n}") for n in names))


def kind_of(raw: Column, name: str) -> Column:
    """JSON type of a field: STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN, ARRAY..., or null."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(raw), f"$.{name}", "variant"))


def identifier(raw: Column, name: str) -> Column:
    """A trimmed text of 1 to 100 characters, or a whole number; never a boolean."""
    value, kind = T.strip(F.get_json_object(raw, f"$.{name}")), kind_of(raw, name)
    return F.when((kind == "BIGINT") | ((kind == "STRING") & F.length(value).between(1, 100)), value)


def seconds(raw: Column, name: str) -> Column:
    """A number or a numeric text, finite and not negative; never a boolean."""
    value, kind = F.get_json_object(raw, f"$.{name}"), kind_of(raw, name)
    number = F.when(~kind.isin("BOOLEAN") & value.rlike(r"^\s*\d+(\.\d+)?\s*$"), F.trim(value).try_cast("double"))
    return F.when(number < float("inf"), number)


def id_list(raw: Column, name: str) -> Column:
    """Ids from a text, a list of texts or numbers, or a list of objects with an id."""
    value = F.get_json_object(raw, f"$.{name}")
    kind = kind_of(raw, name)
    listed = F.coalesce(F.from_json(value, "array<struct<id: string>>")["id"], F.array().cast("array<string>"))
    plain = F.from_json(value, "array<string>")
    many = F.when(kind.startswith("ARRAY<OBJECT"), listed).otherwise(plain)
    found = F.when(kind == "STRING", F.array(value)).when(kind.startswith("ARRAY"), many)
    return F.filter(F.transform(found, T.strip), lambda x: x.isNotNull() & (x != ""))


def interval(raw: Column, start: Column, end: Column, starts: Sequence[str] = ("start_seconds", "start"), ends: Sequence[str] = ("end_seconds", "end")) -> Column:
    """Struct (start, end) from aliases or a list of two; a side that is missing takes the fallback, unless both were given badly."""
    pair = F.from_json(F.get_json_object(raw, "$.interval"), "array<double>")
    s = F.coalesce(*(seconds(raw, n) for n in starts), F.when(F.size(pair) == 2, pair[0]))
    e = F.coalesce(*(seconds(raw, n) for n in ends), F.when(F.size(pair) == 2, pair[1]))
    low, high = F.coalesce(s, start), F.coalesce(e, end)
    return F.when(low < high, F.struct(low.alias("start"), high.alias("end")))


def alias_of(value: Column, aliases: Mapping[str, str], otherwise: str = "concept") -> Column:
    key, found = F.lower(T.strip(value)), F.lit(otherwise)
    for name, kind in aliases.items():
        found = F.when(key == name, F.lit(kind)).otherwise(found)
    return found

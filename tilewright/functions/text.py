"""Text functions of tags and of slide descriptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: how descriptions of slide images begin.
SVS_PREFIX = "Aperio Image"


def ascii_pieces(value: Column) -> Column:
    """Pieces of NUL-separated text; an unterminated tail counts, an empty one does not."""
    parts = F.split(value, "\\x00", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def newlines(value: Column) -> Column:
    """CR LF and lone CR become LF."""
    return F.regexp_replace(value, "\\r\\n?", "\n")


def is_svs(text: Column) -> Column:
    return F.startswith(F.trim(text), F.lit(SVS_PREFIX))


def svs_summary(text: Column) -> Column:
    """What stands before the first bar on the first line that has one, else the last line."""
    lines = F.split(newlines(text), "\n")
    barred = F.filter(lines, lambda line: F.contains(line, F.lit("|")))
    return F.trim(F.when(F.size(barred) > 0, F.substring_index(F.get(barred, F.lit(0)), "|", 1)).otherwise(F.element_at(lines, -1)))


def svs_attributes(text: Column) -> Column:
    """array<struct<key, value>> of the "key = value" parts after bars; of equal keys the last counts."""
    lines = F.split(newlines(text), "\n")
    parts = F.flatten(F.transform(lines, lambda line: F.slice(F.split(line, "\\|"), 2, 1 << 20)))
    pairs = F.transform(F.filter(parts, lambda p: F.contains(p, F.lit("="))), lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("key"), F.trim(F.regexp_replace(p, "^[^=]*=", "")).alias("value")))
    return F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, 1 << 20), lambda q: q["key"] == p["key"]))


def svs_number(text: Column, key: str) -> Column:
    """A numeric attribute, null if absent or not a number."""
    found = F.filter(svs_attributes(text), lambda p: p["key"] == key)
    return F.get(found, F.lit(0))["value"].try_cast("double")


def svs_number_strict(text: Column, key: str) -> Column:
    """A numeric attribute; an error where it is absent or not a number."""
    return F.coalesce(svs_number(text, key), F.raise_error(F.concat(F.lit(f"no number {key} in: "), shorten(F.coalesce(text, F.lit("")), 100))).cast("double"))


def svs_date_time(text: Column) -> Column:
    """The time that the attributes Date (month/day/year) and Time state; null if either is absent or malformed."""
    said = {k: F.get(F.filter(svs_attributes(text), lambda p: p["key"] == k), F.lit(0))["value"] for k in ("Date", "Time")}  # noqa: B023
    return F.try_to_timestamp(F.concat_ws(" ", said["Date"], said["Time"]), F.lit("MM/dd/yy HH:mm:ss"))


def svs_compression_name(compression: Column, photometric: Column) -> Column:
    """How descriptions name a compression; null: they do not."""
    jpeg = F.when(photometric == 2, "JPEG/RGB").otherwise("JPEG/YCbCr")
    return F.when(compression.isin(33003, 33004, 33005, 34712), "J2K").when(compression == 7, jpeg)


def svs_json(text: Column) -> Column:
    """A slide's description as JSON: exists, main, application, summary, attributes, raw (its lines) and pixelSize; null for other texts."""
    lines = F.split(newlines(text), "\n")
    attributes = svs_attributes(text)
    has = lambda key: F.exists(attributes, lambda p: p["key"] == key)
    parts = F.struct(
        F.lit(True).alias("exists"), (has("AppMag") | has("MPP")).alias("main"), F.trim(F.get(lines, F.lit(0))).alias("application"), svs_summary(text).alias("summary"),
        F.map_from_entries(attributes).alias("attributes"), F.transform(lines, lambda line: F.trim(line)).alias("raw"), svs_number(text, "MPP").alias("pixelSize"),
    )
    return F.when(is_svs(text), F.to_json(parts))


def svs_text(summary: Column, attributes: list[tuple[str, Column]]) -> Column:
    """A description: the summary, then "|key = value" for each attribute."""
    return F.concat(F.lit(SVS_PREFIX + "\n"), summary, *[F.concat(F.lit(f"|{k} = "), v.cast("string")) for k, v in attributes])


def json_escape(text: Column) -> Column:
    """A text as the inside of a JSON string."""
    quoted = F.to_json(F.struct(text.alias("v")))
    return quoted.substr(F.lit(7), F.length(quoted) - 8)


def shorten(text: Column, most: int) -> Column:
    """At most `most` characters, then "..."."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)

"""Typed access to directory entries: strict, with a default, or never failing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tags import TAGS
from ..functions.text import newlines


def code(tag: int | str) -> int:
    return TAGS[tag] if isinstance(tag, str) else tag


def first_of(entries: DataFrame, tag: int | str) -> Column:
    """Within a group of a directory's entries: the value of a tag; of duplicates the first counts."""
    return F.min_by(F.when(F.col("tag") == code(tag), F.col("value")), F.when(F.col("tag") == code(tag), F.col("position")))


def number(value: Column, default: int | None = None) -> Column:
    """A value as one integer; null or the default if it is absent or not numeric."""
    got = F.coalesce(F.get(value["i"], F.lit(0)), F.get(value["d"], F.lit(0)).try_cast("bigint"))
    return got if default is None else F.coalesce(got, F.lit(default).cast("bigint"))


def required(value: Column, name: str) -> Column:
    """A value as one integer; the query fails if there is none."""
    return F.coalesce(number(value), F.raise_error(F.lit(f"tag {name} is missing or not a number")).cast("bigint"))


def numbers(value: Column) -> Column:
    return F.coalesce(value["i"], F.transform(value["d"], lambda d: d.try_cast("bigint")))


def text(value: Column) -> Column:
    """Text, several pieces joined by line feeds, with any line end as LF; bytes count as text."""
    return newlines(F.coalesce(F.array_join(value["s"], "\n"), F.decode(value["b"], "UTF-8")))


def ratio(value: Column) -> Column:
    """The first rational as a double; infinite or NaN where the denominator is 0."""
    r = F.get(value["r"], F.lit(0))
    n, d = r["num"].cast("double"), r["den"].cast("double")
    return F.when(d != 0, n / F.nullif(d, F.lit(0.0))).when(n > 0, float("inf")).when(n < 0, float("-inf")).when(r.isNotNull(), float("nan"))


def columns(entries: DataFrame, **tags: int | str) -> DataFrame:
    """A row a directory with the raw value of each named tag."""
    return entries.groupBy("path", "global_index").agg(*[first_of(entries, t).alias(n) for n, t in tags.items()])


def formatted(samples: Column, style: str = "decimal", separator: str = ", ", most: int = 100, high: float = 255.0) -> Column:
    """Samples as text: decimal, hex or normalized; after `most` of them "..."."""
    show = {"decimal": lambda v: v.cast("bigint").cast("string"), "hex": lambda v: F.hex(v.cast("bigint")), "normalized": lambda v: F.format_string("%.4f", v / high)}[style]
    body = F.array_join(F.transform(F.slice(samples, 1, most), show), separator)
    return F.when(F.size(samples) > most, F.concat(body, F.lit(separator + "..."))).otherwise(body)

"""Conversions of the format as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platter import layout as L

#: Fixed value: ticks of 100 ns from 1601-01-01 to 1970-01-01.
EPOCH_TICKS = 116444736000000000


def filetime(ticks: Column) -> Column:
    """Timestamp of 100 ns ticks since 1601; the last digit is lost."""
    return F.timestamp_micros(_div(ticks - F.lit(EPOCH_TICKS).cast("bigint"), 10))


def _div(x: Column, by: int) -> Column:
    return F.call_function("div", x, F.lit(by).cast("bigint"))


def media_tag_type(data_type: Column) -> Column:
    """Media tag type of a data type, -1 where it is none."""
    out = F.lit(-1)
    for first, last, tag in L.TAG_RUNS:
        out = F.when(data_type.between(first, last), data_type - first + tag).otherwise(out)
    return out.cast("int")


def media_class(media_type: Column) -> Column:
    optical = F.lit(False)
    for first, last in L.OPTICAL_RUNS:
        optical = optical | media_type.between(first, last)
    return F.when(optical, "optical disc").otherwise("block media")


def identify(content: Column) -> Column:
    """100 for bytes that start like an image of a known version, else 0; null is 0."""
    magic = F.substring(content, 1, 8).isin(*[F.lit(m) for m in L.MAGICS])
    major = F.conv(F.hex(F.substring(content, 9 + 64, 1)), 16, 10).cast("int")
    return F.when((F.octet_length(content) >= L.HEADER.size) & magic & (major <= L.NEWEST_MAJOR), 100).otherwise(0)


def hexdump(df: DataFrame, column: str, width: int = 16) -> DataFrame:
    """A row per width bytes of a binary column: other columns, offset, hexadecimal digits, printable characters or dots."""
    size = F.octet_length(column)
    starts = F.when(size > 0, F.sequence(F.lit(0), size - 1, F.lit(width))).otherwise(F.array().cast("array<int>"))
    lines = df.withColumn("at", F.explode(starts))
    part = F.substring(F.col(column), F.col("at") + 1, F.lit(width))
    digits = F.hex(part)
    codes = F.transform(F.sequence(F.lit(0), F.octet_length(part) - 1), lambda k: F.conv(F.substring(digits, 2 * k + 1, F.lit(2)), 16, 10).cast("int"))
    shown = F.array_join(F.transform(codes, lambda c: F.when(c.between(32, 126) | (c >= 160), F.chr(c)).otherwise(".")), "")
    spaced = F.trim(F.regexp_replace(digits, "(..)", "$1 "))
    return lines.select(*[c for c in df.columns if c != column], F.lower(F.lpad(F.hex("at"), 8, "0")).alias("offset"), spaced.alias("bytes"), shown.alias("shown"))

"""What a file path says about its content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN_YEAR = "unknown"


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    """Name without its last extension (a leading dot is no extension)."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def file_year(path: Column) -> Column:
    """First path component of four digits, else characters 4-7 of the stem, else unknown."""
    component = F.nullif(F.regexp_extract(path, r"(?:^|/)(\d{4})(?=/|$)", 1), F.lit(""))
    from_stem = F.nullif(F.regexp_extract(file_stem(path), r"^.{3}(\d{4}).{2}", 1), F.lit(""))
    return F.coalesce(component, from_stem, F.lit(UNKNOWN_YEAR))


def issue_year(path: Column) -> Column:
    return F.substring(file_stem(path), 4, 4).try_cast("int")


def issue_number(path: Column) -> Column:
    """All digits after the year: three in most names, more once a year passes 999 issues."""
    digits = F.regexp_extract(file_stem(path), r"^.{7}(\d+)", 1)
    return F.nullif(digits, F.lit("")).try_cast("int")

"""Paths, names and sizes as column expressions."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column
from pyspark.sql import functions as F

from framewell.config import EXCLUDED_DIRS, EXTENSIONS


def split_list(text: str | None) -> list[str]:
    """Values of a comma-separated option, trimmed; none for an empty one."""
    return [x.strip() for x in (text or "").split(",") if x.strip()]


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(name: Column) -> Column:
    """Lower-case text after the last dot; '' without one. A name that begins with its only dot counts as all extension."""
    return F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))


def stem(name: Column) -> Column:
    """The name without its extension; a leading dot belongs to the stem."""
    return F.regexp_replace(name, r"(?<=[^.])[.][^.]*$", "")


def suffix(name: Column) -> Column:
    return F.substring(name, F.length(stem(name)) + 1, F.length(name))


def allowed_extension(ext: Column, extensions: list[str] | None = None) -> Column:
    return ext.isin([x.lower().lstrip(".") for x in (extensions or EXTENSIONS)])


def in_excluded_dir(relative: Column, more: list[str] | None = None) -> Column:
    """True where a directory between the root and the file is excluded, in any case; the root itself is not asked."""
    names = {x.lower() for x in (*EXCLUDED_DIRS, *(more or []))}
    parts = F.split(F.lower(relative), "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, sorted(names))))


def format_size(n: Column) -> Column:
    """B as it is, KB and MB with one decimal, GB with two, halves to even; what is no number is 0 B."""
    n = n.try_cast("long")
    k, m, g = 1 << 10, 1 << 20, 1 << 30
    return (
        F.when(n.isNull(), F.lit("0 B"))
        .when(n < k, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < m, F.format_string("%.1f KB", F.bround(n / F.lit(k), 1)))
        .when(n < g, F.format_string("%.1f MB", F.bround(n / F.lit(m), 1)))
        .otherwise(F.format_string("%.2f GB", F.bround(n / F.lit(g), 2)))
    )


def normalised(path: str) -> str:
    out = posixpath.normpath(path)
    return "/" + out.lstrip("/") if out.startswith("/") else out

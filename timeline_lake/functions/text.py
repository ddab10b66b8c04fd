"""Slugs, compound ids, paths and time texts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from timeline_lake.functions._columns import ColumnOrName, col


def accented_letters() -> tuple[str, str]:
    """Latin letters that decompose into a base letter and marks, and those base letters."""
    import unicodedata

    found = []
    for block in (range(0x00C0, 0x0250), range(0x1E00, 0x1F00)):
        for code in block:
            base = unicodedata.normalize("NFD", chr(code))[0]
            if base != chr(code):
                found.append((chr(code), base))
    return "".join(a for a, _ in found), "".join(b for _, b in found)


def fold_marks(text: ColumnOrName) -> Column:
    """Strip diacritics: accented Latin letters become their base letter, loose combining marks vanish."""
    accented, base = accented_letters()
    return F.regexp_replace(F.translate(col(text), accented, base), "\\p{Mn}", "")


def slugify(text: ColumnOrName) -> Column:
    """Lower-case ASCII letters and digits with single hyphens between runs; `untitled` when nothing is left."""
    dashed = F.regexp_replace(F.lower(fold_marks(text)), "[^a-z0-9]+", "-")
    trimmed = F.regexp_replace(dashed, "^-|-$", "")
    return F.when(trimmed == "", F.lit("untitled")).otherwise(trimmed)


def file_stem(path: ColumnOrName) -> Column:
    return F.regexp_replace(F.element_at(F.split(col(path), "/"), -1), "(?<=.)\\.[^.]*$", "")


def parent_name(path: ColumnOrName) -> Column:
    """Name of the folder a path lies in; empty for a bare file name."""
    parts = F.split(col(path), "/")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.lit(""))


def project_slug_of(path: ColumnOrName) -> Column:
    return slugify(parent_name(path))


def source_slug_of(path: ColumnOrName) -> Column:
    return slugify(file_stem(path))


def split_compound_id(value: ColumnOrName) -> Column:
    """Struct (project, source) of `project/source`, parted once: `a//b` gives `/b`; null without two non-empty parts."""
    pattern = "(?s)^/*([^/]+)/(.+)$"
    return F.when(
        col(value).rlike(pattern),
        F.struct(F.regexp_extract(col(value), pattern, 1).alias("project"), F.regexp_extract(col(value), pattern, 2).alias("source")),
    )


def minute_text(seconds: ColumnOrName) -> Column:
    """`m:ss.ss`, as transcript documents show times."""
    minutes = F.floor(col(seconds) / 60).cast("long")
    return F.format_string("%d:%05.2f", minutes, col(seconds) - minutes * 60)

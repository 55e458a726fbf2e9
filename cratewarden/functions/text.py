"""Column functions on paths, names and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..refdata import LICENSE_SPELLINGS, NAME_SUFFIXES


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case text after the last dot; null without a dot, or for a dot-file with no further one."""
    name = basename(path)
    found = F.regexp_extract(name, r"^.+\.([^.]*)$", 1)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.lower(found))


def clean_name(path: Column) -> Column:
    """The name without known suffixes, each stripped at most once and in order, and with other characters as _."""
    name = basename(path)
    for suffix in NAME_SUFFIXES:
        name = F.regexp_replace(name, suffix.replace(".", r"\.") + "$", "")
    return F.regexp_replace(name, "[^a-zA-Z0-9._-]", "_")


def format_bytes(size: Column) -> Column:
    """Bytes, whole kilobytes (rounded), or mega- and gigabytes with one decimal, in integer arithmetic."""

    def tenths(unit: int) -> Column:
        n = F.floor((size * 10 + unit // 2) / unit)
        return F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))

    kilo, mega, giga = 1 << 10, 1 << 20, 1 << 30
    return (
        F.when(size < kilo, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < mega, F.concat(F.floor((size + kilo // 2) / kilo).cast("string"), F.lit(" KB")))
        .when(size < giga, F.concat(tenths(mega), F.lit(" MB")))
        .otherwise(F.concat(tenths(giga), F.lit(" GB")))
    )


def lines(text: Column) -> Column:
    """Newlines in a text, as `wc -l` counts them."""
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long")


def normalise_license(name: Column) -> Column:
    """Informal spellings of common licenses as SPDX identifiers; the first that fits counts."""
    out = F.when(F.lit(False), name)
    for pattern, spdx in LICENSE_SPELLINGS:
        out = out.when(name.rlike(pattern), F.lit(spdx))
    return out.otherwise(name)


def normalise_name(name: Column) -> Column:
    """Lower case, without scope or vendor, and without - and _."""
    bare = F.regexp_replace(F.lower(name), r"^.*/", "")
    return F.translate(bare, "-_", "")


def normalise_composer(name: Column) -> Column:
    """As `normalise_name`, but with the vendor kept as it is."""
    low = F.lower(name)
    return F.concat(F.substring_index(low, "/", 1), F.lit("/"), F.translate(F.regexp_replace(low, r"^[^/]*/", ""), "-_", ""))


def risk_level(score: Column) -> Column:
    return F.when(score >= 1000, "CRITICAL").when(score >= 500, "HIGH").when(score >= 100, "MEDIUM").otherwise("LOW")


def listed(*when: Column) -> Column:
    """Those of the given strings that aren't null, as an array in order."""
    return F.filter(F.array(*when), lambda x: x.isNotNull())

"""Names and keys: subject ids from folder names, outcome keys, setting codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _words(name: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(name, "_", " ")), r"\s+")


def subject_key(folder: Column) -> Column:
    """The folder name without its last two words, or without its last one if nothing else would be left."""
    words = _words(folder)
    n = F.size(words)
    kept = F.when(n > 2, n - 2).otherwise(F.greatest(n - 1, F.lit(0)))
    return F.array_join(F.slice(words, F.lit(1), kept), " ")


def slide_number(folder: Column) -> Column:
    """The word before the last; null if there is none."""
    return F.try_element_at(_words(folder), F.lit(-2))


def outcome_key(name: Column) -> Column:
    """What stands before ' - '."""
    return F.trim(F.get(F.split(name.cast("string"), " - "), 0))


def repaired_key(key: Column) -> Column:
    return F.replace(key, F.lit(" "), F.lit("-"))


def setting_code(share: Column) -> Column:
    """0.5 as 05, 1.2 as 12."""
    return F.lpad((share * 10).cast("int").cast("string"), 2, "0")


def short_label(name: Column, pairs: dict[str, str], strip: str = " ") -> Column:
    """Replacements in the given order, then the characters of ``strip`` off both ends."""
    for old, new in pairs.items():
        name = F.replace(name, F.lit(old), F.lit(new))
    return F.btrim(name, F.lit(strip))

"""Cleaning rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for "no value", case-sensitive.
SENTINELS = ("", "-", "nan", "None")
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def np_round(c: Column, digits: int) -> Column:
    """Half to even on the scaled value, as NumPy rounds."""
    return F.rint(c * 10.0**digits) / 10.0**digits if digits else F.rint(c)


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def no_sentinel(c: Column) -> Column:
    s = strip(c)
    return F.when(s.isin(*SENTINELS), None).otherwise(s)


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def tags_list(c: Column, mark: str = "|") -> Column:
    """The tags of a text, in order, without empty ones."""
    return F.filter(F.split(c, f"[{mark}]"), lambda t: t != "")


def tags_text(tags: Column) -> Column:
    """Tags as one text, joined by |."""
    return F.array_join(tags, "|")


def hundreds_path(hz: Column, name: Column) -> Column:
    """The path of a recording by its band of a hundred Hz."""
    low = F.floor(hz / 100).cast("long") * 100
    return F.format_string("audio/%d-%d/%s.wav", low, low + 100, name.cast("string"))


def to_number(c: Column) -> Column:
    """A finite number where the text is one, else null."""
    text = c.cast("string")
    return finite(F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double")))


def finite(c: Column) -> Column:
    """Null for what is no number or beyond all numbers."""
    return F.when(F.abs(c) < float("inf"), c)


def band(peak: Column) -> Column:
    return F.when(peak < 200, "Low").when(peak < 1000, "Mid").otherwise("High")

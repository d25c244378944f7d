"""Text expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_WORD = r"[^\p{L}\p{N}_]+"
SHORTEST_TOKEN = 2


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def piece_count(text: Column, separator: str) -> Column:
    """Pieces between literal separators; a text without one is one piece."""
    return F.size(F.split(text, re.sub(r"([^\w\s])", r"\\\1", separator), -1))


def first_number(text: Column) -> Column:
    """The first run of digits and dots as a number; NULL if it is none."""
    found = F.regexp_extract(text, r"[0-9.]+", 0)
    return F.when(found.rlike(r"^(\d+\.?\d*|\.\d+)$"), found.try_cast("double"))


def cleaned(text: Column) -> Column:
    """Lower case, no outer white space, only a-z, 0-9 and white space."""
    stripped = F.regexp_replace(F.lower(text), r"^\s+|\s+$", "")
    return F.regexp_replace(stripped, r"[^a-z0-9\s]", "")


def hash_bucket(text: Column, buckets: int) -> Column:
    """A bucket in [0, buckets) that is the same on every executor and in every run."""
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % buckets).cast("long")


def tokens(text: Column) -> Column:
    """Lower-case runs of word characters. Runs of one character, which are no tokens, are still among them."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), NO_WORD)

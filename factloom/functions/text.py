"""Text helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the original strips it, for a character class of Java and of DuckDB. Fixed values.
WHITE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
STRIP = rf"^[{WHITE}]+|[{WHITE}]+\z"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, STRIP, "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, rf"[{WHITE}]+\z", "")

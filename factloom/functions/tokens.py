"""Token estimates and text cuts. Two estimates exist and differ on empty text; they are not unified."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ELLIPSIS = "…"


def approx_tokens(text: Column) -> Column:
    """0 for empty text, else a quarter of its code points, 1 at least."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("long")


def tokens_or_one(text: Column) -> Column:
    """A quarter of the code points, 1 at least, also for empty text."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)).cast("long")


def cut(text: Column, most: int) -> Column:
    """Text of at most ``most`` characters, the last an ellipsis if it was longer."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 1)), F.lit(ELLIPSIS))).otherwise(text)


def truncate_to_tokens(text: Column, tokens: Column) -> Column:
    """Empty if there are no tokens; else four characters a token, the last an ellipsis if text is lost."""
    most = (tokens * 4).cast("int")
    short = F.concat(F.left(text, most - 1), F.lit(ELLIPSIS))
    return F.when(tokens <= 0, F.lit("")).when(F.length(text) > most, short).otherwise(text)

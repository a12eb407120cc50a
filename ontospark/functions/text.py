"""Text as the tables compare it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def term_key(text: Column) -> Column:
    """Lower case, trimmed, runs of spaces, tabs and line breaks as one space; null stays null."""
    return F.lower(F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " ")))

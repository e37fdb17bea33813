"""Error signatures and glob patterns as Spark expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def signature(code: Column, failure: Column, response: Column) -> Column:
    """What an error message is grouped by: numbers and hexadecimal runs masked, white space squeezed, 120 characters."""
    message = F.when(F.coalesce(failure, F.lit("")) != "", failure).otherwise(F.coalesce(response, F.lit("")))
    masked = F.regexp_replace(F.lower(message), "[0-9a-f]{4,}|[0-9]+", "#")
    return F.concat(F.coalesce(code, F.lit("")), F.lit(" | "), F.substring(F.trim(F.regexp_replace(masked, r"\s+", " ")), 1, 120))


def glob_regex(pattern: str) -> str:
    """An anchored pattern: * is any run, ? one character, the rest literal."""
    parts = (".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    return f"(?s)^{''.join(parts)}$"

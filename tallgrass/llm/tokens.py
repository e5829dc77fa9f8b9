"""Token counts by the public word-punctuation rule, on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters, digits and underscores in a run, or other non-blank characters in a run. Java's blanks lack
# the four separators U+001C to U+001F, which the rule's Unicode classes count as blank.
TOKEN = r"(?U)[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x1c-\x1f]+"


def token_count(text: Column) -> Column:
    """Number of tokens of a text; null and blank text have none."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0))

"""Words: unbroken runs of letters or digits of any alphabet, lower-cased."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java and Python spellings of one word; underscore separates words.
WORD_JAVA = r"[\p{L}\p{N}]+"
WORD_PY = r"[^\W_]+"


def words(text: Column) -> Column:
    """All words in order; a null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD_JAVA), F.lit(0))


def compact(text: Column) -> Column:
    """All words of a text written together; empty for null or wordless texts."""
    return F.array_join(words(text), "")

"""Text expressions. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_PATTERN = r"\p{L}+"
SURFACE_PATTERN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
# A utf8 character has at most four bytes, so a cut leaves at most three behind.
MAX_CUT_BYTES = 3


def alphabetic_words(text: Column) -> Column:
    """Lower-cased runs of letters, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0))


def surface_tokens(text: Column) -> Column:
    """Words and numbers as written, and every punctuation mark on its own."""
    return F.regexp_extract_all(text, F.lit(SURFACE_PATTERN), F.lit(0))


def first_bytes(text: Column, max_length: int | None) -> Column:
    """At most ``max_length`` utf8 bytes of ``text``, never ending inside a character."""
    if max_length is None:
        return text
    # As many characters hold at least as many bytes.
    raw = F.encode(F.substring(text, 1, max_length), "utf-8")
    tries = [
        F.try_validate_utf8(F.substring(raw, 1, max(max_length - cut, 0)).cast("string"))
        for cut in range(MAX_CUT_BYTES + 1)
    ]
    broken = F.raise_error(F.lit("text is not valid utf8"))
    return F.when(text.isNotNull(), F.coalesce(*tries, broken))

"""Word splitting: each token is a word with the separators that follow it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word characters are ASCII letters and digits and all that is not ASCII.
WORD = r"A-Za-z0-9\x{80}-\x{10FFFF}"
TOKEN_PATTERN = f"^[^{WORD}]+|[{WORD}]+[^{WORD}]*"

Splitter = Callable[[Column], Column]


def tokens(text: Column) -> Column:
    """Leading separators form a token of their own; the tokens concatenate to the text."""
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def join_tokens(parts: Column) -> Column:
    return F.array_join(parts, "")


def longest_token(parts: Column) -> Column:
    """Bytes of the longest token and the position (from 0) of the first that long."""
    lengths = F.transform(parts, F.octet_length)
    most = F.array_max(lengths)
    return F.struct(F.size(parts).alias("word_count"), most.alias("max_word_len"), (F.array_position(lengths, most) - 1).alias("max_word_pos"))


def bare_word(token: Column) -> Column:
    """A token without the separators that follow it."""
    return F.regexp_extract(token, f"^[{WORD}]+", 0)

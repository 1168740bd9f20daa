"""Words as searches take them: runs of ASCII letters and digits and of all that is beyond ASCII, A-Z lower-cased."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Bytes of a text that are split into words at a time.
BLOCK = 1 << 20

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_list(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    return F.coalesce(F.regexp_extract_all(lowered(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def flattened(text: str | None) -> bytes:
    """The text's bytes in their places: words lower-cased, all else spaces."""
    return (text or "").encode().translate(_LETTERS)


def word_blocks(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, block by block, so that a very long text is never a list of words as a whole."""
    raw, at = flattened(text), 0
    while at < len(raw):
        end = raw.find(b" ", at + BLOCK)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end

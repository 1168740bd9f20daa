"""Text functions with the Unicode rules of Python's str and re, as Spark expressions.

Java counts combining marks (Thai vowels and tones) as word characters and its trim knows
only the space; the classes here follow Python instead.
"""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that Python counts as white space, singly and as a class to be used under (?U).
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = r"[\s\x{1c}-\x{1f}]"
#: Word boundaries before and after a word character, and a decimal digit.
WORD_START, WORD_END, DIGIT = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])", r"\p{Nd}"
#: Where a line ends.
NEWLINE = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def without_space(text: Column) -> Column:
    return F.translate(text, SPACES, "")


def single_spaces(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U){SPACE}+", " ")


def split_lines(text: Column) -> Column:
    """Lines without their ends; a last empty piece is no line."""
    parts = F.split(text, NEWLINE, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def first_match(text: Column, pattern: str) -> Column:
    """The leftmost match, null without one."""
    return F.regexp_substr(text, F.lit(pattern))


def file_name(path: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(path, r"/+\z", ""), r"[^/]*\z", 0)


def file_suffix(path: Column) -> Column:
    """The last suffix with its dot; none for names that only begin with one."""
    return F.regexp_extract(file_name(path), r"\A.*[^.](\.[^.]+)\z", 1)


def file_stem(path: Column) -> Column:
    name = file_name(path)
    return F.substring(name, 1, F.length(name) - F.length(file_suffix(path)))


#: Suffixes of images.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff", ".webp")


def is_image(path: Column) -> Column:
    return F.lower(file_suffix(path)).isin(*IMAGE_SUFFIXES)


def is_pdf(path: Column) -> Column:
    return F.lower(file_suffix(path)) == ".pdf"


_DIGITS = [chr(c) for c in range(128, sys.maxunicode) if unicodedata.category(chr(c)) == "Nd"]


def whole_number(digits: Column) -> Column:
    """The number that digits of any script stand for."""
    plain = F.translate(digits, "".join(_DIGITS), "".join(str(unicodedata.digit(d)) for d in _DIGITS))
    return plain.cast("int")

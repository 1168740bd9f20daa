"""Recognition accuracy: character and word error rates against a reference text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.edits import edit_distance
from pagewright.functions.text import strip

#: Product of lengths up to which the built-in distance is the quicker one.
SHORT_CELLS = 1 << 16


def normalized(text: Column) -> Column:
    """Carriage returns are newlines, runs of blanks one space, three newlines and more two; stripped."""
    text = F.regexp_replace(F.replace(text, F.lit("\r"), F.lit("\n")), "[ \t]+", " ")
    return strip(F.regexp_replace(text, "\n{3,}", "\n\n"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once a row, however often it is used and also by the elements of arrays."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _rate(distance: Column, length: Column, other: Column) -> Column:
    return F.when(length > 0, distance / length).otherwise(F.when(other > 0, 1.0).otherwise(0.0))


def char_error_rate(reference: Column, prediction: Column) -> Column:
    """Edit distance of the normalized texts without spaces, per character of the reference. Over 1 is possible.

    Long pairs are counted bit-parallel, which gives the same number.
    """
    ref, hyp = (F.replace(normalized(x), F.lit(" "), F.lit("")) for x in (reference, prediction))
    short = lambda a, b: F.length(a).cast("long") * F.length(b) <= SHORT_CELLS
    long = edit_distance(F.when(~short(ref, hyp), ref), F.when(~short(ref, hyp), hyp))
    distance = lambda p: F.when(short(p["a"], p["b"]), F.levenshtein(p["a"], p["b"])).otherwise(p["long"])
    return _once(F.struct(ref.alias("a"), hyp.alias("b"), long.alias("long")), lambda p: _rate(distance(p), F.length(p["a"]), F.length(p["b"])))


def words(text: Column, tokenizer: str = "compat") -> Column:
    """Words of a normalized text.

    compat: runs of two or more white space characters count as one space, and words are
    what spaces separate, so a lone newline is part of a word. whitespace: any run separates.
    """
    if tokenizer not in ("compat", "whitespace"):
        raise ValueError(f"unknown tokenizer: {tokenizer}")
    run = r"(?U)\s{2,}" if tokenizer == "compat" else r"(?U)\s+"
    return F.filter(F.split(strip(F.regexp_replace(text, run, " ")), " ", -1), lambda w: w != "")


def _letters(mine: Column, every: Column) -> Column:
    """Each word as one private code point, its rank among all words of the pair."""
    code = lambda w: F.decode(F.unhex(F.lpad(F.hex(65535 + F.array_position(every, w)), 8, "0")), "UTF-32")
    return F.array_join(F.transform(mine, code), "")


def word_error_rate(reference: Column, prediction: Column, tokenizer: str = "compat") -> Column:
    """Edit distance in words per word of the reference, of normalized texts; of long pairs bit-parallel."""
    ref, hyp = (words(normalized(x), tokenizer) for x in (reference, prediction))
    short = lambda a, b: F.size(a).cast("long") * F.size(b) <= SHORT_CELLS
    long = edit_distance(F.when(~short(ref, hyp), ref), F.when(~short(ref, hyp), hyp))
    native = lambda a, b: _once(F.array_distinct(F.concat(a, b)), lambda every: F.levenshtein(_letters(a, every), _letters(b, every)))
    distance = lambda p: F.when(short(p["a"], p["b"]), native(p["a"], p["b"])).otherwise(p["long"])
    return _once(F.struct(ref.alias("a"), hyp.alias("b"), long.alias("long")), lambda p: _rate(distance(p), F.size(p["a"]), F.size(p["b"])))


def evaluation(file: Column, reference: Column, prediction: Column, tokenizer: str = "compat") -> list[Column]:
    """Columns of one result: file, cer, wer, exact_match, reference_chars, prediction_chars."""
    ref, hyp = normalized(reference), normalized(prediction)
    return [
        file.alias("file"),
        char_error_rate(reference, prediction).alias("cer"),
        word_error_rate(reference, prediction, tokenizer).alias("wer"),
        (ref == hyp).alias("exact_match"),
        F.length(ref).alias("reference_chars"),
        F.length(hyp).alias("prediction_chars"),
    ]

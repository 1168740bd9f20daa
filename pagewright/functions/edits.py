"""Edit distance of long sequences, bit-parallel, with a threshold and with counts of edits.

A column of the table of distances is held as two numbers of as many bits as the one
sequence is long, the places where it rises and where it falls; each element of the other
sequence moves it on by a dozen operations on whole numbers. So the work is the product of
the lengths over the bits of a machine word, and memory is a few times the lengths.

Counts of edits come from a way back through the columns. Where those are too many to keep,
the sequence is halved: the columns of both halves, one read from its end, say where the way
crosses the middle.
"""

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of columns that are kept for a way back.
KEPT = 1 << 24

COUNTS = "distance int, substitutions int, deletions int, insertions int"


def _places(pattern: Sequence) -> dict:
    """For each element, the bits of its places."""
    if len(pattern) < 512:
        bits: dict = {}
        for i, c in enumerate(pattern):
            bits[c] = bits.get(c, 0) | 1 << i
        return bits
    where: dict = {}
    for i, c in enumerate(pattern):
        where.setdefault(c, []).append(i)
    out = {}
    for c, at in where.items():
        marks = np.zeros(len(pattern), np.uint8)
        marks[at] = 1
        out[c] = int.from_bytes(np.packbits(marks, bitorder="little").tobytes(), "little")
    return out


def _columns(pattern: Sequence, text: Sequence, most: int | None = None, keep: list | None = None) -> tuple[int, int, int] | None:
    """Rises and falls of the last column, and its last value; None once that must be over `most`. keep gets all columns."""
    m, places = len(pattern), _places(pattern)
    full, last = (1 << m) - 1, 1 << (m - 1)
    up, down, value = full, 0, m
    for left, c in zip(range(len(text) - 1, -1, -1), text, strict=True):
        same = places.get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        right_up = down | (full ^ ((diagonal | up) & full))
        right_down = diagonal & up
        if right_up & last:
            value += 1
        elif right_down & last:
            value -= 1
        if most is not None and value - left > most:
            return None
        right_up = (right_up << 1 | 1) & full
        up = ((right_down << 1) & full) | (full ^ ((diagonal | right_up) & full))
        down = right_up & diagonal
        if keep is not None:
            keep.append((up, down))
    return up, down, value


def _bare(a: Sequence, b: Sequence) -> tuple[Sequence, Sequence]:
    """a and b without what they begin and end with alike."""
    n, s = min(len(a), len(b)), 0
    while s < n and a[s] == b[s]:
        s += 1
    e = 0
    while e < n - s and a[len(a) - 1 - e] == b[len(b) - 1 - e]:
        e += 1
    return a[s : len(a) - e], b[s : len(b) - e]


def distance(a: Sequence, b: Sequence, most: int | None = None) -> int | None:
    """The least number of edits that make b of a; None if it is over `most`."""
    if most is not None and abs(len(a) - len(b)) > most:
        return None
    a, b = _bare(a, b)
    if len(a) < len(b):
        a, b = b, a
    if not len(b):
        return len(a)
    found = _columns(a, b, most)
    return found and found[2]


def _values(pattern: Sequence, text: Sequence) -> np.ndarray:
    """The last column: distances of all beginnings of the pattern to the text."""
    if not len(pattern):
        return np.array([len(text)])
    up, down, _ = _columns(pattern, text)
    bits = lambda x: np.unpackbits(np.frombuffer(x.to_bytes(len(pattern) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(pattern)].astype(np.int64)
    return len(text) + np.concatenate([[0], np.cumsum(bits(up) - bits(down))])


def counts(a: Sequence, b: Sequence) -> tuple[int, int, int]:
    """Substitutions, deletions and insertions of one shortest way from a to b."""
    todo, total = [(a, b)], np.zeros(3, np.int64)
    while todo:
        a, b = _bare(*todo.pop())
        if not len(a) or not len(b):
            total += (0, len(a), len(b))
        elif len(b) == 1:  # one element: found in a, or put for one of a's
            total += (0, len(a) - 1, 0) if b[0] in a else (1, len(a) - 1, 0)
        elif len(a) * len(b) <= KEPT:
            total += _way_back(a, b)
        else:
            half = len(b) // 2
            i = int((_values(a, b[:half]) + _values(a[::-1], b[half:][::-1])[::-1]).argmin())
            todo += [(a[:i], b[:half]), (a[i:], b[half:])]
    return tuple(total.tolist())


def _way_back(a: Sequence, b: Sequence) -> tuple[int, int, int]:
    columns: list = []
    _columns(a, b, keep=columns)
    i, j, put, gone, new = len(a), len(b), 0, 0, 0
    while i and j:
        bit = 1 << (i - 1)
        if columns[j - 1][0] & bit:
            gone += 1
            i -= 1
            continue
        j -= 1
        if j and columns[j - 1][1] & bit:
            new += 1
        else:
            i -= 1
            put += a[i] != b[j]
    return put, gone + i, new + j


def _plain(x) -> Sequence | None:
    return x if x is None or isinstance(x, str) else list(x)


def edit_distance(reference: Column, prediction: Column, most: int | None = None) -> Column:
    """Edits between two texts, in characters, or two arrays, in elements; null for a null, or if over `most`."""

    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        made = [None if x is None or y is None else distance(_plain(x), _plain(y), most) for x, y in zip(a, b, strict=True)]
        return pd.Series(made, dtype="Int32")

    return F.pandas_udf(of, "int")(reference, prediction)


def edit_counts(reference: Column, prediction: Column) -> Column:
    """distance, substitutions, deletions, insertions (see COUNTS) of one shortest way from reference to prediction; null for a null.

    Their sum is the distance, and deletions less insertions are the difference in length;
    which of several shortest ways is counted is not defined, but always the same.
    """

    def of(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(a, b, strict=True):
            if x is None or y is None:
                rows.append((None,) * 4)
                continue
            made = counts(_plain(x), _plain(y))
            rows.append((sum(made), *made))
        return pd.DataFrame(rows, columns=["distance", "substitutions", "deletions", "insertions"], dtype="Int32")

    return F.when(reference.isNotNull() & prediction.isNotNull(), F.pandas_udf(of, COUNTS)(reference, prediction))

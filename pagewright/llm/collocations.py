"""Phrase collocations by merged count-min sketches and an exact second pass.

Texts are lower-cased in A-Z, split at PIECE marks into pieces and those at spaces and tabs
into words; a phrase is a run of 1 to LONGEST words of one piece. Everything is by language.

1. Sketch. A step of a task hashes every phrase occurrence of its texts and counts them in
   rows of cells (see Shape). A step touches few of the cells, so it writes them as runs of
   (gap, count), cut into slices of a row. Slices are merged in two rounds, first SPREAD
   groups of each and then the slice as a whole, in counters that stop at 255. A cell never
   counts less than a phrase in it occurs. What is kept is a bit for each cell, whether it
   reached the least count. A row has a cell for every 8 to 16 bytes of text, LEAST_CELLS
   at least and MOST_CELLS at most: what is broadcast is 16 to 128 MB.
2. Exact counts. A second pass over all texts keeps the phrases whose cells are all set, and
   whose parts are kept too (a part of a frequent phrase is frequent), and counts them as
   words, not as hashes: by task, in lists dealt to buckets by a hash of the phrase, then by
   bucket. Nothing frequent is lost. Beyond about 50 GB of text the cells of a sketch of
   MOST_CELLS fill and it lets more and more through; the counts stay exact, and the second
   pass is then an ordinary aggregation.
3. Score. A cut of a phrase is scored against the counts of both its parts, which are
   frequent too, in decimals of 38 digits. The least score of all cuts counts.
4. Subsume. A candidate is dropped if it lies in a longer one that occurs as often. Then a
   phrase of one word more, between the two, occurs as often as well, so only those are
   looked at.

Null languages are `und`. Null and empty texts have no words. Rows without an id and rows
repeated count as they stand; ids are not read, nor are other columns. Very long texts are
read in blocks that overlap by LONGEST - 1 words. Empty tables give no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.shared import SPREAD as ODD
from pagewright.llm.shared import mixed, pieces, written

LONGEST, LEAST = 5, 100
#: Cells of a row of the sketch (powers of two).
LEAST_CELLS, MOST_CELLS = 1 << 26, 1 << 29
#: Groups of a slice of the sketch in the first round of merging.
SPREAD = 16
#: Buckets of phrases at least.
BUCKETS = 128
#: Phrases whose counts a task holds before it passes them on.
HELD = 500_000
#: Text bytes of a step, and of a block of one text.
STEP = 6 << 20

_U = np.uint64
#: All that ends a piece becomes a full stop, which is in no word; tabs become spaces.
_MARKS = bytes(46 if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))

_BETWEEN = re.compile(rb"[ .]")


def _tokens(raw: bytes) -> list[bytes]:
    return [t for t in raw.replace(b".", b" . ").split(b" ") if t]


def _cut(raw: bytes, at: int) -> int:
    found = _BETWEEN.search(raw, at)
    return found.start() if found else len(raw)


def blocks(text: str | None, most: int = STEP) -> Iterator[tuple[list[bytes], int]]:
    """Tokens of a text (words, and b"." at ends of pieces) block by block, and how many of them may begin a phrase."""
    raw, at = (text or "").encode().translate(_MARKS), 0
    while at < len(raw):
        end = at + most
        if end >= len(raw):
            tokens = _tokens(raw[at:])
            yield tokens, len(tokens)
            return
        end = beyond = _cut(raw, end)
        tokens, more = _tokens(raw[at:end]), []
        while beyond < len(raw) and len(more) < LONGEST - 1:
            start, beyond = beyond, _cut(raw, beyond + 1)
            more += _tokens(raw[start:beyond])
        yield tokens + more[: LONGEST - 1], len(tokens)
        at = end


class Words(dict):
    """Numbers of words, from 0 for the end of a piece, and their hashes."""

    def __init__(self):
        super().__init__({b".": 0})
        self.hashes = [0]

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = n = len(self.hashes)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return n


def steps(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[str, np.ndarray, np.ndarray, list[bytes], np.ndarray]]:
    """By step and language: word numbers of tokens, how many words follow each in its piece (0: may not begin a phrase), the words by number, their hashes.

    Texts are separated by an end of a piece.
    """
    import pyarrow.compute  # noqa: F401

    for batch in batches:
        for part in pieces(batch, "text", most):
            by: dict[str, list] = {}
            for lang, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                words, ids, may = Words(), [], []
                for text in texts:
                    for tokens, n in blocks(text.as_py(), most):
                        made = np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens))
                        ids += [made, np.zeros(1, np.int64)]
                        may.append(np.arange(len(made) + 1) < n)
                if not ids:
                    continue
                token = np.concatenate(ids)
                ends = np.flatnonzero(token == 0)
                room = ends[np.searchsorted(ends, np.arange(len(token)))] - np.arange(len(token))
                room[~np.concatenate(may)] = 0
                yield lang, token, room, list(words), np.array(words.hashes, _U)


def phrase_hashes(lang: str, token: np.ndarray, room: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For 1 to LONGEST words: their number, the places where such phrases begin, and the phrases' hashes."""
    import xxhash

    h = hashes[token]
    seed = _U(xxhash.xxh3_64_intdigest(lang.encode()))
    at = np.flatnonzero(room > 0)
    made = mixed(h[at] ^ seed)
    yield 1, at, made
    for n in range(2, LONGEST + 1):
        kept = room[at] >= n
        at, made = at[kept], made[kept]
        made = mixed(made * ODD + h[at + n - 1])
        yield n, at, made


@dataclass(frozen=True)
class Shape:
    """Of a sketch: cells of a row and of a slice of it (powers of two), and rows (one or two)."""

    cells: int
    slice: int = 1 << 20
    rows: int = 2

    def of(self, made: np.ndarray, row: int) -> np.ndarray:
        """The cells of hashes in a row."""
        shift = _U(64 - self.cells.bit_length() + 1)
        return ((made if row == 0 else made * ODD * ODD) >> shift).astype(np.uint32)


def shape_for(text_bytes: int) -> Shape:
    """A cell of each row for every 8 to 16 bytes of text, so that a cell counts about ten occurrences; within LEAST_CELLS and MOST_CELLS."""
    return Shape(min(MOST_CELLS, max(LEAST_CELLS, 1 << (text_bytes // 16).bit_length())))


def packed(cell: np.ndarray, count: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted cells of a slice as gaps of a byte (255 and no count: go on) and counts of a byte."""
    gap = np.diff(cell.astype(np.int64), prepend=-1) - 1
    skips = gap // 255
    place = np.cumsum(skips + 1) - 1
    gaps, counts = np.full(int(place[-1]) + 1, 255, np.uint8), np.zeros(int(place[-1]) + 1, np.uint8)
    gaps[place] = gap % 255
    counts[place] = np.minimum(count, 255)
    return gaps.tobytes(), counts.tobytes()


def unpacked(gaps: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    gap, count = np.frombuffer(gaps, np.uint8).astype(np.int64), np.frombuffer(counts, np.uint8)
    # a skip moves 255 cells on, a count its gap and the cell itself
    at = np.cumsum(np.where(count > 0, gap + 1, gap)) - 1
    return at[count > 0], count[count > 0]


_SLICE = "slice int, turn int, gaps binary, counts binary"


def _sketches(texts: DataFrame, shape: Shape, step: int) -> DataFrame:
    """Slices (slice, turn, gaps, counts) of the sketch of each step; turn deals them to groups."""

    def run(batches):
        turn = 0
        for lang, token, room, _, hashes in steps(batches, step):
            made = np.concatenate([m for _, _, m in phrase_hashes(lang, token, room, hashes)])
            turn = int(made[0] % _U(1 << 30)) if len(made) else turn
            rows = []
            for row in range(shape.rows):
                cell = np.sort(shape.of(made, row))
                first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.empty(0, np.int64)
                count, cell = np.diff(np.append(first, len(cell))), cell[first]
                cuts = np.searchsorted(cell, np.arange(0, shape.cells + 1, shape.slice))
                for i, (s, e) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                    if e > s:
                        rows.append((row * (shape.cells // shape.slice) + i, turn, *packed(cell[s:e] - np.uint32(i * shape.slice), count[s:e])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["slice", "turn", "gaps", "counts"])

    return texts.mapInArrow(run, _SLICE)


def _merged(slices: DataFrame, shape: Shape, least: int | None) -> DataFrame:
    """The sum of slices that share (slice, turn), as slices; or, for a least count, (slice, bits): the cells that reach it."""

    def run(batches):
        total, now = np.zeros(shape.slice, np.uint8), None

        def result():
            slice_, turn = now
            if least is not None:
                bits = np.packbits(total >= least, bitorder="little").tobytes()
                return pa.RecordBatch.from_arrays([pa.array([slice_], pa.int32()), pa.array([bits], pa.binary())], names=["slice", "bits"])
            cell = np.flatnonzero(total)
            gaps, counts = packed(cell, total[cell])
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in ((slice_, pa.int32()), (turn, pa.int32()), (gaps, pa.binary()), (counts, pa.binary()))], names=["slice", "turn", "gaps", "counts"])

        for batch in batches:
            for slice_, turn, gaps, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (slice_, turn):
                    if now is not None:
                        yield result()
                    total[:] = 0
                    now = (slice_, turn)
                at, count = unpacked(gaps, counts)
                total[at] = np.minimum(total[at].astype(np.uint16) + count, 255)
        if now is not None:
            yield result()

    dealt = slices.repartition("slice", "turn").sortWithinPartitions("slice", "turn")
    return dealt.mapInArrow(run, _SLICE if least is None else "slice int, bits binary")


def sketch_bits(texts: DataFrame, least: int, shape: Shape, step: int = STEP) -> bytes:
    """A bit for each cell of the merged sketch of texts (lang, text): whether it counts `least` or more (at most 255)."""
    slices = _sketches(texts, shape, step).withColumn("turn", F.pmod("turn", F.lit(SPREAD)))
    first = written(_merged(slices, shape, None), "sketch").withColumn("turn", F.lit(0))
    size = shape.slice // 8
    out = bytearray(shape.rows * shape.cells // 8)
    for r in _merged(first, shape, min(least, 255)).collect():  # a bit for each cell: 128 MB at most
        out[r["slice"] * size : (r["slice"] + 1) * size] = r.bits
    return bytes(out)


def _counted(texts: DataFrame, shared, shape: Shape, step: int, buckets: int) -> DataFrame:
    """Lists (bucket, lang, phrase, words, f) of the phrases that the sketch lets through, and (lang, null, 0, all words), by task and bucket."""

    def run(batches):
        bits = np.frombuffer(shared.value, np.uint8)

        def passes(made: np.ndarray) -> np.ndarray:
            out = np.ones(len(made), bool)
            for row in range(shape.rows):
                cell = shape.of(made, row).astype(np.int64) + row * shape.cells
                out &= (bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 > 0
            return out

        seen: Counter = Counter()

        def counted() -> pa.RecordBatch:
            by: list[list] = [[] for _ in range(buckets)]
            for (lang, phrase, n), f in seen.items():
                by[zlib.crc32(phrase or b"") % buckets].append((lang, phrase, n, f))
            rows = [(b, *(list(c) for c in zip(*rows, strict=True))) for b, rows in enumerate(by) if rows]
            kinds = (pa.int32(), *(pa.list_(k) for k in (pa.string(), pa.string(), pa.int32(), pa.int64())))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=["bucket", "lang", "phrase", "words", "f"])

        for lang, token, room, words, hashes in steps(batches, step):
            seen[lang, None, 0] += int((room > 0).sum())
            rank = np.full(len(token) + 1, -1, np.int64)  # of the phrase that begins at a place, -1: not let through
            for n, at, made in phrase_hashes(lang, token, room, hashes):
                # of a phrase's two parts a word shorter, the second may begin where a block's own places end
                inner = (rank[at] >= 0) & ((rank[at + 1] >= 0) | (room[at + 1] == 0)) if n > 1 else np.ones(len(at), bool)
                at, made = at[inner], made[inner]
                at = at[passes(made)]
                key = rank[at] * len(words) + token[at + n - 1] if n > 1 else token[at]
                _, first, rank_, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                rank = np.full(len(token) + 1, -1, np.int64)
                rank[at] = rank_
                for s, t in zip(at[first].tolist(), times.tolist(), strict=True):
                    seen[lang, b" ".join(map(words.__getitem__, token[s : s + n].tolist())), n] += t
            if len(seen) >= HELD:
                yield counted()
                seen.clear()
        if seen:
            yield counted()

    return texts.mapInArrow(run, "bucket int, lang array<string>, phrase array<string>, words array<int>, f array<long>")


def _summed(lists: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, words, f): the sums of the lists of a bucket, of the phrases that reach the least count, and of all words."""

    def run(batches):
        total: Counter = Counter()
        now = None

        def result() -> pa.RecordBatch:
            kept = [(*k, f) for k, f in total.items() if f >= least or k[1] is None]
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int64())
            columns = [pa.array(c, k) for c, k in zip(zip(*kept, strict=True) if kept else ((),) * 4, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "words", "f"])

        for batch in batches:
            for i in range(len(batch)):
                row = [c[i].as_py() for c in batch.columns]
                if row[0] != now:
                    if total:
                        yield result()
                    total.clear()
                    now = row[0]
                for lang, phrase, n, f in zip(*row[1:], strict=True):
                    total[lang, phrase, n] += f
        if total:
            yield result()

    return lists.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "lang string, phrase string, words int, f long")


def phrase_counts(docs: DataFrame, least: int = LEAST, lang: str = "lang", text: str = "text", shape: Shape | None = None, step: int = STEP) -> DataFrame:
    """(lang, phrase, words, f): exact counts of all phrases that occur `least` times or more in their language; phrase null: all its words."""
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    shape = shape or shape_for(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    shared = docs.sparkSession.sparkContext.broadcast(sketch_bits(texts, least, shape, step))
    buckets = BUCKETS + 4 * texts.rdd.getNumPartitions()  # so that what a bucket sums does not grow with the corpus
    return written(_summed(_counted(texts, shared, shape, step, buckets), least), "phrases")


def scored(counts: DataFrame) -> DataFrame:
    """Candidates (lang, phrase, words, a, l, r, n, score) of phrase_counts, with the cut of least score, ties to the shortest first part."""
    total = counts.where("phrase is null").select(F.col("lang").alias("tl"), F.col("f").alias("n"))
    parts = counts.where("phrase is not null").select(F.col("lang").alias("pl"), F.col("phrase").alias("part"), F.col("f").alias("pf"))
    many = counts.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    cuts = many.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    both = cuts.join(parts.withColumnRenamed("pf", "l"), (F.col("lang") == F.col("pl")) & (F.col("first") == F.col("part"))).drop("pl", "part")
    both = both.join(parts.withColumnRenamed("pf", "r"), (F.col("lang") == F.col("pl")) & (F.col("rest") == F.col("part"))).drop("pl", "part")
    both = both.join(total, F.col("lang") == F.col("tl")).drop("tl")
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"cast(1000 as decimal(4, 0)) * {wide('a')} * {wide('n')} div ({wide('l')} * {wide('r')})")
    best = both.withColumn("score", score).groupBy("lang", "phrase", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "words", "a", "b.l", "b.r", "n", "b.score")


def maximal(candidates: DataFrame) -> DataFrame:
    """Candidates that lie in no longer one which occurs as often."""
    part = F.explode(F.array(F.expr("substring(phrase, 1, length(phrase) - length(substring_index(phrase, ' ', -1)) - 1)"), F.expr("substring(phrase, length(substring_index(phrase, ' ', 1)) + 2)")))
    inner = candidates.where("words > 2").select(F.col("lang").alias("il"), part.alias("part"), F.col("a").alias("ia"))
    inner = inner.groupBy("il", "part").agg(F.max("ia").alias("ia"))
    return candidates.join(inner, (F.col("lang") == F.col("il")) & (F.col("phrase") == F.col("part")) & (F.col("ia") >= F.col("a")), "left_anti")


def collocations(docs: DataFrame, least: int = LEAST, most: int = 2000, lang: str = "lang", text: str = "text", shape: Shape | None = None, step: int = STEP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `most` phrases of 2 to LONGEST words by score, count, and bytes."""
    left = maximal(written(scored(phrase_counts(docs, least, lang, text, shape, step)), "scored"))
    order = lambda *by: Window.partitionBy("lang", *by).orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    # a language's best of each of 64 groups first, so that no task sorts a language as a whole
    some = left.withColumn("__group", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("__r", F.row_number().over(order("__group"))).where(F.col("__r") <= most)
    ranked = some.drop("__r", "__group").withColumn("rank", F.row_number().over(order()).cast("long")).where(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

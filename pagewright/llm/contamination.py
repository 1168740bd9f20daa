"""Benchmark decontamination by a generalised suffix automaton of the test items.

Items and documents are words (see words). An item's windows are its runs of WINDOW
consecutive words; an item of fewer words, but not none, is one window as a whole. The
automaton of all items knows every run of words in any of them. A document's words stream
through it; at each word it holds the longest run that ends there and occurs in an item.
Where that run has WINDOW words or more, all of it lies in windows, and the state's
ancestor for length WINDOW names the items; items that are short windows are found on the
suffix links of the state, which are cut to those that end such an item. Words that no item
has end every run, so stretches of known words below the least window are passed over.

Items are cut into pieces that overlap by a window less one word, and dealt to shards of at
most SHARD words and items, so that what is broadcast has a bound; each shard is one pass
over the documents, where they lie: nothing of a document is ever shuffled. One pass after
another adds to the spans and items found. More words than SHARD mean more passes.

Null and empty texts have no words and no hits; so have items without words. Items that
repeat an id count as one item, items without an id hit words but are not listed. Equal
items are each listed. Documents are judged row by row, so repeated rows, null ids and ties
do not matter. Very long texts stream in blocks. Columns of documents that bear the name of
a new one are replaced, others are kept. Empty tables give no rows, or no hits.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.shared import pieces, written
from pagewright.llm.words import flattened, word_blocks, word_list

#: Words of a window.
WINDOW = 10
#: Words and items that one pass holds at most; words of an item that stay together.
SHARD, PIECE = 250_000, 4096


class Automaton:
    """Generalised suffix automaton of word sequences, each with the names of its items."""

    def __init__(self, sequences: dict[tuple[str, ...], list[str]], window: int = WINDOW):
        self.window = window
        self.number: dict[bytes, int] = {}  # of words, from 1
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        numbered = []
        for words in sequences:
            ids = [self.number.setdefault(w.encode(), len(self.number) + 1) for w in words]
            numbered.append(ids)
            state = 0
            for w in ids:
                state = self._extended(state, w)
        self.least = min([window, *map(len, numbered)])
        self.at_window = [0] * len(self.step)
        self.owners: dict[int, set[str]] = {}
        self.shorts: dict[int, list[tuple[int, set[str]]]] = {}
        order = sorted(range(1, len(self.step)), key=self.length.__getitem__)
        for v in order:
            if self.length[v] >= window:
                up = self.link[v]
                self.at_window[v] = v if self.length[up] < window else self.at_window[up]
        for ids, names in zip(numbered, sequences.values(), strict=True):
            state = 0
            for n, w in enumerate(ids, 1):
                state = self.step[state][w]
                if n >= window:
                    self.owners.setdefault(self.at_window[state], set()).update(names)
            if 0 < len(ids) < window:
                self.shorts.setdefault(state, []).append((len(ids), set(names)))
        self.near = [0] * len(self.step)  # the nearest state on the suffix links, itself included, that ends a short item
        for v in order:
            self.near[v] = v if v in self.shorts else self.near[self.link[v]]

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.step) - 1

    def _split(self, p: int, w: int) -> int:
        """The state of p's longest run and w: the one there is, or a clone of it that is no longer than that."""
        q = self.step[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = clone
            p = self.link[p]
        return clone

    def _extended(self, last: int, w: int) -> int:
        if w in self.step[last]:
            return self._split(last, w)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.step[p]:
            self.step[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w)
        return new


class Reader:
    """One text's way through an automaton: its words come block by block."""

    def __init__(self, automaton: Automaton):
        self.a, self.state, self.run, self.n = automaton, 0, 0, 0
        self.spans: list[tuple[int, int]] = []
        self.states: set[int] = set()
        self.items: set[str] = set()

    def read(self, words: list[bytes]) -> None:
        a, n = self.a, len(words)
        ids = np.fromiter(map(a.number.get, words, repeat(0)), np.int64, n)
        known = np.concatenate([[False], ids > 0, [False]])
        for s, e in np.flatnonzero(known[1:] != known[:-1]).reshape(-1, 2).tolist():
            if s:
                self.state = self.run = 0
            if e - s >= a.least or not s or e == n:
                self._known(ids[s:e].tolist(), self.n + s)
        if n and not ids[-1]:
            self.state = self.run = 0
        self.n += n

    def _known(self, ids: list[int], begin: int) -> None:
        a, v, run = self.a, self.state, self.run
        step, link, length, near = a.step, a.link, a.length, a.near
        for at, w in enumerate(ids, begin + 1):
            while v and w not in step[v]:
                v = link[v]
                run = length[v]
            v = step[v][w]  # the root knows every word
            run += 1
            if run >= a.window:
                self.states.add(a.at_window[v])
                self._hit(at - run, at)
            short = near[v]
            while short:
                for n, names in a.shorts[short]:
                    if n <= run:
                        self.items |= names
                        self._hit(at - n, at)
                short = near[link[short]]
        self.state, self.run = v, run

    def _hit(self, start: int, end: int) -> None:
        """Ends never fall, so only the last spans can be joined."""
        while self.spans and self.spans[-1][1] >= start:
            start = min(start, self.spans.pop()[0])
        self.spans.append((start, end))

    def found(self) -> tuple[list[tuple[int, int]], set[str]]:
        return self.spans, self.items.union(*(self.a.owners[s] for s in self.states))


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans as maximal runs, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and out[-1][1] >= s:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def shards(items: DataFrame, window: int, item_id: str = "item_id", text: str = "text", most: int = SHARD, piece: int = PIECE) -> tuple[DataFrame, int]:
    """Pieces of items as (shard, item, words), and the number of shards: none weighs more than `most`."""
    whole = items.select(F.col(item_id).cast("string").alias("item"), word_list(F.col(text).cast("string")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)), F.lit(piece))
    each = whole.withColumn("start", F.explode(starts)).select("item", F.slice("words", F.col("start") + 1, F.lit(piece + window - 1)).alias("words"))
    each = written(each.distinct(), "items")
    weight, dealt = F.sum(F.size("words") + 1), lambda n: F.pmod(F.xxhash64("item", "words"), F.lit(n))
    n = max(1, -(-(each.agg(weight).first()[0] or 0) // most))
    while (each.groupBy(dealt(n).alias("shard")).agg(weight.alias("weight")).agg(F.max("weight")).first()[0] or 0) > max(most, piece + window):
        n *= 2
    return each.select(dealt(n).alias("shard"), "item", "words"), n


_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType(), False), T.StructField("end", T.LongType(), False)]))
_FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("spans", _SPAN), T.StructField("items", T.ArrayType(T.StringType()))]
_SPAN_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _passed(rows: DataFrame, shared, text: str) -> DataFrame:
    """rows with what the shard's automaton finds added to n_words, spans, items."""
    read = [f.name for f in rows.schema.fields]
    own = [f for f in rows.schema.fields if f.name not in {f.name for f in _FIELDS}]
    kept = [f.name for f in own]

    def run(batches):
        import pyarrow.compute  # noqa: F401

        automaton = shared.value
        for batch in batches:
            for part in pieces(batch, text):
                col = {n: part.column(i) for i, n in enumerate(read)}
                counts, spans, items = [], [], []
                for body, before, listed in zip(*(col[n].to_pylist() for n in (text, "spans", "items")), strict=True):
                    reader = Reader(automaton)
                    for words in word_blocks(body):
                        reader.read(words)
                    found, names = reader.found()
                    counts.append(reader.n)
                    spans.append([{"start": s, "end": e} for s, e in joined(found + [(x["start"], x["end"]) for x in before])])
                    items.append(sorted(names.union(listed)))
                made = [pa.array(counts, pa.int64()), pa.array(spans, _SPAN_ARROW), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*(col[n] for n in kept), *made], names=[*kept, *(f.name for f in _FIELDS)])

    return rows.mapInArrow(run, T.StructType([*own, *_FIELDS]))


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", most: int = SHARD, piece: int = PIECE) -> DataFrame:
    """docs with n_words, spans and items.

    spans: the maximal runs of words that lie in windows of items (item_id, text), by number
    of words before their start and end; items: the ids, as strings, of the items whose
    windows occur, sorted by code point.
    """
    spark = docs.sparkSession
    dealt, n = shards(items, window, most=most, piece=piece)
    new = {f.name for f in _FIELDS}
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c == text or c.lower() not in new])
    rows = rows.withColumn(text, F.col(text).cast("string")).withColumns({"n_words": F.lit(0).cast("long"), "spans": F.array().cast("array<struct<start:bigint,end:bigint>>"), "items": F.array().cast("array<string>")})
    for shard in range(n):
        sequences: dict[tuple[str, ...], list[str]] = {}
        for item, words in dealt.where(F.col("shard") == shard).select("item", "words").collect():  # at most SHARD words and items
            sequences.setdefault(tuple(words), []).extend([] if item is None else [item])
        rows = _passed(rows, spark.sparkContext.broadcast(Automaton(sequences, window)), text)
        if shard < n - 1:
            rows = written(rows, "passed")
    return rows


def n_hit(spans: str = "spans"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + (x["end"] - x["start"]))


_WORDS = re.compile(rb"[^ ]+")


def cut_spans(text: str, spans: list[dict]) -> str:
    """text without the bytes from each span's first word to its last."""
    raw, out, at, n = text.encode(), [], 0, 0
    places = _WORDS.finditer(flattened(text))
    for span in spans:
        for word in places:
            if n == span["start"]:
                out.append(raw[at : word.start()])
            n += 1
            if n == span["end"]:
                at = word.end()
                break
    return b"".join([*out, raw[at:]]).decode()


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, least_words: int = WINDOW, most_share: float = 0.5, text: str = "text") -> DataFrame:
    """docs without what they share with items: documents of which over most_share of all words are hit are left out, and hit spans of at least least_words words are cut from the others.

    Has n_words, spans and items as scan gives them for the whole text.
    """
    found = scan(docs, items, window, text)
    mild = found.where(F.col("n_words").isNull() | (n_hit() <= F.col("n_words") * most_share))
    cut = F.filter("spans", lambda x: x["end"] - x["start"] >= least_words)
    columns = [f.name for f in mild.schema.fields]

    def run(batches):
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(columns)}
            made = [cut_spans(t, s) if s else t for t, s in zip(col[text].to_pylist(), batch.column(len(columns)).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string()) if n == text else col[n] for n in columns], names=columns)

    return mild.withColumn("__cut", cut).mapInArrow(run, mild.schema)

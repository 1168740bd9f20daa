"""Repeated passages by prefix-free parsing and suffix sorting.

Every string of WIDTH bytes that also starts earlier in the corpus (in a document of
smaller id, or earlier in the same one) is found exactly, and the bytes it covers are
removed. No window of the corpus is shuffled, nor any text sorted as a whole:

1. Parse. A rolling hash of GRAM bytes triggers phrases where it is a multiple of MODULUS.
   The trigger of a window of WIDTH bytes is the first in it (of a window without any, its
   least hash), so it depends on the window's bytes alone. Consecutive windows of one
   trigger start in one phrase, which ends with that trigger; what the last of them reaches
   beyond it is the phrase's context, the text of the next phrases of the parse as far as
   any window needs it. Equal windows start as far before equal triggers.
2. Dictionary. Equal phrases in equal contexts (trigger and string hash, 128 bits; what is
   equal in both is taken as equal) are one entry. All windows of any but the first
   occurrence start earlier: those are done. What is left are first occurrences, and a
   first occurrence whose trigger no other entry has holds only windows that are new.
3. Suffix arrays. For each trigger, the phrases that end with it are sorted by suffix, and
   the contexts, which are the suffixes of the parse cut where no window reaches, are
   sorted too, with the lengths that neighbours have in common. A window is a suffix of a
   phrase and the beginning of a context, so two numbers, the rank of the one and the rank
   of the other at the depth that is left to WIDTH, give the windows' order in the corpus.
   Windows with equal numbers are equal, and all but the first of them, in the parse's
   order (document, start), start earlier. Only those entries' strings travel.

Triggers at the edge of a passage that very many documents share have an entry for each of
them. Those that a sample of about SAMPLE documents shows are known from the start: their
entries are dealt to SPLIT tasks. They, and all others found to have over CROWD entries,
which one task should not sort, are settled exactly by the hashes of their windows, which
Spark combines before the shuffle. Either way gives the same result.

Occurrences that a task has itself seen earlier are settled in that task, so a group of
copies that holds a third of all rows reaches no task as a whole.

Null and empty texts, and those below WIDTH bytes, lose nothing. Rows without an id come
last, in the order of their texts' 64-bit hashes; so do rows that share an id but not the
text. Rows repeated whole count as one place: neither is earlier. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.shared import SPREAD, bounds, marked, mixed, runs, written

WIDTH, GRAM, MODULUS = 100, 32, 64
#: Entries of a trigger that one task sorts at most. Documents of the sample, entries of a trigger in it that show a crowd, and tasks that it is dealt to.
CROWD, SAMPLE, SHOWN, SPLIT = 500, 2000, 8, 64
#: Bytes of text parsed at a time; below 2**22, for places share a number with hashes.
STEP = 1 << 21
_U = np.uint64
_PLACE = _U((1 << 22) - 1)


def _letters() -> np.ndarray:
    return np.random.default_rng(3).integers(0, 2**63, 256, np.uint64) * _U(2) + _U(1)


def grams(data: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Hashes of the GRAM bytes from each byte on (GRAM is a power of two)."""
    h, size, factor = letters[data], 1, int(SPREAD)
    while size < GRAM:
        h = h[:-size] * _U(factor) + h[size:]
        factor, size = factor * factor % 2**64, size * 2
    return mixed(h)


def phrases(data: np.ndarray, stops: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, phrase length and trigger hash of each phrase of the texts that end at stops."""
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    if len(data) < WIDTH:
        return none
    h = grams(data, letters)
    place = np.arange(len(h), dtype=np.uint64)
    least = np.where(h % _U(MODULUS) == 0, place, (h | _U(1 << 63)) & ~_PLACE | place)
    span, size = WIDTH - GRAM + 1, 1
    while size * 2 <= span:
        least, size = np.minimum(least[:-size], least[size:]), size * 2
    least = np.minimum(least[: len(least) - (span - size)], least[span - size :])  # over span grams from each byte on
    open_ = np.zeros(len(data) + 1, np.int32)  # windows lie in one text
    starts = np.concatenate([[0], stops[:-1]])
    long = stops - starts >= WIDTH
    np.add.at(open_, starts[long], 1)
    np.add.at(open_, stops[long] - WIDTH + 1, -1)
    at = np.flatnonzero(np.cumsum(open_[:-1])[: len(least)])
    if not len(at):
        return none
    trigger = (least[at] & _PLACE).astype(np.int64)
    new = np.concatenate([[True], (trigger[1:] != trigger[:-1]) | (at[1:] != at[:-1] + 1)])
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at))), trigger[first] + GRAM - at[first], h[trigger[first]]


#: Columns that name a row of docs: whether it has no id, the id, the hash of its text.
ROW = ("z", "d", "t")
_PARSED = ["gram", "phrase", *ROW, "s", "n", "cut", "known"]


def _phrase_hashes(view, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(view[i:j]) for i, j in zip(at.tolist(), (at + n + WIDTH - 1).tolist(), strict=True)], np.uint64)


def _parse(docs: DataFrame) -> DataFrame:
    """Occurrences (gram, phrase, z, d, t, s, n, cut, known) of phrases: n windows from byte s of document (z, d, t), the phrase cut bytes long.

    Of equal phrases that a step meets, the first comes as it is; the others are known
    not to be the first, and are spread by a gram of no meaning.
    """

    def run(batches):
        letters = _letters()

        def step(rows: list[tuple[tuple, bytes]]):
            rows = sorted(dict(rows).items())
            data = b"".join(x for _, x in rows)
            stops = np.cumsum([len(x) for _, x in rows])
            at, n, cut, gram = phrases(np.frombuffer(data, np.uint8), stops, letters)
            if not len(at):
                return None
            phrase = _phrase_hashes(memoryview(data), at, n)
            doc = np.searchsorted(stops, at, side="right")
            key = np.array([k for k, _ in rows], np.int64).reshape(-1, 3)[doc]
            order = np.lexsort((phrase, gram))
            again = np.zeros(len(at), bool)
            again[order[1:]] = (gram[order[1:]] == gram[order[:-1]]) & (phrase[order[1:]] == phrase[order[:-1]])
            gram = np.where(again, mixed(phrase + at.astype(np.uint64)), gram)
            start = np.concatenate([[0], stops[:-1]])[doc]
            return parsed(gram, phrase, key, at - start, n, cut, again)

        def long(key: tuple, x: bytes):
            """One text of any length, in parts that overlap so that no window is lost; phrases at a cut are two, which share no window."""
            for first in range(0, len(x) - WIDTH + 1, STEP):
                part = x[first : first + STEP + WIDTH - 1]
                at, n, cut, gram = phrases(np.frombuffer(part, np.uint8), np.array([len(part)]), letters)
                if len(at):
                    yield parsed(gram, _phrase_hashes(part, at, n), np.repeat(np.array([key], np.int64), len(at), 0), at + first, n, cut, np.zeros(len(at), bool))

        held, size = [], 0
        for batch in batches:
            for *key, x in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if len(x) < WIDTH:
                    continue
                if held and size + len(x) > STEP:
                    if (made := step(held)) is not None:
                        yield made
                    held, size = [], 0
                if len(x) > STEP:
                    yield from long(tuple(key), x)
                    continue
                held.append((tuple(key), x))
                size += len(x)
        if held and (made := step(held)) is not None:
            yield made

    def parsed(gram, phrase, key, s, n, cut, known):
        columns = [gram.view(np.int64), phrase.view(np.int64), key[:, 0].astype(np.int8), key[:, 1], key[:, 2], s.astype(np.int32), n.astype(np.int16), cut.astype(np.int16), known]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=_PARSED)

    return docs.select(*ROW, "raw").mapInArrow(run, "gram long, phrase long, z byte, d long, t long, s int, n short, cut short, known boolean")


_ENTRY = (pa.int64(), pa.int8(), pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.bool_(), pa.binary())


def _strings(texts: DataFrame) -> DataFrame:
    """Dictionary entries (gram, z, d, t, s, cut, crowd, bytes) of rows (z, d, t, raw, open: entries to sort)."""

    def entries(out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, _ENTRY, strict=True)], names=["gram", *ROW, "s", "cut", "crowd", "bytes"])

    def run(batches):
        for batch in batches:
            out = [[] for _ in _ENTRY]
            for *key, raw, open_ in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                for x in open_ or ():
                    for c, v in zip(out, (x["gram"], *key, x["s"], x["cut"], x["crowd"], raw[x["s"] : x["s"] + x["n"] + WIDTH - 1]), strict=True):
                        c.append(v)
                if len(out[0]) > 20000:
                    yield entries(out)
                    out = [[] for _ in _ENTRY]
            yield entries(out)

    return texts.select(*ROW, "raw", "open").mapInArrow(run, "gram long, z byte, d long, t long, s int, cut short, crowd boolean, bytes binary")


def _fixed(strings: list[bytes], group: np.ndarray, width: int) -> np.ndarray:
    """Strings behind the number of their group, filled up with zeros to one width."""
    out = np.zeros((len(strings), 8 + width), np.uint8)
    out[:, :8] = group.astype(">u8").view(np.uint8).reshape(-1, 8)
    sizes = np.array([len(x) for x in strings])
    inside = np.arange(width) < sizes[:, None]
    out[:, 8:][inside] = np.frombuffer(b"".join(strings), np.uint8)
    return out


def suffix_ranks(dictionary: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of a dictionary as dense ranks, of all suffixes that reach over the trigger, and where each entry's begin.

    Entries end with their trigger and are WIDTH bytes long at most. Equal ranks: equal
    groups and suffixes.
    """
    sizes = np.array([len(x) for x in dictionary])
    n = sizes - GRAM + 1
    begin = np.cumsum(n) - n
    place = np.arange(n.sum()) - np.repeat(begin, n)
    data = np.concatenate([_fixed(dictionary, group, WIDTH)[:, 8:], np.zeros((len(dictionary), WIDTH), np.uint8)], axis=1)
    entry = np.repeat(np.arange(len(dictionary)), n)
    named = np.empty((len(entry), 9 + WIDTH), np.uint8)
    named[:, :8] = group[entry].astype(">u8").view(np.uint8).reshape(-1, 8)
    named[:, 8:-1] = np.lib.stride_tricks.sliding_window_view(data, WIDTH, axis=1)[entry, place]
    named[:, -1] = sizes[entry] - place
    text = named.view(f"V{9 + WIDTH}")[:, 0]
    order = np.argsort(text, kind="stable")
    rank = np.empty(len(text), np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], text[order[1:]] != text[order[:-1]]]))
    return rank, begin


def context_ranks(contexts: list[bytes], group: np.ndarray) -> np.ndarray:
    """For each context and depth, a number that those have in common which agree so far (contexts by depths 0 to WIDTH - GRAM)."""
    fixed = _fixed(contexts, group, WIDTH - GRAM)
    order = np.argsort(fixed.view(f"V{fixed.shape[1]}")[:, 0], kind="stable")
    differ = fixed[order[1:]] != fixed[order[:-1]]
    common = np.where(differ.any(1), differ.argmax(1), fixed.shape[1]) - 8  # negative: another group
    breaks = common[:, None] < np.arange(WIDTH - GRAM + 1)
    out = np.empty((len(contexts), WIDTH - GRAM + 1), np.int64)
    out[order] = np.concatenate([np.zeros((1, WIDTH - GRAM + 1), np.int64), np.cumsum(breaks, axis=0)])
    return out


def later_windows(entries: list[bytes], cuts: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and place of each window of the entries that an entry before it, or it itself, has further left."""
    numbers: dict[tuple[int, bytes], int] = {}
    of = np.array([numbers.setdefault((g, x[:c]), len(numbers)) for x, c, g in zip(entries, cuts.tolist(), group.tolist(), strict=True)])
    rank, begin = suffix_ranks([x for _, x in numbers], np.array([g for g, _ in numbers]))
    deep = context_ranks([x[c:] for x, c in zip(entries, cuts.tolist(), strict=True)], group)
    n = np.array([len(x) for x in entries]) - WIDTH + 1
    entry = np.repeat(np.arange(len(entries)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    key = rank[begin[of[entry]] + place] << 32 | deep[entry, WIDTH - cuts[entry] + place]
    order = np.argsort(key, kind="stable")  # corpus order; equal windows stay in the order of the parse
    later = np.zeros(len(key), bool)
    later[order[1:]] = key[order[1:]] == key[order[:-1]]
    hit = np.flatnonzero(later)
    return entry[hit], place[hit]


def _spans(keys: np.ndarray, entry: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """Windows by entry and place as runs: z, d, t, s of the first, and their number. keys: z, d, t, s of the entries."""
    starts = np.ones(len(entry), bool)  # of no windows, none
    starts[1:] = (place[1:] != place[:-1] + 1) | (entry[1:] != entry[:-1])
    first = np.flatnonzero(starts)
    k = keys[entry[first]]
    return [k[:, 0].astype(np.int8), np.ascontiguousarray(k[:, 1]), np.ascontiguousarray(k[:, 2]), (k[:, 3] + place[first]).astype(np.int32), np.diff(np.append(first, len(entry))).astype(np.int32)]


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(i).to_numpy().astype(np.int64) for i in (1, 2, 3, 4)], 1)


def _later(entries: DataFrame) -> DataFrame:
    """Runs (z, d, t, s, n) of windows that start earlier too, from entries that share a trigger."""

    def run(batches):
        for batch in runs(batches, "gram"):
            gram, keys = batch.column(0).to_numpy(), _keys(batch)
            same = np.concatenate([[False], (gram[1:] == gram[:-1]) & (keys[1:] == keys[:-1]).all(1)])  # a row that was there twice
            rows = np.flatnonzero(~same)
            cuts, strings = batch.column(5).to_numpy().astype(np.int64), batch.column(7)
            group = np.cumsum(np.concatenate([[True], gram[1:] != gram[:-1]]))[rows]
            starts = bounds(group // 500)[0]
            for a, b in zip(starts, [*starts[1:], len(rows)], strict=True):
                mine = rows[a:b]
                entry, place = later_windows([strings[i].as_py() for i in mine.tolist()], cuts[mine], group[a:b])
                if len(entry):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in _spans(keys[mine], entry, place)], names=[*ROW, "s", "n"])

    dealt = entries.repartition("gram").sortWithinPartitions("gram", *ROW, "s")
    return dealt.mapInArrow(run, "z byte, d long, t long, s int, n int")


def _later_in_crowds(entries: DataFrame) -> DataFrame:
    """As _later, by the hashes of windows: for triggers with very many entries.

    Of equal windows that a batch holds only the first goes to the shuffle.
    """

    def run(batches):
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for at in range(0, len(batch), 5000):
                part = batch.slice(at, 5000)
                keys, gram, strings = _keys(part), part.column(0).to_numpy(), part.column(7).to_pylist()
                if not strings:
                    continue
                n = np.array([len(x) - WIDTH + 1 for x in strings])
                entry = np.repeat(np.arange(len(strings)), n)
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                window = np.array([digest(x[i : i + WIDTH]) for x in strings for i in range(len(x) - WIDTH + 1)], np.uint64).view(np.int64)
                own = keys[entry]
                own[:, 3] += place
                order = np.lexsort((own[:, 3], own[:, 2], own[:, 1], own[:, 0], window, gram[entry]))
                a, b = order[1:], order[:-1]
                equal = (window[a] == window[b]) & (gram[entry[a]] == gram[entry[b]])
                again = np.zeros(len(window), bool)
                again[a] = equal
                # a row that was there twice is one place: not earlier than itself
                again[a[equal & (own[a] == own[b]).all(1)]] = False
                one, hit = np.flatnonzero(~again), np.flatnonzero(again)
                z, d, t, s, k = _spans(keys, entry[hit], place[hit])
                known = [np.full(len(z), x, np.int64) for x in (0, 0)]
                columns = [*(np.concatenate(c) for c in zip([gram[entry[one]], window[one], own[one, 0].astype(np.int8), own[one, 1], own[one, 2], own[one, 3].astype(np.int32), np.ones(len(one), np.int32)], [*known, z, d, t, s, k], strict=True)), np.arange(len(one) + len(z)) >= len(one)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["gram", "window", *ROW, "s", "n", "known"])

    windows = written(entries.mapInArrow(run, "gram long, window long, z byte, d long, t long, s int, n int, known boolean"), "windows")
    new = windows.where("not known")
    first = new.groupBy("gram", "window").agg(F.min(F.struct(*ROW, "s")).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    both = new.join(written(first, "first"), ["gram", "window"]).where(F.struct(*ROW, "s") > F.col("first"))
    return both.select(*ROW, "s", "n").unionByName(windows.where("known").select(*ROW, "s", "n"))


def _removed(texts: DataFrame, doc_id: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids, spans, kept = [], [], []
            for d, raw, cover in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw = raw or b""
                ids.append(d)
                if not cover:
                    spans.append([])
                    kept.append(raw)
                    continue
                edge = np.zeros(len(raw) + 1, np.int32)
                s, n = np.array([x["s"] for x in cover]), np.array([x["n"] for x in cover])
                np.add.at(edge, s, 1)
                np.add.at(edge, s + n + WIDTH - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                spans.append([{"start": a, "end": b} for a, b in turn.reshape(-1, 2).tolist()])
                kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=[doc_id, "spans", "kept"])

    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    return texts.mapInArrow(run, T.StructType([T.StructField(doc_id, T.LongType()), T.StructField("spans", span), T.StructField("kept", T.BinaryType())]))


def _crowds(rows: DataFrame) -> DataFrame:
    """(gram): triggers that show at least SHOWN entries in a sample of documents; at most SAMPLE of them, so they can be broadcast.

    Only where work is done depends on it, not what comes out.
    """
    share = max(1, rows.count() // SAMPLE)
    seen = _parse(rows.where(F.pmod(F.xxhash64("d", "t", F.lit(5)), F.lit(share)) == 0)).where("not known").select("gram", "phrase").distinct()
    shown = seen.groupBy("gram").count().where(F.col("count") >= SHOWN).orderBy(F.col("count").desc(), "gram").limit(SAMPLE)
    return written(shown.select("gram", F.lit(True).alias("heavy")), "crowds")


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, spans (start, end in bytes) removed as maximal runs, and kept, the bytes that remain, for each row."""
    id_ = F.col(doc_id).cast("long")
    raw = F.col(text).cast("string").cast("binary")
    # where every row has an id of its own, the id alone tells rows apart
    shared = not docs.groupBy(id_.alias("i")).count().where("count > 1").isEmpty()
    rows = docs.select(id_.alias("id"), id_.isNull().cast("byte").alias("z"), F.coalesce(id_, F.lit(0)).alias("d"), (F.xxhash64(raw) if shared else F.lit(0).cast("long")).alias("t"), raw.alias("raw"))
    parsed = rows.where(F.octet_length("raw") >= WIDTH)
    heavy = F.coalesce("heavy", F.lit(False)) & ~F.col("known")
    seen = _parse(parsed).join(F.broadcast(_crowds(parsed)), "gram", "left").withColumn("heavy", heavy)
    seen = seen.withColumn("salt", F.when(F.col("heavy"), F.pmod("phrase", F.lit(SPLIT))).otherwise(0).cast("int")).repartition("gram", "salt")
    entry = Window.partitionBy("gram", "salt", "phrase").orderBy(*ROW, "s")
    ranked = seen.withColumn("first", (F.rank().over(entry) == 1) & ~F.col("known"))
    ranked = ranked.withColumn("entries", F.sum(F.col("first").cast("int")).over(Window.partitionBy("gram", "salt")))
    crowd = F.col("heavy") | (F.col("entries") > CROWD)
    needed = ranked.where(~F.col("first") | F.col("heavy") | (F.col("entries") > 1))
    flagged = written(needed.select(*ROW, "s", "n", "cut", "first", F.when(F.col("first"), F.col("gram")).alias("gram"), crowd.alias("crowd")), "phrases")
    open_ = flagged.where("first").groupBy(*ROW).agg(F.collect_list(F.struct("gram", "s", "n", "cut", "crowd")).alias("open"))
    some = marked(rows, "d", flagged.where("first").select(F.col("d").alias("id"))).where("may")
    entries = written(_strings(some.repartition(*ROW).join(open_, [*ROW])), "entries")
    later = _later(entries.where("not crowd"))
    if not entries.where("crowd").isEmpty():
        later = later.unionByName(_later_in_crowds(entries.where("crowd")))
    cover = flagged.where("not first").select(*ROW, "s", F.col("n").cast("int").alias("n")).unionByName(later)
    cover = written(cover.groupBy(*ROW).agg(F.collect_list(F.struct("s", "n")).alias("cover")), "cover")
    # only texts that may have something removed are shuffled
    both = marked(rows, "d", cover.select(F.col("d").alias("id")))
    whole = both.where("not may").select(F.col("id").alias(doc_id), F.array().cast("array<struct<start:int,end:int>>").alias("spans"), F.coalesce("raw", F.lit(b"")).alias("kept"))
    return _removed(both.where("may").repartition(*ROW).join(cover, [*ROW], "left").select("id", "raw", "cover"), doc_id).unionByName(whole)

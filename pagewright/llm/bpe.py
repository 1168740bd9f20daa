"""Byte-level byte-pair encoding and decoding.

Each match of the splitting pattern is encoded separately. A segment tree over the
byte positions of a match stores the leftmost minimum pair rank; a merge changes the
pair that starts at the merged part and the pair before it, and closes the part on the
right, each a point update in logarithmic time. So a match of a hundred thousand bytes
without white space costs n log n, not n squared.

Nulls encode as empty texts; empty texts have no tokens; repeated rows encode alike.
Special tokens are never made: their strings are ordinary text.
"""

from __future__ import annotations

import base64
import re
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.shared import append_columns

#: Entries of the per-task table of encoded matches, and bytes of the longest match in it.
CACHE_ENTRIES, CACHE_BYTES = 200_000, 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PairTree:
    """Ranks of the pairs that start at each byte; the root has the leftmost least one."""

    def __init__(self, keys: list[int], none: int):
        self.none = none
        self.leaves = 1 << max(0, len(keys) - 1).bit_length()
        self.node = [none] * self.leaves + keys + [none] * (self.leaves - len(keys))
        for i in range(self.leaves - 1, 0, -1):
            left, right = self.node[2 * i], self.node[2 * i + 1]
            self.node[i] = left if left <= right else right

    def least(self) -> int:
        return self.node[1]

    def put(self, at: int, key: int) -> None:
        node, i = self.node, at + self.leaves
        node[i] = key
        i >>= 1
        while i:
            left, right = node[2 * i], node[2 * i + 1]
            key = left if left <= right else right
            if node[i] == key:
                break
            node[i] = key
            i >>= 1


def encode_piece(piece: bytes, ranks: dict[bytes, int], longest: int) -> tuple[int, ...]:
    """Ids of one match."""
    if (whole := ranks.get(piece)) is not None:
        return (whole,)
    n = len(piece)
    if n < 2:
        return tuple(ranks[piece[i : i + 1]] for i in range(n))
    shift = n.bit_length()
    mask, none = (1 << shift) - 1, len(ranks) + (1 << 40) << shift
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # starts of the live parts beside each

    def key(at: int) -> int:
        """The rank of the pair of parts that starts at a byte, above that byte's number."""
        if (middle := after[at]) >= n:
            return none
        end = after[middle]
        rank = ranks.get(piece[at:end]) if end - at <= longest else None
        return none if rank is None else rank << shift | at

    tree = PairTree([key(i) for i in range(n - 1)], none)
    while (best := tree.least()) < none:
        at = best & mask
        gone = after[at]
        after[at] = end = after[gone]
        if end < n:
            before[end] = at
        if gone < n - 1:
            tree.put(gone, none)
        tree.put(at, key(at)) if at < n - 1 else None
        if (left := before[at]) >= 0:
            tree.put(left, key(left))
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : after[at]]])
        at = after[at]
    return tuple(ids)


def pair_table(ranks: dict[bytes, int]) -> tuple:
    """Pairs of tokens that make a token: sorted keys (left << 32 | right), and the made token of each."""
    import numpy as np

    made: dict[int, int] = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                made[left << 32 | right] = rank
    keys = np.array(sorted(made), np.int64)
    return keys, np.array([made[k] for k in keys.tolist()], np.int64)


def encode_pieces(pieces: list[bytes], ranks: dict[bytes, int], pairs: tuple) -> list[tuple[int, ...]]:
    """Ids of many matches of 2 to 64 bytes that are no tokens: a row of arrays holds each one's segment tree.

    The same merges as encode_piece, one for every unfinished match at each turn.
    """
    import numpy as np

    keys, made = pairs
    byte_id = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
    out: list = [None] * len(pieces)
    by_leaves: dict[int, list[int]] = {}
    for i, piece in enumerate(pieces):
        by_leaves.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
    for leaves, members in by_leaves.items():
        for start in range(0, len(members), 16384):
            rows = members[start : start + 16384]
            m, depth = len(rows), leaves.bit_length() - 1
            n = np.array([len(pieces[i]) for i in rows])
            raw = np.frombuffer(b"".join(pieces[i].ljust(leaves, b"\0") for i in rows), np.uint8).reshape(m, leaves)
            part, live = byte_id[raw], np.arange(leaves) < n[:, None]
            after = np.tile(np.arange(1, leaves + 2), (m, 1))
            before = np.tile(np.arange(-1, leaves), (m, 1))
            none = np.int64(1) << 60

            def rank(left, right, at, none=none, leaves=leaves):
                """Tree keys of pairs of tokens: the rank of what they make, above the place."""
                pair = left << 32 | right
                i = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
                return np.where(keys[i] == pair, made[i] * leaves + at, none)

            tree = np.full((m, 2 * leaves), none)
            has = live[:, 1:]
            r, c = np.nonzero(has)
            tree[r, leaves + c] = rank(part[r, c], part[r, c + 1], c)
            for level in range(depth - 1, -1, -1):
                below = tree[:, 2 << level : 4 << level]
                tree[:, 1 << level : 2 << level] = np.minimum(below[:, ::2], below[:, 1::2])
            r = np.flatnonzero(tree[:, 1] < none)
            while len(r):
                best = tree[r, 1]
                at, token = best % leaves, best // leaves
                gone = after[r, at]
                end = after[r, gone]
                part[r, at] = token
                live[r, gone] = False
                after[r, at] = end
                before[r, end] = at
                left = before[r, at]
                tree[r, leaves + gone] = none
                inside = end < n[r]
                tree[r, leaves + at] = np.where(inside, rank(token, part[r, np.minimum(end, leaves - 1)], at), none)
                some = left >= 0
                prior = np.maximum(left, 0)
                tree[r, leaves + prior] = np.where(some, rank(part[r, prior], token, prior), tree[r, leaves + prior])
                nodes = [leaves + gone, leaves + at, leaves + prior]
                for _ in range(depth):
                    for k in range(3):
                        nodes[k] = nodes[k] >> 1
                        tree[r, nodes[k]] = np.minimum(tree[r, 2 * nodes[k]], tree[r, 2 * nodes[k] + 1])
                r = r[tree[r, 1] < none]
            flat, stops = part[live].tolist(), np.cumsum(live.sum(1)).tolist()
            for i, a, b in zip(rows, [0, *stops], stops, strict=False):
                out[i] = tuple(flat[a:b])
    return out


#: Letters, numbers and white space below U+0250, as a character class has them.
_LETTERS, _NUMBERS, _SPACE = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", "\\t-\\r \x85\xa0"


def narrow(pattern: str) -> str | None:
    """The pattern for texts without characters from U+0250 on, in the syntax of `re`; None if it has more classes."""
    for old, new in (
        (r"[^\s\p{L}\p{N}]", f"[^{_SPACE}{_LETTERS}{_NUMBERS}]"),
        (r"\p{L}", f"[{_LETTERS}]"), (r"\p{N}", f"[{_NUMBERS}]"), (r"\s", f"[{_SPACE}]"), (r"\S", f"[^{_SPACE}]"),
    ):
        pattern = pattern.replace(old, new)
    return None if re.search(r"\\[^tr]", pattern) else pattern


class Codec(dict):
    """Encodes and decodes; as a mapping, it holds the ids of matches seen before, up to a bound."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, pairs: tuple | None = None):
        import regex

        self.ranks, self.longest = ranks, max(map(len, ranks), default=0)
        self.pairs = pairs if pairs is not None else pair_table(ranks)
        self.any = regex.compile(pattern).findall
        low = narrow(pattern)
        self.low, self.high = low and re.compile(low).findall, re.compile("[^\0-\u024f]").search
        self.token = {v: k for k, v in ranks.items()}
        self.older: dict = {}

    def split(self, text: str) -> list[str]:
        return self.any(text) if not self.low or self.high(text) else self.low(text)

    def __missing__(self, piece: str) -> tuple[int, ...]:
        return encode_piece(piece.encode(), self.ranks, self.longest)

    def learn(self, seen: set[str]) -> None:
        """Encodes at once the matches that are new; those not seen for long are forgotten."""
        if len(self) >= CACHE_ENTRIES:
            self.older = dict(self)
            self.clear()
        new, raw = [], []
        for piece in seen:
            if piece in self:
                continue
            if (ids := self.older.get(piece)) is not None or (rank := self.ranks.get(piece.encode())) is not None:
                self[piece] = ids if ids is not None else (rank,)
            elif 1 < len(code := piece.encode()) <= CACHE_BYTES and len(self.pairs[0]):
                new.append(piece)
                raw.append(code)
        for at in range(0, len(new), 1 << 16):
            self.update(zip(new[at : at + (1 << 16)], encode_pieces(raw[at : at + (1 << 16)], self.ranks, self.pairs), strict=True))

    def encode_all(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.split(t) if t else [] for t in texts]
        self.learn(set(chain.from_iterable(split)))
        return [list(chain.from_iterable(map(self.__getitem__, x))) for x in split]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def _codec(spark: SparkSession, ranks_path: str, pattern: str):
    """A start function for tasks. The vocabulary is read once, here, and broadcast: its size is fixed."""
    ranks = read_ranks(ranks_path)
    shared = spark.sparkContext.broadcast((ranks, pair_table(ranks)))
    return lambda: Codec(shared.value[0], pattern, shared.value[1])


def encoder(spark: SparkSession, ranks_path: str, pattern: str):
    """What makes, in a task, a function from texts to lists of ids."""
    make = _codec(spark, ranks_path, pattern)
    return lambda: make().encode_all


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """df with `ids`, the token ids of each whole text; with `decoded`, also the bytes which those ids decode to.

    Columns of df with these names are replaced. No shuffle; each task holds the
    vocabulary, a bounded table of matches and a few MB of texts.
    """
    make = _codec(df.sparkSession, ranks_path, pattern)

    def start():
        codec = make()

        def step(texts: list) -> list[pa.Array]:
            import numpy as np

            offsets, flat, raw = [0], [], []
            for made in codec.encode_all(texts):
                flat.append(np.array(made, dtype=np.int32))
                offsets.append(offsets[-1] + len(made))
                if decoded:
                    raw.append(codec.decode(made))
            values = pa.array(np.concatenate(flat) if flat else np.empty(0, np.int32))
            out = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)]
            return [*out, pa.array(raw, pa.binary())] if decoded else out

        return step

    fields = [T.StructField(ids, T.ArrayType(T.IntegerType()))]
    return append_columns(df, fields + ([T.StructField(decoded, T.BinaryType())] if decoded else []), start, text)


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with `decoded`, the bytes of each list of ids (null: empty). An id outside the vocabulary is an error."""
    token = df.sparkSession.sparkContext.broadcast({v: k for k, v in read_ranks(ranks_path).items()})
    keep = [f for f in df.schema.fields if f.name.lower() != decoded.lower()]

    def run(batches):
        table = token.value.__getitem__
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            made = pa.array([b"".join(map(table, x.as_py() or ())) for x in lists], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns)), made], names=[*batch.schema.names, decoded])

    return df.select(*[F.col(f"`{f.name}`") for f in keep]).mapInArrow(run, T.StructType([*keep, T.StructField(decoded, T.BinaryType())]))


def ids_digest(ids: Column) -> Column:
    """SHA-256 of the decimal ids joined by one space."""
    return F.sha2(F.array_join(ids.cast("array<string>"), " "), 256)

"""Near-duplicates by chosen-path set similarity join.

A document is the set of its word shingles. Equal sets are one set from the start. Each
set has a sketch of COORDINATES minwise values. A tree starts with all sets in its root;
a node of more than LEAF sets branches on BRANCHES coordinates that its path selects: a
set goes on to the child of its minwise token there, so two sets stay together with the
probability of their similarity for each branch. Nodes of at most LEAF sets are compared
exhaustively, sketch by sketch, and give candidates. All trees read one sketch. A pair
whose sketches agree in k coordinates is split by a level where both branches differ, and
kept twice where both agree; the chance that four levels of all five trees split a pair at
similarity 0.8, over the binomial k, is 5 in a million (fewer levels: less). A leaf passes
pairs with k from SLACK deviations below the threshold: 1 in 100 million is under it.

A large node would keep a group of near copies together level after level. So its first
set is a hub: a set whose sketch agrees with the hub's in a share of NEAR leaves the node
as the hub's candidate, and any of at least AROUND is the hub's candidate too, whether it
leaves or not. Jaccard distance is a metric: what is linked to a set that left is within
0.2 + 0.25 of the hub, so within AROUND's reach. A set that leaves agrees with the hub in
103 coordinates at least, one that AROUND leaves out in 48 at most, so the two agree in 73
at most: the leaf would not pass them either, and no further pair is lost by the leaving.
Nodes that are still large at depth DEPTH hold sets that agree on every coordinate of
their path, and are candidates of their hub as they are.

Candidates come in groups: the sets that a leaf connects, and the candidates of a hub.
Equal groups, which most trees find again, are one. Groups are not joined to larger ones,
for candidates are not links: the full sets of a group are brought together, and its links
are confirmed exactly; only confirmed links make components. A group of up to GROUP sets
and SHINGLES shingles is one part. Larger groups are cut into parts that share
some sets (the hub and pivots); whatever is then outside the group's largest component is
compared with all of the group in further parts, so no link is lost, no task holds more
than about two parts, and no pair is written: a part gives at most one link a set.

What is needed again of the sets or texts of candidates is found by a map of bits of a
bounded size (see shared.marked); what it lets through is then joined exactly. There is one
way for all sizes.

Texts are lower-cased in A-Z only, words are runs of anything but ASCII white space.
Null texts, and texts without words, have an empty set and are linked with nothing.
Texts of fewer words than a shingle are one shingle. Rows with a null id link as others
do; a component is named by its least id, and has no name if it has no id. Rows that repeat
an id share a component if their sets are equal or linked; each row goes by its own set.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.components import components, least_connected
from pagewright.llm.shared import SPREAD, append_columns, bounds, marked, mixed, runs, written

COORDINATES, LEAF, BRANCHES, TREES, DEPTH = 128, 256, 2, 5, 4
#: Sets, and shingles of them, that one part links at a time, at most but for single larger sets; pivots that all parts of a larger group share.
GROUP, SHINGLES, PIVOTS = 1024, 4_000_000, 64
#: Least share of equal coordinates of a candidate, below the threshold by six deviations.
SLACK = 6.0
#: Shares of a hub's coordinates at which a set leaves a large node, and is the hub's candidate.
NEAR, AROUND = 0.80, 0.38
CACHE_ENTRIES = 400_000

_U = np.uint64


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, words: int, cache: dict) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    tokens = (text or "").encode().lower().split()
    n = len(tokens)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, tokens), np.uint64, n)
    width = min(words, n)
    made = h[: n - width + 1]
    for i in range(1, width):
        made = mixed(made * SPREAD + h[i : n - width + 1 + i])
    return np.unique(mixed(made + _U(width)))


def _hashes() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    return rng.integers(0, 2**63, COORDINATES, np.uint64) * _U(2) + _U(1), rng.integers(0, 2**63, COORDINATES, np.uint64)


def sketch(made: np.ndarray, a: np.ndarray, b: np.ndarray) -> bytes:
    """Minwise values of a set that is not empty: the upper half of multiply-shift hashes."""
    least = None
    for at in range(0, len(made), 1024):
        part = (np.multiply.outer(made[at : at + 1024], a) + b).min(axis=0)
        least = part if least is None else np.minimum(least, part)
    return (least >> _U(32)).astype(np.uint32).tobytes()


def brief(whole: bytes | None) -> bytes | None:
    """The lowest byte of each coordinate: enough to count those that agree."""
    return None if whole is None else np.frombuffer(whole, np.uint32).astype(np.uint8).tobytes()


def _described(docs: DataFrame, words: int, full: bool, text: str) -> DataFrame:
    """docs with n_shingles, set_hash (null: empty set), and the sketch, whole and brief, or the full set."""

    def start():
        import xxhash

        cache, (a, b) = _WordHash(), _hashes()

        def step(texts: list) -> list[pa.Array]:
            sets = [shingles(t, words, cache) for t in texts]
            made = [(s.tobytes() if full else sketch(s, a, b)) if len(s) else None for s in sets]
            out = [
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array(made, pa.binary()),
            ]
            return out if full else [*out, pa.array([brief(x) for x in made], pa.binary())]

        return step

    names = ("shingles",) if full else ("sketch", "brief")
    fields = [T.StructField("n_shingles", T.LongType()), *[T.StructField(name, T.BinaryType()) for name in ("set_hash", *names)]]
    return append_columns(docs, fields, start, text, drop=(text,))


def _branch(rows: DataFrame, root: bool) -> DataFrame:
    """(node, id) of the children of rows (node, id, sketch); at the root, of all trees."""

    def run(batches):
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            ids = batch.column(batch.schema.get_field_index("id")).to_numpy()
            values = np.frombuffer(b"".join(batch.column(batch.schema.get_field_index("sketch")).to_pylist()), np.uint32).reshape(n, COORDINATES)
            if root:
                nodes = [np.full(n, t + 1, np.uint64) for t in range(TREES)]
            else:
                nodes = [batch.column(batch.schema.get_field_index("node")).to_numpy().view(np.uint64)]
            for node in nodes:
                first = mixed(node * SPREAD + _U(1)) % _U(COORDINATES)
                step = mixed(node * SPREAD + _U(2)) % _U(COORDINATES // BRANCHES) + _U(1)
                for j in range(BRANCHES):
                    c = ((first + _U(j) * step) % _U(COORDINATES)).astype(np.int64)
                    value = values[np.arange(n), c].astype(np.uint64)
                    child = mixed(mixed(node * SPREAD + c.astype(np.uint64)) ^ (value * SPREAD))
                    yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(ids)], names=["node", "id"])

    return rows.mapInArrow(run, "node long, id long")


def _compare_leaves(rows: DataFrame, per: int) -> DataFrame:
    """Groups (grp, id) of sets that the candidates of a node connect, from rows (node, id, n, brief)."""
    share = per / 100
    least = int(COORDINATES * share - SLACK * np.sqrt(COORDINATES * share * (1 - share)))

    def run(batches):
        import xxhash

        for batch in runs(batches, "node"):
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            ids, n = col["id"].to_numpy(), col["n"].to_numpy()
            values = np.frombuffer(b"".join(col["brief"].to_pylist()), np.uint8).reshape(len(ids), COORDINATES)
            pairs_a, pairs_b = [], []
            for s, e in zip(*bounds(col["node"].to_numpy()), strict=True):
                for i in range(s, e - 1):  # one row against the rest of its node
                    j = np.arange(i + 1, e)
                    j = j[(np.minimum(n[j], n[i]) * 100 >= np.maximum(n[j], n[i]) * per)]
                    if len(j):
                        j = j[(values[j] == values[i]).sum(1) >= least]
                        pairs_a += [i] * len(j)
                        pairs_b += j.tolist()
            if not pairs_a:
                continue
            rows_, label = least_connected(np.array(pairs_a), np.array(pairs_b))
            order = np.lexsort((ids[rows_], label))
            members, groups = ids[rows_[order]], label[order]
            name = np.empty(len(members), np.int64)
            for s, e in zip(*bounds(groups), strict=True):
                name[s:e] = np.array(xxhash.xxh3_64_intdigest(members[s:e].tobytes()), np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(members)], names=["grp", "id"])

    dealt = rows.repartition("node").sortWithinPartitions("node")
    return dealt.mapInArrow(run, "grp long, id long")


def link_sets(ids: np.ndarray, sets: list[np.ndarray], per: int) -> np.ndarray:
    """For each set, the index of one set of its component: exact, over all pairs.

    A pivot's intersections with all sets are counted in one pass. Only sets outside the
    largest component need to be pivots, for of any two unlinked components one is outside.
    """
    n = np.array([len(s) for s in sets])
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    mark = np.zeros(token.max() + 1, bool)
    label = np.arange(len(sets))
    done = np.zeros(len(sets), bool)
    while True:
        values, counts = np.unique(label, return_counts=True)
        if len(values) == 1:
            return label
        open_ = np.flatnonzero(~done & (label != values[counts.argmax()])) if done.any() else np.array([0])
        if not len(open_):
            return label
        i = open_[0]
        done[i] = True
        mine = token[starts[i] : starts[i] + n[i]]
        mark[mine] = True
        both = np.add.reduceat(mark[token], starts)
        mark[mine] = False
        linked = 100 * both >= per * (n + n[i] - both)
        joined = np.unique(label[linked])
        label[np.isin(label, joined)] = joined.min()


def _link_parts(rows: DataFrame, per: int) -> DataFrame:
    """Links (a, b) that connect the components of each part, from rows (part, id, shingles)."""

    def run(batches):
        for batch in runs(batches, "part"):
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            ids = col["id"].to_numpy()
            for s, e in zip(*bounds(col["part"].to_numpy()), strict=True):
                if e - s < 2:
                    continue
                sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in col["shingles"].slice(s, e - s)]
                label = link_sets(ids[s:e], sets, per)
                least = {}
                for i, k in zip(ids[s:e].tolist(), label.tolist(), strict=True):
                    least[k] = min(i, least.get(k, i))
                made = [(i, least[k]) for i, k in zip(ids[s:e].tolist(), label.tolist(), strict=True) if i != least[k]]
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in made], pa.int64()), pa.array([b for _, b in made], pa.int64())], names=["a", "b"])

    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(run, "a long, b long")


def _around_hubs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (id, first) of a set and a hub as (id, first, near, around): how the set stands to the hub."""
    briefs = sets.select("id", "brief")
    rows = pairs.join(briefs, "id").join(briefs.select(F.col("id").alias("first"), F.col("brief").alias("hub")), "first")

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            mine, hub = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(len(batch), COORDINATES) for i in (2, 3))
            share = (mine == hub).mean(1)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(2)), pa.array(share >= NEAR), pa.array(share >= AROUND)], names=["id", "first", "near", "around"])

    return rows.select("id", "first", "brief", "hub").mapInArrow(run, "id long, first long, near boolean, around boolean")


def _among(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose key may be one of ids (id): all that are, and few others."""
    return marked(rows, key, ids).where("may").drop("may")


def _candidates(sets: DataFrame, per: int) -> DataFrame:
    """Groups (grp, id, hub) of sets (id, n, sketch, brief) that may be similar: what the trees find; hub is null in groups of leaves."""
    every, leaves, found = sets, [], []
    around = lambda rows: rows.select(F.xxhash64("first", F.lit(1)).alias("grp"), "id", F.col("first").alias("hub"))
    rows = _branch(sets.select("id", "sketch"), root=True)
    for level in range(1, DEPTH + 1):
        rows = written(rows, "nodes")
        sizes = written(rows.groupBy("node").agg(F.count("*").alias("size"), F.min("id").alias("first")).where("size > 1"), "sizes")
        sized = written(rows.join(sizes, "node"), "sized")
        leaves.append(sized.where(F.col("size") <= LEAF).select("node", "id"))
        large = sized.where(F.col("size") > LEAF).select("node", "id", "first")
        if large.isEmpty():
            break
        if level == DEPTH:
            found.append(around(large))
            break
        sets = written(_among(sets, "id", large), "narrowed")
        judged = written(_around_hubs(large.select("id", "first").distinct(), sets), "judged")
        found.append(around(judged.where("around")))
        stay = large.join(judged.where("not near"), ["id", "first"]).select("node", "id")
        rows = _branch(stay.join(sets.select("id", "sketch"), "id"), root=False)
    small = reduce(DataFrame.unionByName, leaves).join(every.select("id", "n", "brief"), "id").select("node", "id", "n", "brief")
    found.append(_compare_leaves(small, per).select("grp", "id", F.lit(None).cast("long").alias("hub")))
    return written(reduce(DataFrame.unionByName, found).distinct(), "groups")


def _parts(size: str, weight: str, most: int) -> Column:
    """How many parts of half GROUP sets and half `most` shingles a group of so many makes."""
    return F.ceil(F.greatest(F.col(size) * 2 / GROUP, F.col(weight) * 2 / most)).cast("int")


def _confirmed(full: DataFrame, per: int, most: int = SHINGLES) -> DataFrame:
    """(id, component) from groups of sets (grp, hub, size, weight, id, shingles), linked exactly within groups; weight: all shingles of the group."""
    small = (F.col("size") <= GROUP) & (F.col("weight") <= most)
    few = full.where(small).select(F.col("grp").alias("part"), "id", "shingles")
    links = _link_parts(few, per)
    many = full.where(~small)
    if many.isEmpty():
        return components(links)
    parts = _parts("size", "weight", most)
    every = many.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
    # pivots are half a part at most, of its shingles too
    share = F.least(F.lit(float(PIVOTS)) / F.col("size"), F.lit(most / 2) / F.col("weight"))
    pivot = (F.col("id") == F.col("hub")) | (F.xxhash64("id", F.lit(11)) < (F.lit(-(2.0**63)) + F.lit(2.0**64) * share))
    pivots = many.where(pivot).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    first = every.select("grp", "part", "id", "shingles").unionByName(pivots.select("grp", "part", "id", "shingles"))
    first = written(_link_parts(first.select(F.xxhash64("grp", "part").alias("part"), "id", "shingles"), per), "first")
    settled = components(first)
    slim = many.select("grp", "size", "id", (F.octet_length("shingles") / 8).cast("long").alias("n")).join(settled, "id", "left").withColumn("component", F.coalesce("component", "id"))
    slim = written(slim, "settled")
    counts = slim.groupBy("grp", "component").agg(F.count("*").alias("count"), F.sum("n").alias("n"))
    top = F.max(F.struct("count", "component", "n"))
    largest = written(counts.groupBy("grp").agg(top["component"].alias("largest"), (F.sum("count") - top["count"]).alias("n_rest"), (F.sum("n") - top["n"]).alias("weight_rest")), "largest")
    rest = written(slim.join(largest, "grp").where("component <> largest").select("grp", "id"), "rest")
    if rest.isEmpty():
        return components(links.unionByName(first))
    counts = largest.where("n_rest > 0").select("grp", "n_rest", "weight_rest")
    batches = _parts("n_rest", "weight_rest", most)
    rest_sets = many.join(rest, ["grp", "id"], "left_semi").join(counts, "grp").withColumn("batch", F.pmod(F.xxhash64("id", F.lit(3)), batches).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    whole = every.join(counts, "grp").withColumn("batch", F.explode(F.sequence(F.lit(0), batches - 1)))
    second = rest_sets.select("grp", "part", "batch", "id", "shingles").unionByName(whole.select("grp", "part", "batch", "id", "shingles"))
    second = _link_parts(second.select(F.xxhash64("grp", "part", "batch").alias("part"), "id", "shingles"), per)
    return components(links.unionByName(first).unionByName(second))


def _keyed(sets: DataFrame) -> tuple[DataFrame, bool]:
    """sets with `id` unique and never null, and the document's as `own`, and whether they differ: sets without an id, or that share one, get a hash of the set."""
    shared = written(sets.groupBy("id").count().where("count > 1 or id is null").select(F.col("id").alias("shared"), F.lit(True).alias("twice")), "shared")
    if shared.isEmpty():
        return sets.withColumn("own", F.col("id")), False
    both = sets.join(shared, F.col("id").eqNullSafe(F.col("shared")), "left").withColumn("own", F.col("id"))
    both = both.withColumn("id", F.when(F.col("twice"), F.xxhash64("set_hash")).otherwise(F.col("id")))
    return written(both.drop("shared", "twice"), "keyed"), True


def near_duplicates(docs: DataFrame, words: int = 5, per: int = 80, text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, group_key for each row of docs, after the columns named in `also`.

    Two sets are linked if 100 * intersection >= per * union. component_id is the least
    doc_id reachable over links, kept whether it is the row's own (without any id: true).
    group_key is the same for the rows of a component, with ids or without, null for empty
    sets. Other columns of docs are not returned.
    """
    slim = docs.select(F.col(text).cast("string").alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("known_by"))
    rows = docs.select(*also, F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    described = written(_described(rows, words, full=False, text="text"), "sketches")
    own = described.where("set_hash is not null")
    reps = written(own.groupBy("set_hash").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.first("brief").alias("brief")), "sets")
    reps, differ = _keyed(reps)
    groups = _candidates(reps.select("id", "n", "sketch", "brief"), per)
    sizes = groups.join(reps.select("id", "n"), "id").groupBy("grp").agg(F.count("*").alias("size"), F.sum("n").alias("weight"))
    mine = groups.join(written(sizes, "sizes"), "grp").groupBy("id").agg(F.collect_list(F.struct("grp", "hub", "size", "weight")).alias("groups"))
    members = written(mine.join(reps.select("id", F.coalesce("own", F.lit(0)).alias("own"), F.col("set_hash").alias("own_hash")), "id"), "members")
    again = _described(_among(slim, "known_by", members.select(F.col("own").alias("id"))), words, full=True, text="text")
    full = again.join(members, (F.col("known_by") == F.col("own")) & (F.col("set_hash") == F.col("own_hash"))).dropDuplicates(["id"])
    full = written(full.select("id", "groups", "shingles"), "full").select("id", "shingles", F.explode("groups").alias("g")).select("g.*", "id", "shingles")
    labels = _confirmed(full, per)
    named = reps.select("set_hash", "id", "own").join(labels, "id", "left").select("set_hash", "own", F.coalesce("component", "id").alias("group_key"))
    if differ:  # components are named by keys: name them by the least document
        least = named.groupBy("group_key").agg(F.min("own").alias("component"))
        named = named.join(least, "group_key").select("set_hash", "group_key", "component")
    else:
        named = named.select("set_hash", "group_key", F.col("group_key").alias("component"))
    out = described.select(*also, "doc_id", "n_shingles", "set_hash").join(written(named, "named"), "set_hash", "left")
    component = F.when(F.col("set_hash").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select(*also, "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"), "group_key")

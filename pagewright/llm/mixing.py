"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only.

Each source has a target in words. A document's expected copies fall slowly with its size,
so that a source's share is not filled by a few very long texts: for sizes from 2^k to
2^(k+1) - 1 they are level / (LEAN + k), most_times at most, and the level is the one at
which the expected words of a source are its target. The whole part of a document's
expected copies is allotted as certain copies; the fraction p that remains is its
inclusion probability, which differs within a source. Each document draws u in (0, 1) from
a hash of its id and text, and the documents of a source rank by their random odds over
their inclusion odds, (u / (1 - u)) / (p / (1 - p)), the least first; the sample is the
front of that order whose words come nearest to what the certain copies leave. At most one
row of a source then joins or leaves, if its size closes the gap that whole documents left.

Rows alike in id, source and text are one unit with a number of rows, which the order
takes row by row; so repeated rows draw alike, yet may be taken in part, and which of them
are makes no difference. Nothing here puts a source or a unit in one task: a source is cut
into SLICES along its order, running sums are taken within slices, and sums of whole
slices are carried across; units are made rows again in pieces of PIECE. Sources are
numbered by a distributed sort, and the common level of their targets is found by sums
alone, so their number does not matter either. Reruns agree.

Null and empty texts have size 0 and take 0 words; as certain copies cost nothing they
share those of the smallest documents of their source; in a source with no words nothing
is taken. Null sources are one source, last in order. Rows with a null id draw by their
text. Empty tables give none. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.shared import checkpointed, written

#: Slices of a source along its order; rows of a unit that one row of a table stands for at most.
SLICES, PIECE = 1024, 4096
#: How slowly expected copies fall with the size: as 1 / (LEAN + logarithm of the size).
LEAN = 4.0

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_digest(text: Column) -> Column:
    """Hexadecimal MD5 sum; null counts as empty."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def draw(doc_id: Column, digest: Column) -> Column:
    """u in (0, 1): the first 48 bits of an MD5 sum, and a half."""
    made = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":mix:"), digest).cast("binary"))
    return (F.conv(F.substring(made, 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)


def numbered(sources: DataFrame) -> DataFrame:
    """Sources with `place`, from 0, in order of code points, null last; sorted by ranges, counted by partition."""
    ordered = checkpointed(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition of the sort
    counts = ordered.groupBy(part.alias("part")).count().select("part", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("ahead"))
    return ordered.withColumn("part", part).join(counts, "part").withColumn("place", F.col("ahead") + F.col("at") - F.shiftleft("part", 33)).drop("at", "part", "ahead")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most_times: float) -> DataFrame:
    """A row for each source of sizes (source, words): source, source_size, target.

    Sources in order weigh `weights` in turn and share `share` of all words. A target stops
    at `most_times` its source's words and the excess is shared anew by weight. So targets
    are weight times one common level, but for those stopped. The level rises from sum to
    sum: what a level stops, every higher one stops.
    """
    sources = numbered(sizes.groupBy("source").agg(F.sum("words").cast("long").alias("source_size")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = checkpointed(sources.select("source", "source_size", weight.alias("weight"), (most_times * F.col("source_size")).alias("stop")))
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level, before = 0.0, None
    while level != before:
        before, free = level, F.col("stop") > F.col("weight") * level
        stopped, rest = sources.agg(F.coalesce(F.sum(F.when(~free, F.col("stop"))), F.lit(0.0)), F.sum(F.when(free, F.col("weight")))).first()
        level = (total - stopped) / rest if rest else float("inf")
    return sources.select("source", "source_size", F.least("stop", F.col("weight") * level if level < float("inf") else F.col("stop")).alias("target"))


def size_class(size: Column) -> Column:
    """The k of 2^k <= size < 2^(k+1); 0 for size 0."""
    return F.length(F.bin(size)) - 1


def expected_copies(classes: DataFrame, most_times: float) -> DataFrame:
    """(source, k, source_size, target, certain, p, wanted, odds) of classes (source, k, words, source_size, target).

    wanted: words that the sample adds; odds: p / (1 - p) at the source's mean p. Classes
    with the smallest sizes reach most_times first; the level is that of the first k that
    does not. A source has few classes, whatever its size.
    """
    per = 1.0 / (LEAN + F.col("k"))
    before = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.partitionBy("source").orderBy("k").rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy("source")
    level = (F.col("target") - most_times * F.coalesce(F.sum("words").over(before), F.lit(0))) / F.nullif(F.sum(per * F.col("words")).over(onward), F.lit(0.0))
    made = classes.withColumn("level", level)
    free = F.col("level") * per < most_times
    made = made.withColumn("shared", F.min(F.when(free, F.struct("k", "level"))).over(whole)["level"])
    # least() passes nulls over: classes that are all stopped have no shared level
    copies = F.when(F.col("source_size") > 0, F.least(F.col("shared") * per, F.lit(most_times))).otherwise(0.0)
    made = made.withColumn("certain", F.floor(copies)).withColumn("p", copies - F.floor(copies))
    made = made.withColumn("wanted", F.col("target") - F.sum(F.col("certain") * F.col("words")).over(whole))
    able = F.sum(F.when(F.col("p") > 0, F.col("words")).otherwise(0)).over(whole)
    return made.select("source", "k", "source_size", "target", "certain", "p", "wanted", F.coalesce(F.col("wanted") / F.nullif(able - F.col("wanted"), F.lit(0.0)), F.lit(1.0)).alias("odds"))


def allot(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.0, most_times: float = 3.0, text: str = "text") -> DataFrame:
    """A row for each unit of rows alike: doc_id, source, digest, size, rows, source_size, target, certain, extra.

    The mix takes each of its rows `certain` times, and `extra` of them once more.
    """
    whole_text = F.col(text).cast("string")
    slim = docs.select("doc_id", F.col("source").cast("string").alias("source"), text_digest(whole_text).alias("digest"), word_count(whole_text).alias("size"))
    units = slim.groupBy("doc_id", "source", "digest", "size").agg(F.count("*").alias("rows"))
    units = written(units.withColumn("u", draw(F.col("doc_id"), F.col("digest"))).withColumn("k", size_class(F.col("size"))), "units")
    classes = checkpointed(units.groupBy("source", "k").agg(F.sum(F.col("size") * F.col("rows")).alias("words")))
    targets = source_targets(classes, weights, share, most_times).withColumnRenamed("source", "s")
    classes = classes.join(targets, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    planned = written(expected_copies(classes, most_times).withColumnsRenamed({"source": "s", "k": "c"}), "copies")

    ratio = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    both = units.join(planned, F.col("source").eqNullSafe(F.col("s")) & (F.col("k") == F.col("c"))).drop("s", "c")
    both = both.withColumn("able", (F.col("p") > 0) & (F.col("size") > 0)).withColumn("ratio", F.when(F.col("able"), ratio))
    place = F.col("ratio") * F.col("odds")  # about u / (1 - u), so slices are about equal
    both = written(both.withColumn("slice", F.floor(place / (1 + place) * SLICES)), "ranked")

    # words of all slices before, for each slice of a source: at most SLICES + 1 rows a source
    ahead = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = both.where("able").groupBy("source", "slice").agg(F.sum(F.col("size") * F.col("rows")).alias("words"))
    slices = written(slices.select(F.col("source").alias("s"), F.col("slice").alias("i"), F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead")), "slices")
    within = Window.partitionBy("source", "slice").orderBy("ratio", "u", "doc_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    at_slice = F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("i"))
    begun = F.col("ahead") + F.coalesce(F.sum(F.col("size") * F.col("rows")).over(within), F.lit(0))
    one = (begun + F.col("size") / 2 < F.col("wanted")).cast("long")
    several = F.greatest(F.lit(0), F.least(F.col("rows"), F.ceil((F.col("wanted") - begun) / F.col("size") - 0.5)))
    drawn = both.where("able").join(slices, at_slice).withColumn("drawn", F.when(F.col("rows") == 1, one).otherwise(several)).select(*both.columns, "drawn")
    drawn = written(drawn, "drawn")

    # the one row of a source that closes the gap best: sums, then candidates, by slice and then by source
    got = drawn.groupBy("source").agg(F.sum(F.col("drawn") * F.col("size")).alias("got"), F.first("wanted").alias("w"))
    got = written(got.select(F.col("source").alias("s"), (F.col("w") - F.col("got")).alias("gap")), "gaps")
    joins = F.when(F.col("drawn") < F.col("rows"), F.abs(F.col("gap") - F.col("size")))
    leaves = F.when(F.col("drawn") > 0, F.abs(F.col("gap") + F.col("size")))
    left = F.least(joins, leaves)
    near = drawn.join(got, F.col("source").eqNullSafe(F.col("s"))).where(left < F.abs("gap"))
    turn = F.when(F.coalesce(joins <= leaves, leaves.isNull()), 1).otherwise(-1)
    best = near.groupBy("source").agg(F.min(F.struct(left.alias("left"), "u", "doc_id", "digest", turn.alias("turn"))).alias("b"))
    best = best.select(F.col("source").alias("s"), F.col("b.doc_id").alias("d"), F.col("b.digest").alias("t"), F.col("b.turn").alias("turn"))
    same = F.col("source").eqNullSafe(F.col("s")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("t"))
    closed = drawn.join(written(best, "closing"), same, "left").withColumn("extra", F.col("drawn") + F.coalesce("turn", F.lit(0)))
    columns = ["doc_id", "source", "digest", "size", "rows", "source_size", "target", F.col("certain").cast("int").alias("certain")]
    return closed.select(*columns, "extra").unionByName(both.where("not able").select(*columns, F.lit(0).cast("long").alias("extra")))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.0, most_times: float = 3.0, text: str = "text") -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, copies, taken.

    copies is how many times the mix takes the whole document, 0 to ceil(most_times).
    """
    units = allot(docs, weights, share, most_times, text)
    pieces = units.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(PIECE).cast("long"))))
    pieces = written(pieces, "pieces").hint("rebalance")
    last = F.least(F.col("from") + PIECE, F.col("rows")) - 1
    each = pieces.withColumn("row", F.explode(F.sequence(F.col("from"), last)))
    copies = F.col("certain") + (F.col("row") < F.col("extra")).cast("int")
    return each.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies.cast("long") * F.col("size")).alias("taken"))


def repeated(docs: DataFrame, units: DataFrame) -> DataFrame:
    """docs as the mix takes them, by the units of allot: a row for each copy.

    A row alone in its unit is there as often as it is taken; of rows alike each is there
    `certain` times, and the first of them, by its other columns, `extra` times more.
    """
    units = written(units.select(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("digest").alias("__t"), F.col("rows").alias("__rows"), F.col("certain").alias("__certain"), F.col("extra").alias("__extra")).where("__certain > 0 or __extra > 0"), "taken")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & F.col("source").cast("string").eqNullSafe(F.col("__s")) & (F.col("__t0") == F.col("__t"))
    both = docs.withColumn("__t0", text_digest(F.col("text").cast("string"))).join(units, same)
    copies = F.when(F.col("__rows") == 1, F.col("__certain") + F.col("__extra")).otherwise(F.col("__certain"))
    made = both.where(copies > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), copies.cast("long")))).select(*columns)
    if units.where("__rows > 1 and __extra > 0").isEmpty():
        return made
    first = both.where("__rows > 1 and __extra > 0").groupBy("__d", "__s", "__t", "__extra").agg(F.min(F.struct(*columns)).alias("row"))
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__extra") - 1, F.lit(PIECE).cast("long")))
    pieces = first.select("row", "__extra", starts.alias("from")).hint("rebalance")
    more = pieces.withColumn("__copy", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + PIECE, F.col("__extra")) - 1)))
    return made.unionByName(more.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))

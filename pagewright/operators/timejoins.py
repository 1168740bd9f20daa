"""Joins over time: the latest earlier row of each key, and points within spans.

Both are equi-joins and windows for the planner, on keys that are cut finer than the data:
a key that holds a third of all rows is many tasks, and no pair is ever tried outside a cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.operators.slices import SLICE_ROWS, sliced

#: Spans and points of a bin that meet in one cell, about.
CELL = 4096
#: Hashes of bins that are broadcast, at most; and types whose equal values have equal hashes.
MET, HASHED = 1 << 18, ("tinyint", "smallint", "int", "bigint", "date", "timestamp", "string")


def _micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def _complete(by: list[str], *more: Column) -> Column:
    whole = F.lit(True)
    for c in [*(F.col(b) for b in by), *more]:
        whole = whole & c.isNotNull()
    return whole


def as_of_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, columns: list[str], tolerance: float | None = None, equal: bool = True, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """left with `columns` of the latest row of right that has its key and is not later.

    equal: a right row at the very time counts. tolerance: seconds that it may lie back, or
    the columns are null, as they are where there is none. Of right rows at one time the one
    with the greatest `columns`, in their order, counts. Rows with a null in key or time match
    nothing. Columns of left that bear one of the names are replaced.

    Both sides are put in one order by key and time. A key of many rows is cut into slices of
    its time; the last right row before a slice is carried into it, and a slice is one sorted
    run of a task, in which the last right row so far is the match.
    """
    kept = [c for c in left.columns if c.lower() not in {n.lower() for n in columns}]
    named = [F.col(f"`{c}`") for c in kept]
    whole = _complete(by, F.col(left_time))
    key = F.struct(*[F.col(b) for b in by])
    kind = right.select(F.struct(F.lit(0).cast("long").alias("t"), *columns).alias("r")).schema["r"].dataType
    lefts = left.where(whole).select(key.alias("__k"), _micros(F.col(left_time)).alias("__t"), F.lit(1 if equal else -1).alias("__side"), F.struct(*named).alias("__left"), F.lit(None).cast(kind).alias("__right"))
    latest = right.where(_complete(by, F.col(right_time))).select(key.alias("__k"), _micros(F.col(right_time)).alias("__t"), F.struct(*columns).alias("__c"))
    latest = latest.groupBy("__k", "__t").agg(F.max("__c").alias("__c"))
    rights = latest.select("__k", "__t", F.lit(0).alias("__side"), F.lit(None).cast(lefts.schema["__left"].dataType).alias("__left"), F.struct(F.col("__t").alias("t"), *[F.col("__c")[c].alias(c) for c in columns]).alias("__right"))
    rows = sliced(lefts.unionByName(rights), slice_rows)

    before = Window.partitionBy("__k").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)  # SLICES rows at most
    ends = rows.groupBy("__k", "__slice").agg(F.max_by("__right", F.when(F.col("__right").isNotNull(), F.col("__t"))).alias("__end"))
    carried = ends.withColumn("__right", F.last("__end", ignorenulls=True).over(before)).where(F.col("__right").isNotNull())
    carried = carried.select("__k", F.lit(-(2**63)).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(lefts.schema["__left"].dataType).alias("__left"), "__right", "__slice")

    run = Window.partitionBy("__k", "__slice").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.unionByName(carried).withColumn("__found", F.last("__right", ignorenulls=True).over(run)).where(F.col("__left").isNotNull())
    near = F.lit(True) if tolerance is None else F.col("__t") - F.col("__found.t") <= F.lit(int(tolerance * 1_000_000))
    matched = found.select("__left.*", *[F.when(near, F.col("__found")[c]).alias(c) for c in columns])
    other = left.where(~whole).select(*named, *[F.lit(None).cast(kind[c].dataType).alias(c) for c in columns])
    return matched.unionByName(other)


def _met(rows: DataFrame, others: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose columns `on` may be those of some of the others, by MET hashes; of some that no other has, too."""
    place = F.pmod(F.xxhash64(*on), F.lit(MET)).alias("__met")
    return rows.withColumn("__met", place).join(F.broadcast(others.select(place).distinct()), "__met", "left_semi").drop("__met")


def interval_join(points: DataFrame, spans: DataFrame, time: str, start: str, end: str, by: list[str] | None = None, cell: int = CELL) -> DataFrame:
    """Pairs of a point and a span with start <= time < end, and equal keys `by` where given.

    Columns of both, under their names; of key columns one. Empty and inverted spans, and rows
    with a null in key or time, match nothing.

    A span goes to the level whose bins are as wide as it is long, up to four times, so it lies
    in two bins at most, however long; a point goes to one bin of each level that spans have.
    So a span is compared with the points of little more than itself. Where many spans or
    points share a bin, the bin is cut into cells of about `cell` spans by `cell` points. Spans of
    keys that no point has, and points in bins without a span, are left out before the shuffle.
    """
    by = by or []
    span_columns = [c for c in spans.columns if c not in by]
    point_columns = [c for c in points.columns if c not in by]
    s, e = _micros(F.col(start)), _micros(F.col(end))
    key = [F.col(b).alias(f"__k{i}") for i, b in enumerate(by)]
    keys = [f"__k{i}" for i in range(len(by))]
    whole = spans.where(_complete(by, F.col(start), F.col(end))).select(*key, s.alias("__s"), e.alias("__e"), F.struct(*[F.col(f"`{c}`") for c in span_columns]).alias("__span")).where("__s < __e")
    level = F.ceil(F.log2((F.col("__e") - F.col("__s")).cast("double")) / 2).cast("int")
    whole = whole.withColumn("__level", level)
    dots = points.where(_complete(by, F.col(time))).select(*key, _micros(F.col(time)).alias("__t"), F.struct(*[F.col(f"`{c}`") for c in point_columns]).alias("__point"))
    kinds = dict(dots.dtypes)
    hashed = [k for k, kind in whole.dtypes if k in keys and kind == kinds[k] and kind in HASHED]
    whole = _met(whole, dots, hashed) if hashed else whole
    levels = sorted(r[0] for r in whole.select("__level").distinct().collect())  # 32 at most
    bins = F.sequence(F.expr("shiftright(__s, 2 * __level)"), F.expr("shiftright(__e - 1, 2 * __level)"))
    in_bins = whole.withColumn("__bin", F.explode(bins))
    dots = dots.withColumn("__level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))).withColumn("__bin", F.expr("shiftright(__t, 2 * __level)"))
    dots = _met(dots, in_bins, [*hashed, "__level", "__bin"])

    place = [*keys, "__level", "__bin"]
    crowded = lambda df, name: df.groupBy(*place).agg(F.ceil(F.count("*") / cell).cast("int").alias(name)).where(F.col(name) > 1)
    hot = crowded(in_bins, "__ns").join(crowded(dots, "__np"), place, "full")
    one = lambda name: F.coalesce(name, F.lit(1))
    each = lambda name: F.explode(F.sequence(F.lit(0), one(name) - 1))
    mine = lambda column, name: F.pmod(F.xxhash64(column), one(name)).cast("int")
    in_cells = in_bins.join(hot, place, "left").withColumn("__i", mine("__span", "__ns")).withColumn("__j", each("__np")).drop("__ns", "__np")
    dots = dots.join(hot, place, "left").withColumn("__j", mine("__point", "__np")).withColumn("__i", each("__ns")).drop("__ns", "__np")
    # rows that pack well look small enough to be broadcast, and are not
    both = in_cells.join(dots.hint("merge"), [*place, "__i", "__j"]).where("__s <= __t and __t < __e")
    return both.select(*[F.col(k).alias(b) for k, b in zip(keys, by, strict=True)], "__point.*", "__span.*")


def interval_totals(points: DataFrame, spans: DataFrame, time: str, start: str, end: str, count: str, sums: list[str], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """points with the number of spans with start <= time < end, and their sums of columns of whole numbers; points in no span are left out.

    As counting the rows of interval_join would, without its pairs: a span adds at its start
    what it takes off at its end, and a point has the sum of all that is not later. Time is
    cut into slices, and the sum of the slices before is carried into each.
    """
    s, e = _micros(F.col(start)), _micros(F.col(end))
    known = [f"__known{i}" for i in range(len(sums))]
    adds = [count, *sums, *known]
    values = [F.lit(1).cast("long").alias(count), *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in sums], *[F.col(c).isNotNull().cast("long").alias(k) for c, k in zip(sums, known, strict=True)]]
    whole = spans.where(_complete([], F.col(start), F.col(end))).select(s.alias("__s"), e.alias("__e"), *values).where("__s < __e")
    ends = F.array(F.struct(F.col("__s").alias("__t"), *adds), F.struct(F.col("__e").alias("__t"), *[(-F.col(c)).alias(c) for c in adds]))
    changes = whole.select(F.explode(ends).alias("x")).groupBy("x.__t").agg(*[F.sum(F.col("x")[c]).alias(c) for c in adds])
    kept = [c for c in points.columns if c.lower() not in {a.lower() for a in adds}]
    dots = points.where(_complete([], F.col(time))).select(_micros(F.col(time)).alias("__t"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__point"))
    key = F.struct(F.lit(0).alias("k")).alias("__k")
    none = F.lit(None).cast(dots.schema["__point"].dataType).alias("__point")
    rows = changes.select(key, "__t", F.lit(0).alias("__side"), none, *adds).unionByName(dots.select(key, "__t", F.lit(1).alias("__side"), "__point", *[F.lit(0).cast("long").alias(c) for c in adds]))
    rows = sliced(rows, slice_rows)

    ahead = Window.partitionBy("__k").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)  # SLICES rows at most
    carried = rows.groupBy("__k", "__slice").agg(*[F.sum(c).alias(c) for c in adds]).select("__k", "__slice", F.lit(-(2**63)).alias("__t"), F.lit(0).alias("__side"), none, *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(c) for c in adds])
    run = Window.partitionBy("__k", "__slice").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.unionByName(carried).withColumns({c: F.sum(c).over(run) for c in adds}).where(F.col("__point").isNotNull() & (F.col(count) > 0))
    return found.select("__point.*", count, *[F.when(F.col(k) > 0, F.col(c)).alias(c) for c, k in zip(sums, known, strict=True)])

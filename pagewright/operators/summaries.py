"""Summaries of rows: subtotals with distinct counts, mergeable sketches, the best rows of each key, and differences of multisets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Subtotals


def cube_sets(dims: Sequence[str]) -> list[tuple[str, ...]]:
    """All subsets of dims, as CUBE has them."""
    return [tuple(d for j, d in enumerate(dims) if not i >> (len(dims) - 1 - j) & 1) for i in range(1 << len(dims))]


def rollup_sets(dims: Sequence[str]) -> list[tuple[str, ...]]:
    """All beginnings of dims, as ROLLUP has them."""
    return [tuple(dims[:i]) for i in range(len(dims), -1, -1)]


def subtotals(rows: DataFrame, dims: list[str], sets: list[tuple[str, ...]], sums: dict[str, Column], distinct: dict[str, Column] | None = None) -> DataFrame:
    """dims, level, and for each of the grouping sets and its values the sums and the numbers of distinct values.

    level has a bit for each of dims, the first highest: 1 where the row is over all its
    values (and the column null, as it is for values that are null; level tells them apart).
    Sums of no values, and distinct counts, leave nulls out.

    Rows are combined by all dims, and by each distinct value once, before they are expanded
    into the grouping sets: what is expanded are groups, not rows, and a group that holds a
    third of all rows is combined where it lies.
    """
    given = [F.struct(*[F.col(d) for d in dims]).alias("__d")]
    total = rows.select(*given, *[c.alias(n) for n, c in sums.items()]).groupBy("__d").agg(*[F.sum(n).alias(n) for n in sums])
    made = _by_sets(total, dims, sets, [F.sum(n).alias(n) for n in sums])
    for name, column in (distinct or {}).items():
        values = rows.select(*given, column.alias(name)).distinct()
        counts = _by_sets(values, dims, sets, [F.count_distinct(name).alias(name)])
        same = reduce(Column.__and__, [F.col(f"a.{d}").eqNullSafe(F.col(f"b.{d}")) for d in dims], F.col("a.level") == F.col("b.level"))
        made = made.alias("a").join(counts.alias("b"), same).select("a.*", F.col(f"b.{name}"))
    return made


def _by_sets(groups: DataFrame, dims: list[str], sets: list[tuple[str, ...]], measures: list[Column]) -> DataFrame:
    flat = groups.select("__d.*", *[c for c in groups.columns if c != "__d"])
    wanted = flat.groupingSets([[F.col(d) for d in s] for s in sets], *dims)
    return wanted.agg(F.grouping_id(*dims).cast("int").alias("level"), *measures)


# Sketches that are kept and merged

#: Logarithm of the slots of a distinct-count sketch, and size of a quantile sketch.
LG_SLOTS, QUANTILE_K = 12, 400
#: Three standard errors of a distinct count; how far in rank a quantile may be off.
DISTINCT_ERROR, RANK_ERROR = 3 * 1.04 / 64, 0.01


def sketched(rows: DataFrame, by: list[str], distinct: Column, value: Column) -> DataFrame:
    """by, n, distinct_sketch, value_sketch: the state of each group as columns that can be written, and merged later.

    n counts all rows; nulls are in no sketch. distinct must be of whole numbers, strings or bytes.
    """
    mine = rows.withColumns({"__x": distinct, "__v": value.cast("double")})
    return mine.groupBy(*by).agg(F.count("*").alias("n"), F.hll_sketch_agg("__x", LG_SLOTS).alias("distinct_sketch"), F.kll_sketch_agg_double("__v", QUANTILE_K).alias("value_sketch"))


def merged_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of finer groups as sketches of coarser ones: the same state, within its error, as one pass over all rows."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("value_sketch").alias("value_sketch"))


def estimates(sketches: DataFrame, ranks: Sequence[float]) -> DataFrame:
    """sketches with distinct_estimate and quantiles (at the ranks) in place of their state."""
    quantiles = F.kll_sketch_get_quantile_double("value_sketch", F.array(*[F.lit(float(r)) for r in ranks]))
    made = sketches.withColumns({"distinct_estimate": F.hll_sketch_estimate("distinct_sketch"), "quantiles": quantiles})
    return made.drop("distinct_sketch", "value_sketch")


# The best rows of each key


def best_of_each(rows: DataFrame, by: list[str], order: list[Column], k: int, salts: int = 64) -> DataFrame:
    """The first k rows of each key by order, with rank from 1; the order should tell all rows apart.

    A key is dealt to `salts` groups by a hash of its rows, of which the first k each are
    ranked again: no task reads a whole key, and what meets in one is salts * k rows. Spark
    keeps k of a group before each shuffle, too. Null keys are one key.
    """
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(salts)))
    some = salted.withColumn("__r", F.row_number().over(Window.partitionBy(*by, "__salt").orderBy(*order))).where(F.col("__r") <= k)
    return some.drop("__salt", "__r").withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


# Differences of multisets


def left_over(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left that right has not, as often as it has them less."""
    return left.exceptAll(right.select(*left.columns))


def in_both(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both, as often as both have them."""
    return left.intersectAll(right.select(*left.columns))


def without_match(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of left whose key, nulls being equal, no row of right has; each distinct key of right counts once."""
    keys = right.select(*[F.col(c).alias(f"__{c}") for c in on]).distinct()
    return left.join(keys, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on]), "left_anti")


def reconciled(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each distinct row of either side with n_left and n_right, how often they have it, where those differ.

    Both sides are counted where they lie before one shuffle, so rows that are very many
    copies are one row of it.
    """
    columns = left.columns
    counted = lambda df, a, b: df.select(*columns, F.lit(a).alias("__l"), F.lit(b).alias("__r"))
    both = counted(left, 1, 0).unionByName(counted(right, 0, 1))
    sums = both.groupBy(*columns).agg(F.sum("__l").cast("long").alias("n_left"), F.sum("__r").cast("long").alias("n_right"))
    return sums.where("n_left <> n_right")

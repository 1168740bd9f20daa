"""Keys that hold very many rows, cut into slices of an order, so that windows over them are many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a key that are one slice, about; slices of a key at most.
SLICE_ROWS, SLICES = 2_000_000, 1024


def sliced(rows: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """rows (__k, __t, ...) with __slice: 0, or for keys of over slice_rows rows the number of its quantiles of __t up to the row's own.

    A slice depends on the key and __t (a whole number) alone, so rows of one __t stay together.
    """
    counts = rows.groupBy("__k").count().where(F.col("count") > slice_rows).select(F.col("__k").alias("__hot"), F.least(F.ceil(F.col("count") / slice_rows), F.lit(SLICES)).cast("int").alias("__n"))
    ranks = [i / SLICES for i in range(1, SLICES)]
    hot = rows.select("__k", "__t").join(counts, F.col("__k") == F.col("__hot"))
    cuts = hot.groupBy(F.col("__k").alias("__hot")).agg(F.percentile_approx("__t", ranks, 10_000).alias("__q"), F.first("__n").alias("__n"))
    few = F.expr(f"transform(sequence(1, __n - 1), i -> element_at(__q, cast(i * {SLICES} div __n as int)))")
    cuts = cuts.select("__hot", few.alias("__cuts"))
    place = F.when(F.col("__cuts").isNull(), 0).otherwise(F.size(F.filter("__cuts", lambda c: c <= F.col("__t"))))
    return rows.join(cuts, F.col("__k") == F.col("__hot"), "left").withColumn("__slice", place).drop("__hot", "__cuts")


def with_place(rows: DataFrame, key: Column, order: Column, name: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """rows with their place, from 1, among those of a key (nulls are one key) in order of a whole number.

    Rows are numbered within slices, and the sizes of the slices before are added: there are
    SLICES of a key at most, whatever its rows.
    """
    marked = sliced(rows.withColumns({"__k": F.struct(key.alias("k")), "__t": order.cast("long")}), slice_rows)
    ahead = Window.partitionBy("__k").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = marked.groupBy("__k", "__slice").count()
    begins = sizes.select(F.col("__k").alias("__bk"), F.col("__slice").alias("__bs"), F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("__begin")).where("__bs > 0")
    within = F.row_number().over(Window.partitionBy("__k", "__slice").orderBy("__t"))
    both = marked.withColumn(name, within).join(begins, (F.col("__k") == F.col("__bk")) & (F.col("__slice") == F.col("__bs")), "left")
    return both.withColumn(name, F.col(name) + F.coalesce("__begin", F.lit(0))).drop("__k", "__t", "__slice", "__bk", "__bs", "__begin")

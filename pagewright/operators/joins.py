"""Lookups: ground truth by file name or stem, and templates filled from parsed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import file_name, file_stem
from pagewright.operators.slices import SLICE_ROWS, with_place


def with_ground_truth(predictions: DataFrame, truth: DataFrame, path: str = "source_path", strict: bool = True) -> DataFrame:
    """predictions with reference, from truth (key, reference), by file name, or else by stem.

    An empty reference under the name counts as none. Without any, strict fails; otherwise
    reference is null. Of references with one key the last counts, by column `at` where truth
    has it (at one place the greatest text), else the greatest text.

    Which key a path has is settled first, without any text: then the texts of those keys are
    fetched once and joined to predictions by path. The planner chooses the joins; truth may
    be as large as predictions.
    """
    given, there = F.coalesce(F.col("reference") != "", F.lit(False)), F.col("reference").isNotNull()
    at = [F.col("at")] if "at" in truth.columns else []
    slim = truth.select("key", F.struct(*at, given.alias("given"), there.alias("there")).alias("last"))
    keys = slim.groupBy("key").agg(F.max("last").alias("last"))
    paths = predictions.select(F.col(path).alias("__path")).distinct()
    named = paths.withColumns({"__name": file_name(F.col("__path")), "__stem": file_stem(F.col("__path"))})
    one = keys.select(F.col("key").alias("__name"), F.col("last").alias("__one")).where("last.given")
    two = keys.select(F.col("key").alias("__stem"), F.col("last").alias("__two")).where("last.there")
    found = named.join(one, "__name", "left").join(two, "__stem", "left")
    chosen = found.select("__path", F.when(F.col("__one").isNotNull(), F.col("__name")).when(F.col("__two").isNotNull(), F.col("__stem")).alias("__key"), F.coalesce("__one", "__two").alias("__last")).where("__key is not null")
    same = F.col("key") == F.col("__key")
    for c in at:
        same = same & (c == F.col("__last.at"))
    texts = truth.where("reference is not null").join(chosen, same).groupBy("__path").agg(F.max("reference").alias("reference"))
    both = predictions.drop("reference").join(texts, F.col(path) == F.col("__path"), "left")
    found = F.col("reference")
    if strict:
        missing = F.raise_error(F.concat(F.lit("No ground truth found for "), file_name(F.col(path))))
        found = F.when(found.isNotNull(), found).otherwise(missing.cast("string"))
    return both.withColumn("reference", found).drop("__path")


def _given(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def merge_template(template: DataFrame, parsed: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """template (pos, code, name_th, name_en, credits, year, semester, ...) with gaps filled from parsed.

    The nth row with a code takes from the nth parsed row with that code; null codes match
    each other. Only nulls and empty strings are filled. All template rows stay, in their
    places; parsed rows that match none are dropped. A code of very many rows, or none, is
    numbered in slices.
    """
    key = F.coalesce(F.col("code").cast("string"), F.lit("None"))
    names = ("name_th", "name_en", "credits", "year", "semester")
    left, right = (with_place(df, key, F.col("pos"), "__nth", slice_rows).withColumn("__key", key) for df in (template, parsed))
    right = right.select("__key", "__nth", *[F.col(n).alias(f"__{n}") for n in names])
    both = left.join(right, ["__key", "__nth"], "left")
    text = {n: F.coalesce(_given(F.col(n)), _given(F.col(f"__{n}")), F.col(n)) for n in names[:3]}
    number = {n: F.coalesce(F.col(n), F.col(f"__{n}")) for n in names[3:]}
    return both.withColumns(text | number).select(*[F.col(f"`{c}`") for c in template.columns])


def merge_heading(template: DataFrame, parsed: DataFrame) -> DataFrame:
    """doc, source, description, program, plan: the template's, and where it has no program or plan, the parsed ones."""
    other = parsed.select("doc", F.col("program").alias("__program"), F.col("plan").alias("__plan"))
    both = template.join(other, "doc", "left")
    return both.select("doc", "source", "description", F.coalesce("program", "__program").alias("program"), F.coalesce("plan", "__plan").alias("plan"))

"""Rules and payloads whose JSON has no one shape, as variants: parsed once, opened key by key.

A text that is no JSON is null and gives no rows. Nothing is said about keys beforehand, so
a key that appears tomorrow is there tomorrow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """JSON text as a variant; null if it is none."""
    return F.try_parse_json(text)


def many(value: Column) -> Column:
    """An array as it is, anything else as an array of one; null, and the null of JSON, as none."""
    nothing = value.isNull() | F.is_variant_null(value)
    one = F.to_variant_object(F.array(value))
    return F.when(nothing, F.lit(None)).when(F.startswith(F.schema_of_variant(value), F.lit("ARRAY")), value).otherwise(one)


def part(value: Column, name: str, kind: str = "variant") -> Column:
    """A key's value; null if there is no such key, or it is of no such kind."""
    return F.try_variant_get(value, f"$.{name}", kind)


def opened(rows: DataFrame, value: Column, outer: bool = False) -> DataFrame:
    """rows with pos, key (null in arrays) and value for each element of an array or object; outer: one row with nulls where there is none."""
    spark, name = rows.sparkSession, "__opened"
    each = spark.tvf.variant_explode_outer if outer else spark.tvf.variant_explode
    return rows.withColumn(name, value).lateralJoin(each(F.col(name).outer())).drop(name)


def flat_rules(docs: DataFrame, text: str, keep: list[str] | None = None) -> DataFrame:
    """keep, program, category, present, label, value, summary: a row for each value of each rule, one without where there is none.

    Programs may be an object by name or an array of {program, rules}; rules an array or one
    rule; values an array or one value, each an object of value and label, or a bare value.
    present is what reads as a truth value ("yes" too), else null.
    """
    keep = keep or []
    whole = docs.select(*keep, parsed(F.col(text)).alias("v"))
    programs = opened(whole, part(F.col("v"), "programs")).select(*keep, F.coalesce("key", part(F.col("value"), "program", "string")).alias("program"), F.when(F.col("key").isNull(), part(F.col("value"), "rules")).otherwise(F.col("value")).alias("rules"))
    rules = opened(programs, many(F.col("rules"))).select(*keep, "program", F.col("value").alias("rule"))
    own = lambda name, kind: part(F.col("rule"), name, kind).alias(name)
    flat = rules.select(*keep, "program", own("category", "string"), own("present", "boolean"), own("summary", "string"), many(part(F.col("rule"), "values")).alias("values"))
    rows = opened(flat, F.col("values"), outer=True)
    is_object = F.startswith(F.schema_of_variant(F.col("value")), F.lit("OBJECT"))
    label = F.when(is_object, part(F.col("value"), "label", "string"))
    value = F.when(is_object, part(F.col("value"), "value", "string")).otherwise(F.try_variant_get("value", "$", "string"))
    return rows.select(*keep, "program", "category", "present", label.alias("label"), value.alias("value"), "summary")


def payload_keys(payloads: DataFrame, text: str, keep: list[str] | None = None) -> DataFrame:
    """keep, key, kind, value (as text) of every key of every payload that is an object."""
    keep = keep or []
    rows = opened(payloads.select(*keep, parsed(F.col(text)).alias("v")), F.col("v")).where("key is not null")
    return rows.select(*keep, "key", F.schema_of_variant("value").alias("kind"), F.try_variant_get("value", "$", "string").alias("value"))

"""Bounded samples of labelled rows, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.shared import held_out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most_of_each: int, longest: int) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """Texts with labels, and how many labelled rows each class has.

    At most `most_of_each` rows of each class (0, 1): those of least hash of doc_id, so
    that the sample is random, yet the same on every run. Rows held out, rows without a
    label or text, and texts over `longest` characters are not used for fitting. Where a
    document has several labels, the largest counts; where an id has several texts, the least.
    So at most 2 * `most_of_each` rows of `longest` characters come to the driver.
    """
    doc_id = "doc_id"
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
        .groupBy(doc_id).agg(F.max(label).cast("int").alias("__y"))
    )
    sizes = {r["__y"]: r["count"] for r in known.groupBy("__y").count().collect()}
    order = [F.xxhash64(F.col(doc_id).cast("string"), F.lit(7)), F.col(doc_id)]
    chosen = None
    for y in (0, 1):  # each bounded, so that both may be broadcast
        part = known.where(F.col("__y") == y).orderBy(*order).limit(most_of_each)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = (
        docs.select(doc_id, F.col("text").cast("string").alias("text")).where(F.length("text").between(1, longest))
        .join(F.broadcast(chosen), doc_id).groupBy(doc_id, "__y").agg(F.min("text").alias("text")).select(doc_id, "text", "__y").collect()
    )
    rows.sort(key=lambda r: (r[0], r[1]))
    return [(r[1], r[2]) for r in rows], sizes

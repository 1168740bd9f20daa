"""Operators over recognised lines: filter, merge of recognisers, assembly of pages and documents.

Lines are rows (doc, page, seq, text, confidence, box, engine); seq orders the lines of a
page. Every operator is DataFrame to DataFrame and leaves strategy to the planner; the
windows share the prefix (doc, page), so they share one shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import strip, whole_number

#: The top of a line without a usable box.
NO_TOP = 1e9

#: The heading of a page; its digits may be of any script.
MARKER = r"--- Page (\p{Nd}+) ---"


def min_confidence(lines: DataFrame, least: float) -> DataFrame:
    """Lines of at least this confidence, or of unknown; all of them for 0 or less."""
    known = F.col("confidence")
    return lines.where(known.isNull() | (known >= least)) if least > 0 else lines


def box_top(box: Column) -> Column:
    """Least y of the points; NO_TOP without points or if any has no y."""
    ys = F.transform(box, lambda p: F.try_element_at(p, F.lit(2)))
    return F.when((F.size(box) > 0) & ~F.exists(ys, lambda y: y.isNull()), F.array_min(ys)).otherwise(F.lit(NO_TOP))


def numbered_pages(docs: DataFrame, pages: str = "pages") -> DataFrame:
    """A row for each element of an array, with page from 1."""
    return docs.select("*", F.posexplode(pages).alias("__p", "item")).withColumn("page", F.col("__p") + 1).drop("__p")


def ranked(*recognised: DataFrame | None) -> DataFrame:
    """Lines of several recognisers with engine_rank, their place in the call. None is no lines."""
    parts = [df.withColumn("engine_rank", F.lit(i)) for i, df in enumerate(recognised) if df is not None]
    return reduce(DataFrame.unionByName, parts)


def numbered(lines: DataFrame) -> DataFrame:
    """Lines of ranked() as one sequence a page: the first recogniser's lines first."""
    order = Window.partitionBy("doc", "page").orderBy("engine_rank", "seq")
    return lines.withColumn("seq", F.row_number().over(order)).drop("engine_rank")


def best_lines(lines: DataFrame) -> DataFrame:
    """One line for each distinct stripped text of a page: that of highest confidence, the earlier on a tie.

    A null confidence counts as 0. The lines of a page are ordered by their top, and among
    equal tops by where the text was first seen; seq is that order, from 1. Blank lines go;
    a line without an engine, which stands for its page, stays.
    """
    lines = lines.withColumn("key", strip(F.col("text"))).where("key <> '' or engine is null")
    same = Window.partitionBy("doc", "page", "key")
    best = same.orderBy(F.coalesce("confidence", F.lit(0.0)).desc(), "seq")
    kept = lines.withColumn("rank", F.row_number().over(best)).withColumn("first_seq", F.min("seq").over(same)).where("rank = 1")
    order = Window.partitionBy("doc", "page").orderBy("top", "first_seq")
    return kept.withColumn("top", box_top(F.col("box"))).withColumn("seq", F.row_number().over(order)).drop("key", "rank", "first_seq", "top")


def union_engines(*recognised: DataFrame | None) -> DataFrame:
    """Lines of several recognisers as one sequence a page: the first one's lines first. None is no lines."""
    return numbered(ranked(*recognised))


def merge_engines(*recognised: DataFrame | None) -> DataFrame:
    """The best lines (see best_lines) of several recognisers."""
    return best_lines(union_engines(*recognised))


def page_texts(lines: DataFrame) -> DataFrame:
    """doc, page, text: the lines that are not blank, unstripped, joined by newlines; '' for pages of blank lines."""
    shown = F.when(strip(F.col("text")) != "", F.struct("seq", "text"))
    return lines.groupBy("doc", "page").agg(F.array_join(F.array_sort(F.collect_list(shown))["text"], "\n").alias("text"))


def document_texts(pages: DataFrame) -> DataFrame:
    """doc, text: pages under their headings. Empty pages keep theirs."""
    part = F.concat(F.lit("--- Page "), F.col("page").cast("string"), F.lit(" ---\n"), F.col("text"))
    texts = F.array_sort(F.collect_list(F.struct("page", part.alias("part"))))
    return pages.groupBy("doc").agg(F.array_join(texts["part"], "\n\n").alias("text"))


def documents(lines: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """doc, text, pages: each page with its text and its lines, in order.

    The pages' image paths are in image_path of the lines, or in paths (doc, page, image_path), or null.
    """
    line = F.struct("text", "confidence", "box", "engine", "page")
    shown = F.when(strip(F.col("text")) != "", F.struct("seq", "text"))
    pages = lines.groupBy("doc", "page").agg(
        F.array_join(F.array_sort(F.collect_list(shown))["text"], "\n").alias("text"),
        F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line"))), lambda a, b: F.when(a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1).otherwise(0)), lambda x: x["line"]).alias("lines"),
        F.max("image_path" if "image_path" in lines.columns else F.lit(None).cast("string")).alias("image_path"),
    )
    pages = pages.drop("image_path").join(paths, ["doc", "page"], "left") if paths is not None else pages
    page = F.struct("page", "text", "lines", "image_path")
    by_page = lambda a, b: F.when(a["page"] < b["page"], -1).when(a["page"] > b["page"], 1).otherwise(0)
    whole = pages.groupBy("doc").agg(F.array_sort(F.collect_list(page), by_page).alias("pages"))
    heading = F.transform("pages", lambda p: F.concat(F.lit("--- Page "), p["page"].cast("string"), F.lit(" ---\n"), p["text"]))
    return whole.select("doc", F.array_join(heading, "\n\n").alias("text"), "pages")


def split_pages(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a row for each page of a text with page headings: page_index from 1, page as printed, body.

    Without a heading the whole text is page 1. What stands before the first heading is left out.
    """
    numbers = F.regexp_extract_all(F.col(text), F.lit(MARKER), F.lit(1))
    bodies = F.split(text, MARKER, -1)
    none = F.size(numbers) == 0
    numbers, bodies = F.when(none, F.array(F.lit("1"))).otherwise(numbers), F.when(none, F.array(F.col(text))).otherwise(F.slice(bodies, 2, F.greatest(F.size(bodies) - 1, F.lit(0))))
    pages = F.arrays_zip(numbers.alias("n"), bodies.alias("b"))
    rows = docs.select("*", F.posexplode(pages).alias("__i", "__page"))
    return rows.withColumns({"page_index": F.col("__i") + 1, "page": whole_number(F.col("__page.n")), "body": F.col("__page.b")}).drop("__i", "__page")


def without_markers(text: Column) -> Column:
    """A document's text without the headings of its pages."""
    return F.regexp_replace(text, MARKER + r"\n?", "")

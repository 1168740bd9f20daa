"""Whole workflows: recognise, evaluate, extract a curriculum."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.fields import fields_json, with_fields
from pagewright.functions.metrics import evaluation
from pagewright.functions.text import file_name
from pagewright.operators import courses, joins, lines
from pagewright.operators.recognise import Settings, chosen_lines, page_rows
from pagewright.sources import readers, writers


def recognised_documents(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """source_path, engine, text, pages of every document of pages (doc, page, image_path, content), each page seen once."""
    return _documents(page_rows(pages, settings), settings)


def _documents(rows: DataFrame, settings: Settings) -> DataFrame:
    whole = lines.documents(chosen_lines(rows, settings))
    full = F.transform("pages", lambda p: p.withField("lines", F.filter(p["lines"], lambda x: x["engine"].isNotNull())))
    return whole.select(F.col("doc").alias("source_path"), F.lit(settings.engine).alias("engine"), "text", full.alias("pages"))


def run_recognition(spark: SparkSession, path: str, folder: str, settings: Settings = Settings(), renderer=None, text_files: bool = False) -> DataFrame:
    """Recognises the documents at a path, writes them and their fields under folder, and returns them.

    text_files: a plain text file for each document too. With debug images, what a page gave
    is written once as a table, debug-rows, of which documents and images are made.
    """
    debug = settings.preprocess and settings.save_debug_images
    rows = page_rows(readers.document_pages(spark, path, renderer, settings.dpi), settings, images=debug)
    if debug:
        rows.write.mode("overwrite").parquet(f"{folder}/debug-rows")
        rows = spark.read.schema(rows.schema).parquet(f"{folder}/debug-rows")
        writers.save_images(rows.where("image is not null"), folder)
    writers.save_documents(_documents(rows, settings), folder)
    written = readers.recognised_json(spark, f"{folder}/json")
    if text_files:
        writers.save_text_files(written, folder)
    written.select(fields_json(F.col("text")).alias("value")).write.mode("overwrite").text(f"{folder}/fields")
    return with_fields(written)


def evaluate(predictions: DataFrame, truth: DataFrame, strict: bool = True, tokenizer: str = "compat", strip_page_markers: bool = False) -> DataFrame:
    """One result for each prediction (source_path, text) against truth (key, reference).

    The headings of pages that documents carry count as text, unless they are stripped.
    """
    both = readers.spread(joins.with_ground_truth(predictions, truth, strict=strict))
    if strip_page_markers:
        both = both.withColumn("text", lines.without_markers(F.col("text")))
    return both.select(*evaluation(file_name(F.col("source_path")), F.col("reference"), F.col("text"), tokenizer))


def evaluate_files(spark: SparkSession, truth_path: str, prediction_path: str, strip_page_markers: bool = False) -> DataFrame:
    return evaluate(readers.recognised_json(spark, prediction_path), readers.ground_truth(spark, truth_path), strip_page_markers=strip_page_markers)


def extract_curriculum(found: DataFrame, program: str = "DSBA", plan: str = "no_coop", repair_footers: bool = False) -> DataFrame:
    """One row for each document of lines (doc, page_index, seq, text, box): its source, program, plan and courses."""
    placed = courses.placed(found.drop("page").withColumnRenamed("page_index", "page"))
    return courses.curriculum(courses.full_courses(placed, repair_footers=repair_footers), program, plan)


def extract_curriculum_from_file(spark: SparkSession, path: str, program: str = "DSBA", plan: str = "no_coop") -> DataFrame:
    return extract_curriculum(readers.read_lines(spark, path), program, plan)

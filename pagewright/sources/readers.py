"""Reading documents: page images, PDFs, recogniser output as JSON or text, ground truth and rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright import schemas
from pagewright.functions.text import file_stem, file_suffix, is_image, is_pdf, split_lines, strip
from pagewright.operators.lines import split_pages

PAGES = "doc string, page int, image_path string, content binary"


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as the session has cores, where its scan gives fewer: for rows that cost much more to work on than to move."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def document_pages(spark: SparkSession, path: str, renderer: Callable[[bytes, int], Iterator[bytes]] | None = None, dpi: int = 300) -> DataFrame:
    """doc, page, image_path, content of every page of the images and PDFs at a path or pattern.

    An image is its own page 1 under its own path. A PDF's pages are rendered by
    renderer(content, dpi), one JPEG after another, and named stem_page_001.jpg and so on.
    Files of another kind are an error that names their suffix.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    kind = F.when(is_pdf(F.col("path")), "pdf").when(is_image(F.col("path")), "image").otherwise(F.raise_error(F.concat(F.lit("Unsupported input type: "), F.lower(file_suffix(F.col("path"))))))
    rows = files.withColumn("kind", kind).withColumn("stem", file_stem(F.col("path")))

    def pages(batches):
        import pandas as pd

        one = lambda *page: pd.DataFrame([page], columns=["doc", "page", "image_path", "content"])
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.kind == "image":
                    yield one(row.path, 1, row.path, row.content)
                    continue
                if renderer is None:
                    raise RuntimeError("pages of a PDF need a renderer")
                for n, image in enumerate(renderer(row.content, dpi), 1):
                    yield one(row.path, n, f"{row.stem}_page_{n:03d}.jpg", image)

    return rows.mapInPandas(pages, PAGES)


def decoded_images(spark: SparkSession, path: str, invalid: str = "raise") -> DataFrame:
    """Spark's image source (origin, height, width, nChannels, mode, data: BGR bytes). invalid: raise or drop."""
    images = spark.read.format("image").option("dropInvalid", invalid == "drop").load(path).select("image.*")
    if invalid == "drop":
        return images
    sound = F.when(F.col("width") > 0, F.col("origin")).otherwise(F.raise_error(F.concat(F.lit("Cannot read image: "), F.col("origin"))).cast("string"))
    return images.withColumn("origin", sound)


def recognised_json(spark: SparkSession, path: str) -> DataFrame:
    """One row for each JSON document: a file with one document at a path that ends in .json, else a document a line. Keys that are missing are null."""
    return spark.read.schema(schemas.DOCUMENT).option("multiLine", path.lower().endswith(".json")).json(path)


def loose_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """As json_lines of one JSON document, with texts as a loose reader takes them: null is "None", a missing text is empty."""
    line = "map<string,string>"
    whole = spark.read.text(path, wholetext=True)
    docs = whole.select(F.from_json("value", f"source_path string, pages array<struct<page:int,lines:array<{line}>>>").alias("d")).select(F.coalesce("d.source_path", F.lit(path)).alias("doc"), "d.pages")
    pages = docs.select("doc", F.posexplode("pages").alias("__i", "p"))
    lines = pages.select("doc", F.col("p.page").alias("page"), (F.col("__i") + 1).alias("page_index"), F.posexplode("p.lines").alias("__j", "line"))
    given = F.when(F.map_contains_key("line", "text"), F.coalesce(F.try_element_at("line", F.lit("text")), F.lit("None"))).otherwise("")
    part = lambda name: F.try_element_at("line", F.lit(name))
    box = F.from_json(part("box"), "array<array<double>>")
    return lines.select("doc", "page", "page_index", (F.col("__j") + 1).alias("seq"), given.alias("text"), part("confidence").try_cast("double").alias("confidence"), box.alias("box"), part("engine").alias("engine"))


def json_lines(docs: DataFrame) -> DataFrame:
    """Lines (doc, page, page_index, seq, text, confidence, box, engine) of recognised_json."""
    pages = docs.select(F.col("source_path").alias("doc"), F.posexplode("pages").alias("__i", "p"))
    lines = pages.select("doc", F.col("p.page").alias("page"), (F.col("__i") + 1).alias("page_index"), F.posexplode("p.lines").alias("__j", "line"))
    return lines.select("doc", "page", "page_index", (F.col("__j") + 1).alias("seq"), "line.text", "line.confidence", "line.box", "line.engine")


def text_lines(docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """Lines (doc, page, page_index, seq, text, confidence, box, engine) of plain texts with page headings.

    Lines are stripped, blank ones left out; a line's box is at x 0 and y its number from 0
    on the page, blank lines counted.
    """
    folded = F.regexp_replace(F.col(text), r"\r\n?", "\n")
    pages = split_pages(docs.select(F.col(doc).alias("doc"), folded.alias("text")))
    lines = pages.select("doc", "page", "page_index", F.posexplode(split_lines(F.col("body"))).alias("__y", "line"))
    at = F.array(F.lit(0.0), F.col("__y").cast("double"))
    return lines.select("doc", "page", "page_index", (F.col("__y") + 1).alias("seq"), strip(F.col("line")).alias("text"), F.lit(None).cast("double").alias("confidence"), F.array(at, at).alias("box"), F.lit("text").alias("engine")).where("text <> ''")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of one path: JSON by its suffix in any case, else text."""
    if path.lower().endswith(".json"):
        return loose_json_lines(spark, path)
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc"), F.col("value").alias("text"))
    return text_lines(whole)


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """at, key, reference of a JSON object of texts, at being the place of a pair in it."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.from_json("value", schemas.GROUND_TRUTH)).alias("at", "key", "reference"))


def rules(spark: SparkSession, path: str) -> DataFrame:
    return flat_rules(spark.read.schema(schemas.RULES).option("multiLine", True).json(path))


def flat_rules(nested: DataFrame) -> DataFrame:
    """program, category, present, label, value, summary: a row for each value, one without where there is none."""
    each = nested.select(F.explode("programs").alias("program", "rules")).select("program", F.explode("rules").alias("r"))
    return each.select("program", "r.category", "r.present", F.explode_outer("r.values").alias("v"), "r.summary").select("program", "category", "present", "v.label", "v.value", "summary")

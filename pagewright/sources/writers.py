"""Writing results as JSON and text, in folders that Spark makes; earlier content is replaced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import file_stem

#: Folders among which documents are dealt by a hash of their path.
BUCKETS = 64

#: Keys without a value are written as null.
KEEP_NULLS = {"ignoreNullFields": "false", "pretty": "true"}


def as_json(value: Column, keep_nulls: bool = True) -> Column:
    """Pretty JSON; characters beyond ASCII stay as they are."""
    return F.to_json(value, KEEP_NULLS if keep_nulls else {"pretty": "true"})


def save_json(df: DataFrame, path: str, keep_nulls: bool = True) -> None:
    """One JSON object for each row."""
    df.select(as_json(F.struct(*df.columns), keep_nulls).alias("value")).write.mode("overwrite").text(path)


def document_name(path: Column) -> Column:
    """The stem of a document's path and a hash of all of it, for stems may repeat."""
    return F.concat(file_stem(path), F.lit("-"), F.substring(F.md5(path.cast("binary")), 1, 8))


def save_documents(docs: DataFrame, folder: str) -> None:
    """source_path, engine, text, pages under json: one line for each document, dealt by a hash of the full path."""
    bucket = F.pmod(F.xxhash64("source_path"), F.lit(BUCKETS)).cast("int")
    whole = F.to_json(F.struct("source_path", "engine", "text", "pages"), {"ignoreNullFields": "false"})
    docs.select(bucket.alias("bucket"), whole.alias("value")).write.mode("overwrite").partitionBy("bucket").text(f"{folder}/json")


def _put(rows, folder: str, path: str, content: str) -> None:
    """Writes each row's content to its path under a folder all executors share."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    for row in rows:
        name = f"{root}/{row[path]}"
        store.create_dir(name.rpartition("/")[0], recursive=True)
        with store.open_output_stream(name) as out:
            out.write(bytes(row[content]))


def save_text_files(docs: DataFrame, folder: str, text: str = "text") -> None:
    """text/<stem>-<hash>_ocr.txt for each document, for reading by eye; large corpora do with save_documents."""
    named = docs.select(F.concat(F.lit("text/"), document_name(F.col("source_path")), F.lit("_ocr.txt")).alias("path"), F.coalesce(text, F.lit("")).cast("binary").alias("content"))
    named.foreachPartition(lambda rows: _put(rows, folder, "path", "content"))


def save_images(pages: DataFrame, folder: str, content: str = "image") -> None:
    """Debug images page_001_preprocessed.png of rows (doc, page, image as PNG bytes), in a folder all executors share.

    Each document has a folder under debug: its stem and a hash of its path, for stems may repeat.
    """

    page = F.concat(F.lit("/page_"), F.lpad(F.col("page").cast("string"), 3, "0"), F.lit("_preprocessed.png"))
    pages.select(F.concat(F.lit("debug/"), document_name(F.col("doc")), page).alias("path"), F.col(content).alias("content")).foreachPartition(lambda rows: _put(rows, folder, "path", "content"))

"""Fields of documents as they arrive. The operators are stateless, so a stream runs the batch plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from pagewright.functions.fields import with_fields


def field_stream(spark: SparkSession, folder: str, schema: StructType, text: str = "text") -> DataFrame:
    """A stream of the Parquet files that come into a folder, with their fields."""
    return with_fields(spark.readStream.schema(schema).parquet(folder), text)

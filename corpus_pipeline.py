"""A corpus pipeline: toxicity, near-duplicates, secrets, mixing, encoding, over `documents`.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns what it
keeps of docs. All but the last return the columns of documents. Each is written as
Parquet and read again as the docs of the next; ORACLE_SQL is None, for the models of
the first stage and the tokenizer of the last have no SQL.

Nulls in any column, empty texts, repeated rows and empty tables pass every stage: an
empty text is not toxic, has no twin, holds no secret, costs the mix nothing, and encodes
to no tokens. Rows without an id, or that share one, are told apart by their texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import bpe, mixing, neardup, secrets, toxicity
from pagewright.llm.shared import marked, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Score from which a document is toxic, as in the operator's query.
TOXIC = 0.7

#: Near-duplicates share 80 of 100 shingles of five words.
WORDS, PER = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below TOXIC. The model learns from the labels of these documents."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs.select(*COLUMNS), model)
    return scored.where(F.col("score") < TOXIC).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group, that of the least doc_id (no id: last); documents without words all stay.

    Rows that repeat an id with another text are decided each by its own text; of rows alike
    in id and text one stays, the least by its other columns.
    """
    digest = F.xxhash64(F.col("text"))
    found = neardup.near_duplicates(docs.select("doc_id", "text", digest.alias("digest")), WORDS, PER, also=("digest",))
    rows = found.where("group_key is not null").groupBy("group_key", F.col("doc_id").alias("d"), F.col("digest").alias("t")).agg(F.count("*").alias("times"))
    rows = written(rows, "rows")
    stays = F.min(F.struct(F.col("d").isNull(), "d", "t"))
    stays = written(rows.groupBy(F.col("group_key").alias("g")).agg(stays.alias("stays")).select("g", F.col("stays.t").alias("kept_t"), F.col("stays.d").alias("kept_d")), "stays")
    judged = rows.join(stays, F.col("group_key") == F.col("g")).withColumn("keep", F.col("d").eqNullSafe(F.col("kept_d")) & (F.col("t") == F.col("kept_t")))
    gone = written(judged.where("not keep or times > 1").select("d", "t", "keep"), "gone")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("d")) & (digest == F.col("t"))
    # most texts are not in question, and are not shuffled
    named = docs.select(*COLUMNS, F.xxhash64(F.col("doc_id").cast("long"), digest).alias("name"))
    both = marked(named, "name", gone.select(F.xxhash64("d", "t").alias("id")))
    asked = both.where("may").select(*COLUMNS)
    left = both.where("not may").select(*COLUMNS).unionByName(asked.join(gone, same, "left_anti"))
    twice = gone.where("keep")
    if twice.isEmpty():
        return left
    one = asked.join(twice, same).groupBy("d", "t").agg(F.min(F.struct(*COLUMNS)).alias("row"))
    return left.unionByName(one.select("row.*"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret and of each linked part; n_chars follows the text."""
    made = secrets.redact(docs.select(*COLUMNS, F.col("text").alias("before")))
    changed = ~F.col("text").eqNullSafe(F.col("before"))
    return made.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix takes them: a row for each copy."""
    return mixing.repeated(docs.select(*COLUMNS), mixing.allot(docs))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, n_tokens, ids_sha256, decoded_sha256 of each row."""
    import public_tokenizers

    made = bpe.encode(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded="decoded")
    return made.select(
        "doc_id", "source", "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        bpe.ids_digest(F.col("ids")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("encoding", encode_texts),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

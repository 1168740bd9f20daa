"""Registered queries of the operators and the pipeline: thin wrappers that give each contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import ann, bpe, collocations, contamination, lexical, mixing, neardup, quality, repeats, secrets, sql, tokencount, topk, toxicity
from pagewright.llm.shared import fresh_path, held_out
from pagewright.sources.readers import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table; over as many partitions as there are cores where a small file gives fewer."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes documents into flat token files, then counts tokens from those files alone."""
    end = 50256  # free in the vocabulary
    manifest = tokencount.write_flat(documents(spark, sf_dir), bpe.encoder(spark, *_vocabulary()), end, fresh_path(spark, "tokens"))
    counted = tokencount.token_counts(manifest.select("file", "bytes").distinct(), end)
    return manifest.join(counted, ["file", "ordinal"]).select("doc_id", "n_tokens", "start", "closed")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    made = bpe.encode(docs, *_vocabulary(), decoded="decoded")
    return made.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        bpe.ids_digest(F.col("ids")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _judged(made: DataFrame, line: float) -> DataFrame:
    return made.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= line).cast("int").alias("predicted"),
    )


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = repeats.without_repeats(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + (x["end"] - x["start"]))
    return made.select(
        "doc_id",
        (F.octet_length("kept") + removed).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = neardup.near_duplicates(documents(spark, sf_dir), words=4, per=80)
    return made.select("doc_id", "n_shingles", "component_id", "kept")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.concat("assign", "access", "hex")
    return found.select(
        "doc_id",
        F.size("assign").cast("long").alias("n_assign"),
        F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"),
        F.sha2(secrets.spelt(base), 256).alias("base_sha256"),
        secrets.spelt(F.concat(base, "linked")).alias("spans"),
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return _judged(toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))), 0.7)


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, 10)


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, 5)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return _judged(quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels"))), 0.5)


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build(documents(spark, sf_dir)), table(spark, sf_dir, "benchmark"), 50)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(spread(table(spark, sf_dir, "documents").select("lang", "text")))


def op13_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.scan(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        contamination.n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_token_counts": op1_token_counts,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_repeats": op3_repeats,
    "op4_mixing": op4_mixing,
    "op5_neardup": op5_neardup,
    "op6_secrets": op6_secrets,
    "op7_toxicity": op7_toxicity,
    "op8_topk": op8_topk,
    "op9_ann": op9_ann,
    "op10_quality": op10_quality,
    "op11_lexical": op11_lexical,
    "op12_collocations": op12_collocations,
    "op13_contamination": op13_contamination,
}

ORACLE_SQL: dict[str, str] = {
    "op3_repeats": sql.REPEATS,
    "op4_mixing": sql.MIXING,
    "op5_neardup": sql.NEAR_DUPLICATES,
    "op6_secrets": sql.SECRETS,
    "op8_topk": sql.TOPK,
    "op11_lexical": sql.LEXICAL,
    "op12_collocations": sql.COLLOCATIONS,
    "op13_contamination": sql.CONTAMINATION,
}

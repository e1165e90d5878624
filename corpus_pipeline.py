"""A corpus pipeline of five operators: language ID, near-dedup, secrets, mixture, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.llm import common, languages, mixing, pieces, secrets, shingles
from docweave.llm.queries import PIECES

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Below this cosine with every language's prototype a text of SHORT characters or more is in none of them: above what
#: random letters (0.15 at most) and other scripts (0.10) reach, below what clean texts have (0.23 and up).
LEAST_FIT, SHORT = 0.16, 100
#: Shorter texts, clean ones too, may reach less; what is under the noise of 1024 dimensions (1 / sqrt(1024)) goes.
LEAST_SHORT_FIT = 0.03


def keyed(docs: DataFrame) -> DataFrame:
    """docs with row_key: what tells rows apart, should ids repeat or be null. Rows of one key are alike in every column."""
    is_null = F.col("doc_id").isNull()
    return docs.select(*COLUMNS, F.struct(F.coalesce("doc_id", F.lit(-1)).alias("id"), is_null.alias("no_id"), F.xxhash64(*COLUMNS).alias("h")).alias("row_key"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that read as one of the learned languages; a missing lang is filled in."""
    learnt = languages.train(docs.where(~languages.held_out()))
    found = languages.predict(docs.select(*COLUMNS), learnt, list(COLUMNS))
    least = F.when(F.length("text") >= SHORT, F.lit(LEAST_FIT)).otherwise(F.lit(LEAST_SHORT_FIT))
    kept = found.where((F.col("lang_pred") != "und") & (F.col("fit") >= least))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word similarity of 0.8 or more): the one of the smallest id."""
    rows = keyed(docs)
    groups = shingles.near_copies(rows)
    first = groups.select(F.col("component_id").alias("stays")).distinct()
    one = Window.partitionBy("row_key").orderBy(F.lit(0))
    kept = rows.join(first, F.col("row_key") == F.col("stays")).withColumn("nth", F.row_number().over(one))
    return kept.where("nth = 1").select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, their secrets replaced by <KIND>."""
    clean = secrets.redact(docs.select(*COLUMNS), secrets.train(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (0 to 2 times)."""
    rows = keyed(docs)
    mixed = mixing.mix(rows, id_col="row_key").groupBy(F.col("doc_id").alias("mixed_key")).agg(F.sum("copies").alias("copies")).where("copies > 0")
    one = Window.partitionBy("row_key").orderBy(F.lit(0))
    joined = rows.join(mixed, F.col("row_key") == F.col("mixed_key")).withColumn("nth", F.row_number().over(one)).where("nth = 1")
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's ids, with the digests of op4."""
    encoded = pieces.encode(docs, PIECES)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("mixture", mixture), ("token_ids", token_ids)]

#: Prototypes, shingle groups, Markov models, flights and merges aren't SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.written(docs, name)
    return docs

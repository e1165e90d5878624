"""The tables that queries run on, derived from `documents` and others by arithmetic alone, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunks as C
from ..functions import text as X


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_key(df: DataFrame, key: str) -> DataFrame:
    """df dealt by a key to as many partitions as a shuffle has, few bytes or not: more is made of its rows."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    year = (F.lit(2010) + F.col("doc_id") % 16).cast("int")
    word = lambda a: F.concat_ws(" ", F.slice(X.words(F.col("text"), 6), a, 3))
    three = C.three_chunks(F.col("text"))
    return (
        d.withColumn("year", year)
        .withColumn("c3", three)
        .select(
            F.concat(F.lit("ESCR"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), "year").alias("cnr"),
            F.concat("year", F.lit("INSC"), (F.col("doc_id") + 1).cast("string")).alias("case_number"),
            F.concat("year", F.lit(" INSC "), (F.col("doc_id") + 1).cast("string")).alias("nc_display"),
            F.concat(F.lit("Court "), "source").alias("court_name"),
            "year",
            word(1).alias("petitioner"),
            word(4).alias("respondent"),
            F.date_format(F.date_add(F.lit("2010-01-01").cast("date"), (F.col("doc_id") * 37 % 5800).cast("int")), "dd-MM-yyyy").alias("decision_date"),
            F.substring("text", 1, 1500).alias("extracted_text_snippet"),
            F.col("c3.opening").alias("chunk_opening"),
            F.col("c3.body").alias("chunk_body"),
            F.col("c3.holding").alias("chunk_holding"),
            F.col("c3.fallback").alias("chunk_fallback"),
            F.col("c3.full_text_len").alias("full_text_len"),
            "doc_id",
            F.col("doc_id").alias("ordinal"),
        )
    )


#: The same up to the chunks, for DuckDB.
CASES = r"""cases AS (
    SELECT doc_id, 'ESCR' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || (2010 + doc_id % 16) AS cnr,
           (2010 + doc_id % 16) || 'INSC' || (doc_id + 1) AS case_number, (2010 + doc_id % 16) || ' INSC ' || (doc_id + 1) AS nc_display,
           'Court ' || source AS court_name, CAST(2010 + doc_id % 16 AS INT) AS year, lang, source, text,
           array_to_string(list_filter(regexp_split_to_array(text, '[ \n\t\r]+'), lambda x: x <> '')[1:3], ' ') AS petitioner,
           array_to_string(list_filter(regexp_split_to_array(text, '[ \n\t\r]+'), lambda x: x <> '')[4:6], ' ') AS respondent,
           strftime(DATE '2010-01-01' + CAST(doc_id * 37 % 5800 AS INT), '%d-%m-%Y') AS decision_date, substr(text, 1, 1500) AS extracted_text_snippet
    FROM documents)"""


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three queries for every case: as it is, with noise, and by its paraphrased text alone."""
    c = cases(spark, sf_dir)
    v = F.explode(F.array(*(F.struct(F.lit(a).alias("variant_type"), F.lit(b).alias("expected_tier")) for a, b in (("clean", "exact"), ("noisy", "fuzzy"), ("paraphrased", "semantic")))))
    kind = F.col("v.variant_type")
    noisy = kind == "noisy"
    only = lambda clean, other: F.when(kind == "clean", clean).when(noisy, other).otherwise(F.lit(""))
    return c.select("*", v.alias("v")).select(
        F.concat("cnr", F.lit("-"), kind).alias("query_id"),
        F.col("cnr").alias("original_case_id"),
        kind.alias("variant_type"),
        F.col("v.expected_tier").alias("expected_tier"),
        only(F.col("cnr"), F.lit("")).alias("cnr"),
        only(F.col("case_number"), F.lit("")).alias("case_number"),
        only(F.col("nc_display"), F.lit("")).alias("nc_display"),
        only(F.col("court_name"), F.lit("")).alias("court_name"),
        F.when(kind != "paraphrased", F.col("year")).alias("year"),
        only(F.col("petitioner"), F.lower(F.concat(F.lit("dr. "), "petitioner", F.lit(" & ors. (dead) through lrs.")))).alias("petitioner"),
        only(F.col("respondent"), F.lower(F.concat(F.lit("shri "), "respondent", F.lit(" and another")))).alias("respondent"),
        "decision_date",
        F.when(kind == "paraphrased", X.paraphrase(F.col("extracted_text_snippet"))).otherwise(F.col("extracted_text_snippet")).alias("extracted_text_snippet"),
        "doc_id",
    )


#: Words that weigh nothing in TF-IDF.
STOP = ("the", "of", "and", "to", "in", "is", "that", "for", "with", "de", "la", "le", "der", "die", "und", "el", "los", "que", "en", "on")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of answers of every tier, right and wrong and none, by arithmetic: what the measures are taken over."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(*map(F.lit, range(3)))).alias("v"))
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))
    kind, tier = ("clean", "noisy", "paraphrased"), ("exact", "fuzzy", "semantic")
    mixed = (F.col("doc_id") * 5 + F.col("v") * 11) % 29
    actual = F.when(mixed == 0, "none").when(mixed < 4, pick(tier, (F.col("v") + mixed) % 3)).otherwise(pick(tier, F.col("v")))
    out = d.select("doc_id", pick(kind, F.col("v")).alias("variant_type"), pick(tier, F.col("v")).alias("expected_tier"), actual.alias("actual_tier"), mixed.alias("m"))
    matched = F.col("actual_tier") != "none"
    return out.select("doc_id", "variant_type", "expected_tier", "actual_tier", matched.alias("matched"), (matched & (F.col("m") % 7 != 3)).alias("correct"))


ANSWERS = """answers AS (
    SELECT *, actual_tier <> 'none' AS matched, actual_tier <> 'none' AND m % 7 <> 3 AS correct
    FROM (SELECT *, ['exact', 'fuzzy', 'semantic'][v + 1] AS expected_tier, ['clean', 'noisy', 'paraphrased'][v + 1] AS variant_type,
                 CASE WHEN m = 0 THEN 'none' WHEN m < 4 THEN ['exact', 'fuzzy', 'semantic'][(v + m) % 3 + 1] ELSE ['exact', 'fuzzy', 'semantic'][v + 1] END AS actual_tier
          FROM (SELECT doc_id, v, (doc_id * 5 + v * 11) % 29 AS m FROM documents, unnest([0, 1, 2]) AS t(v))))"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of every document, laid out twelve to a line and 200 to a page. Pages are dealt out before their words are made rows, so what groups by page needn't shuffle those."""
    d = table(spark, sf_dir, "documents").select("doc_id", X.words(F.col("text")).alias("words")).where(F.size("words") > 0)
    d = d.select("doc_id", "words", F.explode(F.sequence(F.lit(0), F.floor((F.size("words") - 1) / 200).cast("int"))).alias("n"))
    d = d.select((F.col("doc_id") * 100_000 + F.col("n")).alias("page"), F.slice("words", F.col("n") * 200 + 1, 200).alias("words"))
    d = by_key(d, "page").select("page", F.posexplode("words").alias("seq", "text"))
    line, at = F.floor(F.col("seq") / 12).cast("int"), F.col("seq") % 12
    return d.select("page", "seq", "text", line.alias("line"), (F.lit(60.0) * at).alias("x0"), (60.0 * at + 10.0 * F.length("text")).alias("x1"), (40.0 * line).alias("y0"), (40.0 * line + 20).alias("y1"), (0.6 + (F.col("page") + F.col("seq")) % 40 / 100.0).alias("score"))


TOKENS = r"""tokens AS (
    SELECT page, seq, text, CAST(seq // 12 AS INT) AS line, 60.0 * (seq % 12) AS x0, 60.0 * (seq % 12) + 10.0 * length(text) AS x1,
           40.0 * (seq // 12) AS y0, 40.0 * (seq // 12) + 20 AS y1, 0.6 + (page + seq) % 40 / 100.0 AS score
    FROM (SELECT doc_id * 100000 + (i - 1) // 200 AS page, (i - 1) % 200 AS seq, words[i] AS text
          FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \n\t\r]+'), lambda x: x <> '') AS words FROM documents), unnest(range(1, len(words) + 1)) AS t(i)))"""


def arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of three routers on every document: right or wrong, filed or not, by arithmetic."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("arm"))
    stage = F.when(F.col("doc_id") % 5 < 2, "easy").when(F.col("doc_id") % 5 < 4, "medium").otherwise("hard")
    right = (F.col("doc_id") * 7 + F.col("arm") * 3) % 23 > 1
    return d.select("doc_id", "arm", stage.alias("stage"), F.col("doc_id").alias("expected"), F.when(right, F.col("doc_id")).otherwise(F.col("doc_id") + 1).alias("actual"), right.alias("correct"), F.when((F.col("doc_id") + F.col("arm")) % 11 == 0, "needs_review").otherwise("filed").alias("status"), ((F.col("doc_id") * 13 + F.col("arm")) % 997).cast("double").alias("route_ms"), ((F.col("doc_id") * 31 % 400 + 600) / 1000.0).alias("confidence"))


ARMS = r"""arms AS (
    SELECT doc_id, arm, CASE WHEN doc_id % 5 < 2 THEN 'easy' WHEN doc_id % 5 < 4 THEN 'medium' ELSE 'hard' END AS stage, doc_id AS expected,
           CASE WHEN (doc_id * 7 + arm * 3) % 23 > 1 THEN doc_id ELSE doc_id + 1 END AS actual, (doc_id * 7 + arm * 3) % 23 > 1 AS correct,
           CASE WHEN (doc_id + arm) % 11 = 0 THEN 'needs_review' ELSE 'filed' END AS status, CAST((doc_id * 13 + arm) % 997 AS DOUBLE) AS route_ms,
           (doc_id * 31 % 400 + 600) / 1000.0 AS confidence
    FROM documents, unnest([1, 2, 3]) AS t(arm))"""

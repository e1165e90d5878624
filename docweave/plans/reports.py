"""Queries over intake fields, result files and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import evaluate as E
from ..sources import tables as R
from .catalogue import query
from .fixtures import ARMS, CASES, arms, cases, table

c = F.col

# --- intake
_kinds = lambda: F.when(c("doc_id") % 4 == 0, F.concat(F.lit("see "), "nc_display", F.lit(" ("), F.lower("cnr"), F.lit(")"))).when(c("doc_id") % 4 == 1, F.concat(F.lit("reported as ["), c("year").cast("string"), F.lit("] 3 SCR "), c("doc_id").cast("string"))).when(c("doc_id") % 4 == 2, F.concat(F.lit("no. "), "cnr")).otherwise(F.lit("plain"))


@query(
    "ingest_fields",
    f"""WITH {CASES} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN cnr ELSE '' END AS cnr,
    CASE doc_id % 4 WHEN 0 THEN nc_display WHEN 1 THEN '[' || year || '] 3 SCR ' || doc_id WHEN 2 THEN cnr ELSE 'file' || doc_id END AS display,
    CASE doc_id % 4 WHEN 0 THEN case_number WHEN 1 THEN year || '_SCR_3_' || doc_id WHEN 2 THEN cnr ELSE 'file' || doc_id END AS case_id FROM cases""",
)
def ingest_fields(s: SparkSession, d: str) -> DataFrame:
    return cases(s, d).select("doc_id", X.ingest_fields(_kinds(), F.concat(F.lit("file"), "doc_id")).alias("f")).select("doc_id", "f.*")


@query(
    "title_parties",
    f"""WITH {CASES} SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'HEAD' ELSE 'Left ' || doc_id || CASE doc_id % 3 WHEN 0 THEN ' V. ' ELSE ' versus ' END || 'Right' END AS title,
    CASE WHEN doc_id % 3 < 2 THEN 'Left ' || doc_id END AS petitioner, CASE WHEN doc_id % 3 < 2 THEN 'Right' END AS respondent FROM cases""",
)
def title_parties(s: SparkSession, d: str) -> DataFrame:
    return (
        cases(s, d)
        .select(
            "doc_id",
            X.title_parties(F.concat(F.lit("\n HEAD\n\nLeft "), "doc_id", F.when(c("doc_id") % 3 == 0, " V. ").when(c("doc_id") % 3 == 1, " versus ").otherwise(" and "), F.lit("Right\nbody"))).alias("t"),
        )
        .select("doc_id", "t.*")
    )


@query(
    "noised_cnr",
    f"""WITH {CASES} SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'ESCR-' || regexp_replace(substr(cnr, 5), '0', 'O') WHEN 1 THEN lower(cnr) ELSE substr(cnr, 1, 10) || 'XX' || substr(cnr, 13) END AS noised,
    'ESCR-' || translate(substr(cnr, 5), '015', 'OIS') AS scanned FROM cases""",
)
def noised_cnr(s: SparkSession, d: str) -> DataFrame:
    return cases(s, d).select("doc_id", X.noised_cnr(c("cnr"), c("doc_id") % 3).alias("noised"), X.ocr_noised_cnr(c("cnr")).alias("scanned"))


@query(
    "text_minimums",
    """SELECT source, count(*) FILTER (n < 50) AS too_short, count(*) FILTER (n < 100) AS scanned
        FROM (SELECT source, length(text) AS n
        FROM documents)
        GROUP BY source""",
)
def text_minimums(s: SparkSession, d: str) -> DataFrame:
    return (
        table(s, d, "documents")
        .groupBy("source")
        .agg(E.count_where(F.length("text") < 50).alias("too_short"), E.count_where(F.length("text") < 100).alias("scanned"))
    )


# --- files


@query(
    "corpus_names",
    f"""WITH {CASES} SELECT doc_id, CAST(doc_id AS INT) AS number, CASE doc_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS stage, cnr
        FROM cases
        WHERE doc_id % 7 > 0""",
)
def corpus_names(s: SparkSession, d: str) -> DataFrame:
    return (
        cases(s, d)
        .select(
            "doc_id",
            X.corpus_name(F.concat(F.when(c("doc_id") % 7 == 0, "log").otherwise("doc"), F.lit("_"), "doc_id", F.lit("_"), F.element_at(F.array(F.lit("easy"), F.lit("medium"), F.lit("hard")), (c("doc_id") % 3 + 1).cast("int")), F.lit("_"), "cnr", F.lit(".md"))).alias("n"),
        )
        .where("n IS NOT NULL")
        .select("doc_id", "n.*")
    )


@query(
    "latest_results",
    """SELECT CAST(1 + doc_id % 3 AS INT) AS arm, max('arm' || (1 + doc_id % 3) || '_2024' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.json') AS name
        FROM documents GROUP BY 1""",
)
def latest_results(s: SparkSession, d: str) -> DataFrame:
    return (
        R.latest_results(table(s, d, "documents").select(F.concat(F.lit("arm"), (1 + c("doc_id") % 3).cast("string"), F.lit("_2024"), F.lpad(c("doc_id").cast("string"), 8, "0"), F.lit(".json")).alias("name")))
    )


@query(
    "page_tagged_text",
    """SELECT conv_id, string_agg('[Page ' || (turn + 1) || ']' || chr(10) || text || chr(10), '' ORDER BY turn, text) AS text, sum(length(trim(text))) >= 30 AS extractable
    FROM conversations WHERE trim(text) <> '' GROUP BY conv_id""",
)
def page_tagged_text(s: SparkSession, d: str) -> DataFrame:
    return R.page_tagged(table(s, d, "conversations").withColumn("page", c("turn") + 1), "conv_id", "page", "text")


@query("csv_round_trip", f"WITH {CASES} SELECT doc_id, cnr, petitioner || ', \"' || respondent || '\"' AS title FROM cases")
def csv_round_trip(s: SparkSession, d: str) -> DataFrame:
    return (
        cases(s, d)
        .select(F.to_csv(F.struct("doc_id", "cnr", F.concat("petitioner", F.lit(', "'), "respondent", F.lit('"')).alias("title")), {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}).alias("line"))
        .select(F.from_csv("line", "doc_id bigint, cnr string, title string", {"escape": '"'}).alias("r"))
        .select("r.*")
    )


# --- reports
_results = lambda s, d: arms(s, d).withColumn("matched", c("status") == "filed")


@query(
    "accuracy_by_category",
    f"""WITH {ARMS} SELECT stage, count(*) AS n, count(*) FILTER (correct) AS correct, count(*) FILTER (status <> 'filed') AS unmatched, round(count(*) FILTER (correct) * 100.0 / count(*), 1) AS accuracy
        FROM arms
        GROUP BY stage""",
)
def accuracy_by_category(s: SparkSession, d: str) -> DataFrame:
    return E.by_category(_results(s, d), "stage")


_n_pages = lambda: F.greatest(F.lit(1), F.ceil(F.length("text") / 400))
_SIZED = "sized AS (SELECT doc_id, greatest(1, CAST(ceil(length(text) / 400) AS BIGINT)) AS n FROM documents), held AS (SELECT *, CASE WHEN n <= 15 THEN '1-15' WHEN n <= 30 THEN '16-30' ELSE '>30' END AS bucket FROM sized)"


@query(
    "accuracy_by_pages",
    f"""WITH {ARMS}, {_SIZED} SELECT bucket, count(*) AS n, count(*) FILTER (correct) AS correct, count(*) FILTER (status <> 'filed') AS unmatched, round(count(*) FILTER (correct) * 100.0 / count(*), 1) AS accuracy
        FROM arms
        JOIN held USING (doc_id)
        WHERE arm = 1
        GROUP BY bucket""",
)
def accuracy_by_pages(s: SparkSession, d: str) -> DataFrame:
    return (
        E.by_category(
            _results(s, d).where("arm = 1").join(table(s, d, "documents").select("doc_id", E.page_bucket(_n_pages()).alias("bucket")), "doc_id"),
            "bucket",
        )
    )


@query(
    "page_count_spread",
    f"""WITH {_SIZED} SELECT min(n) AS least, max(n) AS most, median(n) AS mid, round(avg(n), 4) AS mean, count(*) FILTER (bucket = '1-15') AS short, count(*) FILTER (bucket = '16-30') AS middle, count(*) FILTER (bucket = '>30') AS long
        FROM held""",
)
def page_count_spread(s: SparkSession, d: str) -> DataFrame:
    return (
        table(s, d, "documents")
        .select(_n_pages().alias("n"))
        .withColumn("b", E.page_bucket(c("n")))
        .agg(
            F.min("n").alias("least"),
            F.max("n").alias("most"),
            F.median("n").alias("mid"),
            F.round(F.avg("n"), 4).alias("mean"),
            *(E.count_where(c("b") == b).alias(k) for k, b in (("short", "1-15"), ("middle", "16-30"), ("long", ">30"))),
        )
    )


@query(
    "run_summary",
    f"""WITH {ARMS}, r AS (SELECT stage, arm, avg(route_ms) AS ms, avg(CAST(correct AS INT)) AS acc
        FROM arms
        GROUP BY ALL) SELECT stage, round(median(ms), 4) AS median_ms, round(min(ms), 4) AS min_ms, round(max(ms), 4) AS max_ms, min(acc) = max(acc) AS same_accuracy
        FROM r
        GROUP BY stage""",
)
def run_summary(s: SparkSession, d: str) -> DataFrame:
    return E.run_summary(arms(s, d).withColumnRenamed("arm", "run"), "stage")


_OUT = "CASE WHEN {0}.status <> 'filed' THEN 'no_match' WHEN {0}.correct THEN 'correct' ELSE 'false_positive' END"


@query(
    "outcome_change",
    f"""WITH {ARMS} SELECT {_OUT.format('a')} AS before, {_OUT.format('b')} AS after, count(*) AS n
        FROM arms a
        JOIN arms b USING (doc_id)
        WHERE a.arm = 1 AND b.arm = 2
        GROUP BY ALL""",
)
def outcome_change(s: SparkSession, d: str) -> DataFrame:
    r = _results(s, d)
    return (
        r.where("arm = 1")
        .select("doc_id", E.outcome(c("matched"), c("correct")).alias("before"))
        .join(r.where("arm = 2").select("doc_id", E.outcome(c("matched"), c("correct")).alias("after")), "doc_id")
        .groupBy("before", "after")
        .agg(F.count("*").alias("n"))
    )


@query(
    "model_comparison",
    f"""WITH {ARMS} SELECT arm, round(count(*) FILTER (correct) * 100.0 / count(*), 2) AS accuracy, count(*) FILTER (correct) AS correct, count(*) FILTER (NOT correct AND status = 'filed') AS false_positive, count(*) FILTER (status <> 'filed') AS no_match, round(avg(route_ms), 4) AS mean_ms
        FROM arms
        GROUP BY arm""",
)
def model_comparison(s: SparkSession, d: str) -> DataFrame:
    return (
        _results(s, d)
        .groupBy("arm")
        .agg(
            F.round(E.count_where(c("correct")) * 100.0 / F.count("*"), 2).alias("accuracy"),
            E.count_where(c("correct")).alias("correct"),
            E.count_where(~c("correct") & c("matched")).alias("false_positive"),
            E.count_where(~c("matched")).alias("no_match"),
            F.round(F.avg("route_ms"), 4).alias("mean_ms"),
        )
    )


@query(
    "throughput_totals",
    """SELECT source, sum(n_chars) AS units, CASE WHEN sum(doc_id % 7) > 0 THEN round(sum(n_chars) / sum(doc_id % 7), 4) ELSE 0.0 END AS per_second, CAST(sum(doc_id % 7) // 60 AS BIGINT) || 'm ' || CAST(sum(doc_id % 7) % 60 AS BIGINT) || 's' AS took
        FROM documents
        GROUP BY source""",
)
def throughput_totals(s: SparkSession, d: str) -> DataFrame:
    return (
        table(s, d, "documents")
        .groupBy("source")
        .agg(F.sum("n_chars").alias("units"), F.sum(c("doc_id") % 7).alias("sec"))
        .select(
            "source",
            "units",
            F.when(c("sec") > 0, F.round(c("units") / c("sec"), 4)).otherwise(0.0).alias("per_second"),
            X.duration(c("sec")).alias("took"),
        )
    )


@query(
    "difficulty_shares",
    """WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY md5('20260816' || doc_id)) AS position, count(*) OVER () AS n
        FROM documents) SELECT doc_id, position, CASE WHEN position <= floor(n * 0.4) THEN 'easy' WHEN position <= floor(n * 0.8) THEN 'medium' ELSE 'hard' END AS share
        FROM p""",
)
def difficulty_shares(s: SparkSession, d: str) -> DataFrame:
    return (
        E.by_position(
            table(s, d, "documents").select("doc_id"),
            F.concat(F.lit("20260816"), c("doc_id").cast("string")),
            {"easy": 0.4, "medium": 0.4, "hard": 0.2},
        )
    )

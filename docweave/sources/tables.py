"""Reading and writing: yearly tables, bundles of documents, recognised lines, reports and logs."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

OCR_LINE = "array<struct<transcription:string,points:array<array<double>>,score:double>>"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def yearly(spark: SparkSession, root: str, first: int, last: int) -> DataFrame:
    """<root>/<year>/metadata.parquet of the years that are there, with `year` from the path."""
    found = [(y, p) for y in range(first, last + 1) if exists(spark, p := f"{root}/{y}/metadata.parquet")]
    if not found:
        raise FileNotFoundError(f"no metadata under {root} for {first} to {last}")
    out = None
    for y, p in found:
        own = spark.read.parquet(p).withColumn("year", F.lit(y))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def overwrite(df: DataFrame, path: str) -> None:
    """Replaces a table that df may itself read: written beside it first, then moved."""
    spark, aside = df.sparkSession, f"{path.rstrip('/')}.new"
    df.write.mode("overwrite").parquet(aside)
    old, new = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, aside))
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(old, True)
    fs.rename(new, old)


def append_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


def front_matter(cols: dict[str, Column]) -> Column:
    """YAML scalars in order, JSON-quoted; nulls are left out."""
    quoted = lambda c: F.regexp_replace(F.regexp_replace(c.cast("string"), r"([\\\"])", r"\\$1"), "\n", r"\\n")
    return F.concat_ws("\n", F.lit("---"), *(F.when(c.isNotNull(), F.concat(F.lit(f'{k}: "'), quoted(c), F.lit('"'))) for k, c in cols.items()), F.lit("---"))


def body(opening: Column, middle: Column, holding: Column, related: Column) -> Column:
    part = lambda name, c: F.when(X.text_or_empty(c) != "", F.concat(F.lit(f"# Chunk: {name}\n\n"), c, F.lit("\n")))
    links = F.transform(F.array_sort(related), lambda r: F.concat(F.lit("- ["), r, F.lit("](/matters/"), r, F.lit(".md)")))
    found = F.when(F.size(related) > 0, F.array_join(links, "\n")).otherwise("No related matters found.")
    return F.concat_ws("\n", part("Opening", opening), part("Body", middle), part("Holding", holding), F.concat(F.lit("# Related Matters\n\n"), found, F.lit("\n")))


def parse_field(doc: Column, name: str) -> Column:
    raw = F.regexp_extract(doc, rf'(?m)^{name}: "((?:[^"\\]|\\.)*)"$', 1)
    return F.nullif(F.regexp_replace(F.regexp_replace(raw, r"\\n", "\n"), r'\\([\\"])', "$1"), F.lit(""))


def parse_chunk(doc: Column, name: str) -> Column:
    return X.strip(F.regexp_extract(doc, rf"(?s)# Chunk: {name}\n(.*?)(?=\n# Chunk: |\n# Related Matters|$)", 1))


def recognised(lines: DataFrame, col: str = "value") -> DataFrame:
    """Tokens of lines `name <tab> JSON array`: name, seq, text, score, x0, y0, x1, y1; lines that aren't JSON give none, quads of under four points go."""
    parts = lines.select(F.get(F.split(col, "\t", 2), 0).alias("name"), F.from_json(F.get(F.split(col, "\t", 2), 1), OCR_LINE).alias("t"))
    each = parts.select("name", F.posexplode("t").alias("seq", "t")).where("size(t.points) >= 4")
    xs, ys = F.transform("t.points", lambda p: p[0]), F.transform("t.points", lambda p: p[1])
    return each.select("name", "seq", F.col("t.transcription").alias("text"), F.coalesce("t.score", F.lit(0.0)).alias("score"), F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def job_text(pages: DataFrame, job: str = "job") -> DataFrame:
    """A job's pages under their banners, in order; pages in error say so."""
    shown = F.when(F.col("error").isNotNull(), F.concat(F.lit("[ERROR: "), "error", F.lit("]"))).otherwise(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit("================ PAGE "), F.col("page"), F.lit(" ================"), F.when(F.col("status") == "needs_review", "  [NEEDS REVIEW]").otherwise(""))
    each = F.array_sort(F.collect_list(F.struct("page", F.concat(head, F.lit("\n"), shown).alias("s"))))
    return pages.groupBy(job).agg(F.array_join(F.transform(each, lambda p: p["s"]), "\n\n").alias("text"))


def job_json(pages: DataFrame, job: str = "job") -> DataFrame:
    each = F.array_sort(F.collect_list(F.struct("page", "status", "text")))
    return pages.groupBy(job).agg(F.to_json(F.struct(F.first(job).alias("job"), F.count("*").alias("n_pages"), each.alias("pages"))).alias("json"))


def serialised(pages: DataFrame) -> DataFrame:
    """pages(job, page, method, confidence, status, reviewed, error, text, raw_text, geometry_text) as the service shows them: confidence to two places and as a label, the page's text where it has no raw or geometry text."""
    own = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col("text"))
    cols = {"confidence": F.bround("confidence", 2), "confidence_display": X.confidence_label(F.col("confidence")), "raw_text": own("raw_text"), "geometry_text": own("geometry_text")}
    return pages.withColumns(cols)


def job_raw_json(pages: DataFrame, jobs: DataFrame, job: str = "job") -> DataFrame:
    """(job, json): jobs(job, filename, engine, seconds) with their pages(job, page, method, raw_text, geometry_text, text) in order; what is null is left out."""
    each = F.array_sort(F.collect_list(F.struct("page", "method", "raw_text", "geometry_text", F.col("text").alias("final_text"))))
    held = pages.groupBy(job).agg(each.alias("pages"))
    whole = F.to_json(F.struct(F.col(job).alias("job_id"), "filename", "engine", F.col("seconds").alias("processing_time_seconds"), F.coalesce("pages", F.array().cast(held.schema["pages"].dataType)).alias("pages")))
    return jobs.join(held, job, "left").select(job, whole.alias("json"))


def custom_cases(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected new cases: a title, and a record or case number, are needed; parties come from the title if not given."""
    ok = (X.text_or_empty(F.col("title")) != "") & ((X.text_or_empty(F.col("cnr")) != "") | (X.text_or_empty(F.col("case_number")) != ""))
    sides = F.split(F.upper("title"), r" V\. ")
    up = lambda c: F.upper(X.strip(X.text_or_empty(F.col(c))))
    named = X.text_or_empty(F.col("petitioner")) != ""
    out = rows.where(ok).withColumns({"petitioner": F.when(named, up("petitioner")).otherwise(F.get(sides, 0)), "respondent": F.when(named, up("respondent")).otherwise(F.coalesce(F.get(sides, 1), F.lit(""))), "cnr": up("cnr"), "case_number": up("case_number"), "title": up("title"), "year": F.coalesce("year", F.lit(2024)), "is_custom": F.lit(True)})
    return out, rows.where(~ok)


def append_custom(rows: DataFrame, path: str) -> tuple[int, int]:
    """Appends the accepted new cases to the table at `path`: (accepted, rejected). Rows aren't compared with what is there; with_custom() does that."""
    good, bad = custom_cases(rows)
    counts = good.count(), bad.count()
    if counts[0]:
        good.write.mode("append").parquet(path)
    return counts


def with_custom(pool: DataFrame, custom: DataFrame) -> DataFrame:
    """The pool and those custom cases whose record number it lacks, the first of each; columns that only one side has are null. What is built over the result (keys, TF-IDF, links) is derived anew, as plans are."""
    known = pool.select(F.col("cnr").alias("_cnr")).where("_cnr <> ''").distinct()
    fresh = custom.join(known, F.col("cnr") == F.col("_cnr"), "left_anti")
    order = F.struct(*(c for c in ("case_number", "title", "petitioner", "respondent") if c in custom.columns))
    one = fresh.where("cnr <> ''").groupBy("cnr").agg(F.min_by(F.struct(*(c for c in fresh.columns if c != "cnr")), order).alias("x")).select("cnr", "x.*")
    named = one.unionByName(fresh.where("coalesce(cnr, '') = ''"))
    return pool.unionByName(named.select(*(c for c in named.columns)), allowMissingColumns=True)


def truncate_json(df: DataFrame, path: str) -> None:
    """A run's results, in place of the last run's; append_json() adds to them."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def quads(rows: DataFrame, col: str = "value") -> DataFrame:
    """Tokens of name, value: array<struct<quad:array<array<double>>,text:string,score:double>>, as an engine returns them; items without four points or text go, a missing score is 0."""
    each = rows.select("name", F.posexplode(col).alias("seq", "t")).where("size(t.quad) >= 4 and t.text is not null")
    xs, ys = F.transform("t.quad", lambda p: p[0]), F.transform("t.quad", lambda p: p[1])
    return each.select("name", "seq", F.col("t.text").alias("text"), F.coalesce("t.score", F.lit(0.0)).alias("score"), F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def longer_text(first: Column, second: Column, least: int = 100) -> Column:
    """struct(text, engine, is_scanned): the first engine's text, or where that is short and the second's longer, the second's; what is short even so is a scan."""
    a, b = X.text_or_empty(first), X.text_or_empty(second)
    use = (F.length(a) < least) & (F.length(b) > F.length(a))
    text = F.when(use, b).otherwise(a)
    return F.struct(text.alias("text"), F.when(text == "", "none").when(use, "second").otherwise("first").alias("engine"), (F.length(text) < least).alias("is_scanned"))


def latest_results(names: DataFrame, col: str = "name") -> DataFrame:
    """(arm, name): each arm's last result file arm<n>_<timestamp>.json, by name."""
    arm = F.regexp_extract(col, r"^arm(\d+)_\w+\.json$", 1)
    return names.where(arm != "").groupBy(arm.cast("int").alias("arm")).agg(F.max(col).alias("name"))


def page_tagged(pages: DataFrame, doc: str, page: str, text: str, least: int = 30) -> DataFrame:
    """(doc, text, extractable): pages that have text, each under [Page n]; a document of less than `least` characters isn't extractable."""
    some = pages.where(F.trim(text) != "").select(doc, F.struct(F.col(page).alias("p"), F.col(text).alias("t")).alias("x"))
    one = some.groupBy(doc).agg(F.array_sort(F.collect_list("x")).alias("x"))
    size = F.aggregate("x", F.lit(0), lambda a, v: a + F.length(F.trim(v["t"])))
    tagged = F.transform("x", lambda v: F.concat(F.lit("[Page "), v["p"].cast("string"), F.lit("]\n"), v["t"], F.lit("\n")))
    return one.select(doc, F.array_join(tagged, "").alias("text"), (size >= least).alias("extractable"))


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, data) of every file in the tar archives that `path` (a file, folder or glob) names; a broken archive gives the members before the break. An archive is read by one task, its members one at a time."""
    kind = pa.schema([("archive", pa.string()), ("member", pa.string()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                        for m in tar:
                            if m.isfile():
                                yield pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([m.name]), pa.array([tar.extractfile(m).read()], pa.binary())], schema=kind)
                except (tarfile.TarError, EOFError, OSError):
                    continue

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "archive string, member string, data binary")


def case_texts(records: DataFrame, members: DataFrame, first, second, most_pages: int | None = None, least: int = 100) -> DataFrame:
    """records(cnr, path) with text, engine and is_scanned: the member of the record's name, read by one engine and, where that gives little, by another (sources.boundary.PdfText); a record without a member has no text. most_pages: pages read, all if None."""

    def reader(engine):
        @F.pandas_udf("string")
        def read(data: pd.Series) -> pd.Series:
            def one(x: bytes | None) -> str | None:
                try:
                    return None if x is None else "\n".join(engine.pages(bytes(x))[:most_pages]).strip()
                except Exception:  # an engine may fail on a file in any way; the file then has no text
                    return ""

            return data.map(one)

        return read

    named = records.withColumn("_member", X.pdf_member(F.col("path")))
    found = named.join(members.select(F.col("member").alias("_member"), F.col("data").alias("_data")), "_member", "left")
    best = longer_text(reader(first)(F.col("_data")), reader(second)(F.col("_data")), least)
    return found.withColumn("x", best).select(*records.columns, "x.text", "x.engine", "x.is_scanned")


def markdown(df: DataFrame, most: int = 1_000) -> str:
    """A small result (at most `most` rows) as a table in markdown."""
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    lines = [df.columns, ["---"] * len(df.columns), *(map(cell, r) for r in df.limit(most).collect())]
    return "\n".join(f"| {' | '.join(x)} |" for x in lines) + "\n"

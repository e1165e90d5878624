"""Arriving data: yearly batches without repeats, review edits, job states, and windows over events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def new_only(batch: DataFrame, master: DataFrame) -> DataFrame:
    """Rows of batch(cnr, case_number, year, ordinal) whose non-empty cnr and case_number neither the master has nor a row kept before has (in order of ordinal, within their year): a dropped row blocks none."""
    keys = [master.select(F.col(k).alias(f"_{k}")).where(F.col(k) != "").distinct() for k in ("cnr", "case_number")]
    fresh = batch.join(keys[0], F.col("cnr") == F.col("_cnr"), "left_anti").join(keys[1], F.col("case_number") == F.col("_case_number"), "left_anti")
    # of rows with the same two keys only the first can stay: what drops it drops the others, and if it stays it drops them
    first = Window.partitionBy("year", "cnr", "case_number").orderBy("ordinal")
    fresh = fresh.withColumn("_nth", F.when((F.col("cnr") != "") | (F.col("case_number") != ""), F.row_number().over(first)).otherwise(F.lit(1))).where("_nth = 1").drop("_nth")
    # only rows that share a key with another need the ordered pass
    for k in ("cnr", "case_number"):
        fresh = fresh.withColumn(f"_n_{k}", F.when(F.col(k) != "", F.count("*").over(Window.partitionBy("year", k))).otherwise(F.lit(1)))
    clash = (F.col("_n_cnr") > 1) | (F.col("_n_case_number") > 1)

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        seen: tuple[set, set] = (set(), set())
        keep = []
        for cnr, number in frame.sort_values("ordinal")[["cnr", "case_number"]].itertuples(index=False):
            ok = not (cnr and cnr in seen[0]) and not (number and number in seen[1])
            keep.append(ok)
            if ok:
                seen[0].add(cnr)
                seen[1].add(number)
        return frame.sort_values("ordinal")[keep]

    return fresh.where(~clash).unionByName(fresh.where(clash).groupBy("year").applyInPandas(fold, fresh.schema)).drop("_n_cnr", "_n_case_number")


def ingest_stream(source: DataFrame, master_path: str, checkpoint: str):
    """A file stream into the master table, batch by batch, each without what is there already."""
    from ..sources.tables import exists

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        master = spark.read.parquet(master_path) if exists(spark, master_path) else df.limit(0)
        new_only(df, master).write.mode("append").parquet(master_path)

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(edits: DataFrame, *key: str, order: str = "ts") -> DataFrame:
    """The current row of each key from a log of edits."""
    return edits.groupBy(*key).agg(F.max_by(F.struct(*(c for c in edits.columns if c not in key)), order).alias("_now")).select(*key, "_now.*")


def tumbling(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums by window and type; the watermark bounds a stream's state."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "2 days", step: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums by overlapping windows and type."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, step).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "12 hours", late: str = "2 days") -> DataFrame:
    """Each user's runs of events that are less than `gap` apart: start, end (the last event and the gap), n."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def live_search(source: DataFrame, custom_path: str, pool: DataFrame, answer, out_path: str, checkpoint: str):
    """A stream of queries against the pool and the custom cases that are there when a batch begins: answer(queries, pool) is appended to out_path."""
    from ..sources.tables import exists, with_custom

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        now = with_custom(pool, spark.read.parquet(custom_path)) if exists(spark, custom_path) else pool
        answer(df, now).write.mode("append").parquet(out_path)

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def job_stream(events: DataFrame, out_path: str, checkpoint: str):
    """The states of jobs from a stream of events(job, status, page), every change appended to out_path."""
    kind = "job string, status string, n_pages long"
    states = events.groupBy("job").applyInPandasWithState(job_states, kind, "status string, n_pages long", "append", "NoTimeout")
    return states.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def job_states(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """For applyInPandasWithState over events(job, status, page): the job's furthest status and how many pages it has."""
    rank = {"queued": 0, "processing": 1, "done": 2, "failed": 2}
    status, n = state.get if state.exists else ("queued", 0)
    for f in frames:
        for s in f["status"]:
            status = s if rank.get(s, 0) >= rank.get(status, 0) else status
        n += int(f["page"].notna().sum())
    state.update((status, n))
    yield pd.DataFrame({"job": [key[0]], "status": [status], "n_pages": [n]})

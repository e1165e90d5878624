"""What the operators of this subpackage share: inputs, scratch tables, connected components."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch handed to Python; texts may be long, so batches are short.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds at once. Every operator asks for the same size, so none changes another's; it stays set, as plans run later than they are made."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def scratch(spark: SparkSession) -> str:
    """This application's folder for written intermediate tables, under spark.checkpoint.dir; it goes when the driver ends.

    A local master may do without that setting and gets a folder on this machine; on a cluster other machines wouldn't see it, so that is a ValueError.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        base = "file://" + tempfile.mkdtemp(dir="/tmp/checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
    own = f"{base.rstrip('/')}/docweave-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(own)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return own


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow: when a task ends, its worker, which waits for others, gives the memory it freed back to the machine."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            libc = ctypes.CDLL(None)
            if hasattr(libc, "malloc_trim"):
                libc.malloc_trim(0)

    return tidied


def written(df: DataFrame, tag: str) -> DataFrame:
    """df, computed once and kept as a Parquet table in the shared folder: it survives lost executors and cuts lineage."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}/{tag}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._docweave_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Deletes the files of a table that written() made; nothing may read it afterwards."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._docweave_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of the named columns as Python values, batch after batch."""
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def in_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 512, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of at most `size` rows; strings and binaries count towards most_bytes."""
    held: list[tuple] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += sum(len(v) for v in row if isinstance(v, (str, bytes, list))) if most_bytes else 0
        if len(held) >= size or weight >= most_bytes:
            yield to_batch(held, schema)
            held, weight = [], 0
    if held:
        yield to_batch(held, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def per_row(df: DataFrame, make: Callable[[], Callable[[tuple], tuple]], inputs: list[str], out: dict[str, pa.DataType], ddl: str) -> DataFrame:
    """df's `inputs` through a row function; make() runs once a task and returns it."""
    schema = pa.schema(list(out.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        yield from in_batches((f(r) for r in rows_of(batches, *inputs)), schema)

    short_batches(df.sparkSession)
    return df.select(*inputs).mapInArrow(tidy(run), ddl)


def task_rows() -> Iterator[int]:
    """Numbers that no other task gives out: the partition's number, then a count."""
    base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
    return iter(range(base, base + (1 << 36)))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges`(a long, b long) that isn't its component's smallest node.

    Alternating star contraction: a round links every neighbour of a node to the smallest of them, first those above
    the node, then those below; rounds end when the edges stop changing, after a number that grows with the logarithm
    of the longest chain. Edges live in written tables only, the driver sees two numbers a round.
    """
    e = written(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct(), "edges")
    seen = None
    while True:
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")).first()
        if now == seen or not now["n"]:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        seen = now
        both = e.unionByName(e.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.least(F.min("lo"), F.first("hi")).alias("m"))
        large = both.where("lo > hi").join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.explode(F.array(F.struct("lo", "m"), F.struct(F.col("hi").alias("lo"), "m"))).alias("x")).select(F.col("x.lo").alias("hi"), F.col("x.m").alias("lo"))
        old, e = e, written(small.where("hi <> lo").distinct(), "edges")
        drop_written(old)


def arrow_type(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def ddl_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate, for choosing numbers of partitions; 512 MB where it knows none (it then says 8 EB or more)."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 60 else 1 << 29

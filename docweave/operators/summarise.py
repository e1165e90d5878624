"""Pages and summaries through the boundary's engines: direct text or recognition by page, notes by chunk, then one synthesis."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import builders as B
from ..functions import text as X
from ..functions.chunks import paragraph_chunks
from . import ocr

NOTE = "Chunk {index} of {total}, pages {pages}. Take notes:\n{text}"
SINGLE = "Summarise the document:\n{text}"
FINAL = "Write one summary of these notes, in order:\n{text}"


def two_pass(pages: DataFrame, recognise: DataFrame, least: float = 80.0) -> DataFrame:
    """Pages(doc, page, text) whose own text is usable stay as they are (direct_parse); the others take what recognition gives, recognise(doc, page, text, confidence, error): its text, status by confidence, its error. A page that recognition lacks needs review."""
    direct = pages.where(X.parseable(F.col("text"))).select("doc", "page", "text", F.lit("direct_parse").alias("method"), F.lit(None).cast("double").alias("confidence"), F.lit("passed").alias("status"), F.lit(None).cast("string").alias("error"))
    rest = pages.where(~X.parseable(F.col("text"))).select("doc", "page").join(recognise, ["doc", "page"], "left")
    failed = F.col("error").isNotNull() | F.col("text").isNull()
    status = F.when(failed | F.col("confidence").isNull(), F.lit("needs_review")).otherwise(ocr.page_status(F.col("confidence"), least))
    read = rest.select("doc", "page", X.text_or_empty(F.col("text")).alias("text"), F.lit("ocr").alias("method"), "confidence", status.alias("status"), "error")
    return direct.unionByName(read)


def summaries(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", size: int = 6000, overlap: int = 500, note_tokens: int = 400, final_tokens: int = 1500) -> DataFrame:
    """(id, n_chunks, summary): a document of one chunk in one pass, of more by notes on each chunk and one synthesis of the notes in order. model is a sources.boundary.Summariser; a document without text has no row."""
    cut = paragraph_chunks(docs.where(X.strip(X.text_or_empty(F.col(text_col))) != ""), id_col, text_col, size, overlap)

    def asked(most: int):
        @F.pandas_udf("string")
        def say(prompts: pd.Series) -> pd.Series:
            return prompts.map(lambda p: model.summarise(p, most))

        return say

    one = F.col("total_chunks") == 1
    place = [F.col(c) for c in ("text", "chunk_index", "total_chunks", "page_start", "page_end")]
    single = cut.where(one).select(id_col, F.lit(1).alias("n_chunks"), asked(final_tokens)(B.prompt(SINGLE, *place)).alias("summary"))
    notes = cut.where(~one).select(id_col, "chunk_index", asked(note_tokens)(B.prompt(NOTE, *place)).alias("note"))
    joined = notes.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("chunk_index", "note"))).alias("notes"))
    together = F.array_join(F.transform("notes", lambda n: n["note"]), "\n\n")
    many = joined.select(id_col, F.size("notes").alias("n_chunks"), asked(final_tokens)(B.fill(FINAL, text=together)).alias("summary"))
    return single.unionByName(many)

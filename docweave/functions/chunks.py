"""Windows and chunks of a text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip, text_or_empty


def three_chunks(text: Column, opening: int = 1500, body: int = 1500, holding: int = 400) -> Column:
    """struct(opening, body, holding, fallback, full_text_len): head, a middle from the first quarter on, and tail; the whole text three times if it is short."""
    t = strip(text_or_empty(text))
    n = F.length(t)
    start = F.greatest(F.lit(opening), F.floor(n * 0.25).cast("int"))
    end = F.least(start + body, n - holding)
    short = (n < opening + body + holding) | (end <= start)
    cut = lambda c: F.when(short, t).otherwise(c)
    return F.struct(cut(F.substring(t, 1, opening)).alias("opening"), cut(F.substr(t, start + 1, end - start)).alias("body"), cut(F.right(t, F.lit(holding))).alias("holding"), short.alias("fallback"), n.alias("full_text_len"))


def input_text(petitioner: Column, respondent: Column, title: Column, snippet: Column, most: int = 1500, bare: bool = False) -> Column:
    """A line of the parties, or else of the title, and the snippet. With bare, the parties' line stands where no party is named, too, and a missing snippet leaves nothing."""
    p, r = text_or_empty(petitioner), text_or_empty(respondent)
    parties = F.concat(F.lit("Parties: "), p, F.lit(" v. "), r)
    if bare:
        return F.substring(F.concat(parties, F.lit("\n"), snippet), 1, most)
    head = F.when((p != "") | (r != ""), parties).when(text_or_empty(title) != "", F.concat(F.lit("Title: "), title))
    return F.substring(F.concat_ws("\n", head, F.nullif(text_or_empty(snippet), F.lit(""))), 1, most)


def chunk_rows(cases: DataFrame, most: int = 1500) -> DataFrame:
    """A row for each non-empty chunk of a case, or one snippet row where all are empty: cnr, chunk_type, text."""
    each = F.array(*(F.struct(F.lit(k).alias("chunk_type"), F.substring(text_or_empty(F.col(f"chunk_{k}")), 1, most).alias("text")) for k in ("opening", "body", "holding")))
    some = F.filter(each, lambda c: c["text"] != "")
    snippet = F.array(F.struct(F.lit("snippet").alias("chunk_type"), input_text(F.col("petitioner"), F.col("respondent"), F.lit(""), F.col("extracted_text_snippet"), most).alias("text")))
    return cases.select("cnr", F.explode(F.when(F.size(some) > 0, some).otherwise(snippet)).alias("c")).select("cnr", "c.*")


def packed(text: str | None, size: int, overlap: int) -> list[tuple[int, int, str, int, int]]:
    """(index, total, text, page_start, page_end) of the chunks of whole paragraphs; what carries over is whole paragraphs within `overlap`."""
    if not text:
        return []
    if len(text) <= size:
        groups = [[text]]
    else:
        groups, own, length = [], [], 0
        for p in text.split("\n\n"):
            if own and length + len(p) + 2 > size:
                groups.append(own)
                kept = 0
                while kept < len(own) and sum(len(x) + 2 for x in own[-kept - 1 :]) <= overlap:
                    kept += 1
                own = own[len(own) - kept :]
                length = sum(len(x) + 2 for x in own)
            own = [*own, p]
            length += len(p) + 2
        groups.append(own)
    out, last = [], 1
    for i, g in enumerate(groups, 1):
        joined = "\n\n".join(g)
        pages = [int(x) for x in re.findall(r"\[Page\s+(\d+)\]", joined)] or [last]
        out.append((i, len(groups), joined, min(pages), max(pages)))
        last = max(pages)
    return out


def paragraph_chunks(docs: DataFrame, id_col: str, text_col: str, size: int = 6000, overlap: int = 500) -> DataFrame:
    @F.udf("array<struct<chunk_index:int,total_chunks:int,text:string,page_start:int,page_end:int>>", useArrow=True)
    def cut(t):
        return packed(t, size, overlap)

    return docs.select(F.col(id_col), F.explode(cut(F.col(text_col))).alias("c")).select(id_col, "c.*")

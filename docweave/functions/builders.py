"""Texts made from records: synonyms, wrapped paragraphs, shuffled sentences, demonstration documents, summaries and prompts. All run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X

# Ordered rewritings as pattern and replacement, and the wording of documents and of the summary without a model.
SYNONYMS = (
    (r"\bSpecial Leave Petition\b", "SLP"),
    (r"\bCivil Appeal\b", "appeal in this matter"),
    (r"\bCriminal Appeal\b", "criminal proceeding"),
    (r"\bHigh Court\b", "the court below"),
    (r"\bdismissed\b", "rejected on merits"),
    (r"\ballowed\b", "decided in appellant's favour"),
    (r"\bdisposed of\b", "concluded with directions"),
    (r"\bArbitration\b", "alternate dispute resolution"),
    (r"\bCode of Civil Procedure\b", "CPC"),
    (r"\bConstitution of India\b", "the Constitution"),
    (r"\bFIR\b", "first information report"),
)
HARD_SYNONYMS = (
    *SYNONYMS,
    (r"(?i)\bpetitioner\b", "the aggrieved party"),
    (r"(?i)\bappellant\b", "the party seeking relief"),
    (r"(?i)\brespondent\b", "the opposing party"),
    (r"(?i)\bjudgment\b", "decision"),
    (r"(?i)\border\b", "ruling"),
    (r"(?i)\bCourt\b", "tribunal"),
    (r"(?i)\bHon'ble\b", "presiding"),
    (r"(?i)\bthis Court\b", "the forum"),
)
EASY = "## Case Summary\n\n**Case:** {number}\n**CNR:** {cnr}\n**Court:** {court}\n**Parties:** {pet} v. {res}\n**Decision Date:** {date}\n**Outcome:** {outcome}\n\n---\n\n### Facts and Findings\n\n{text}"
MEDIUM = "## Case Note\n\n**Parties:** {pet} versus {res}\n**Court:** {court}\n**Year:** {year}\n**Date of Decision:** {date}\n**Result:** {outcome}\n\n---\n\n### Summary of Proceedings\n\n{text}"
HARD = "## Legal Matter Summary\n\n*Year of decision: {year}*\n\n---\n\n### Overview\n\n{text}\n\n---\n\n*Note: This is a paraphrased summary for research purposes. No case identifiers are included.*"
SUMMARY = """### Case Information
- **Case Name:** {title}
- **Court:** Supreme Court of India
- **Decision Date:** {date}
- **CNR / Neutral Citation:** {cnr} ({number})
- **Bench:** {bench}

### 1. Facts
{facts}

### 2. Procedural History
Disposed by Supreme Court of India via {disposal} on {date}.

### 3. Issues
Legal compliance and interpretation of Supreme Court precedent principles.

### 4. Arguments
**Petitioner:** Submitted grounds for setting aside lower forum findings based on material evidence.
**Respondent:** Maintained legality of impugned proceedings and statutory adherence.

### 5. Court's Reasoning
Analyzed precedent authorities and statutory provisions applicable under Supreme Court jurisdiction.

### 6. Decision / Holding
{holding}

### 7. Final Outcome
{disposal}.

### 8. Legal Principles
Applied established principles of Supreme Court adjudication.

### 9. Key Takeaways
- Settled legal principles under Supreme Court 2010–2025 authority.
"""


def clean_party_upper(x: Column, another: bool = True) -> Column:
    """The cleaned party in capitals, as yearly ingest keeps it."""
    return F.upper(X.clean_party(x, another))


def synonyms(x: Column, hard: bool = False) -> Column:
    return X.rules(x, *(HARD_SYNONYMS if hard else SYNONYMS))


def wrapped(x: Column, width: int = 100) -> Column:
    """Paragraphs (parted by blank lines; empty ones go) broken at white space into lines of at most `width` characters; a longer word is cut."""
    paragraphs = F.filter(F.transform(F.split(x, "\n\n"), lambda p: X.strip(F.regexp_replace(p, r"\s", " "))), lambda p: p != "")
    line = rf"(\S{{{width}}}(?=\S)|\S(?:.{{0,{width - 1}}})(?=\s|$)) *"
    return F.array_join(F.transform(paragraphs, lambda p: X.rules(p, (line, "$1\n"), (r"\s*\n\s*", "\n"), (r"\n$", ""))), "\n\n")


def fill(template: str, **parts: Column) -> Column:
    """The template with each {name} in its place; null parts are empty. Other braces stay."""
    pieces: list[Column] = []
    rest = template
    while rest:
        found = [(rest.find(f"{{{k}}}"), k) for k in parts if f"{{{k}}}" in rest]
        if not found:
            break
        at, k = min(found)
        pieces += [F.lit(rest[:at]), X.text_or_empty(parts[k])]
        rest = rest[at + len(k) + 2 :]
    return F.concat(*pieces, F.lit(rest))


def shuffled_sentences(x: Column, seed: Column) -> Column:
    """Of more than six sentences the first two and the last two stay, those between stand in the order of their hash under the seed."""
    parts = F.split(x, r"(?<=[.!?])\s+")
    n = F.size(parts)
    middle = F.transform(F.slice(parts, F.lit(3), F.greatest(n - 4, F.lit(0))), lambda s, i: F.struct(F.xxhash64(s, i, seed).alias("h"), s.alias("s")))
    mixed = F.concat(F.slice(parts, 1, 2), F.transform(F.array_sort(middle), lambda p: p["s"]), F.slice(parts, F.greatest(n - 1, F.lit(1)), F.lit(2)))
    return F.when(n > 6, F.array_join(mixed, " ")).otherwise(x)


def noised_party(x: Column, kind: Column) -> Column:
    """One of six corruptions of a name, by kind 0 to 5: as it is, in capitals, in lower case, with a title, with others, without its last word."""
    short = F.regexp_replace(x, r"\s+\S+$", "")
    forms = (x, F.upper(x), F.lower(x), F.concat(F.lit("Shri "), x), F.concat(x, F.lit(" & Ors.")), short)
    return F.element_at(F.array(*forms), (F.pmod(kind, F.lit(len(forms))) + 1).cast("int"))


def _text(record: dict[str, Column], most: int, *parts: str) -> Column:
    first = F.coalesce(F.nullif(record["chunk_opening"], F.lit("")), record["extracted_text_snippet"])
    said = [X.margin_letters(X.text_or_empty(x)) for x in (first, *(record[p] for p in parts))]
    return F.substring(X.strip(F.concat_ws("\n\n", *said)), 1, most)


def easy_document(record: dict[str, Column]) -> Column:
    """A case summary that names the case in full. record: columns by name, as in the pool."""
    title = lambda k: F.initcap(X.text_or_empty(record[k]))
    number = F.coalesce(F.nullif(record["nc_display"], F.lit("")), record["case_number"])
    return X.strip(fill(EASY, number=number, cnr=record["cnr"], court=record["court_name"], pet=title("petitioner"), res=title("respondent"), date=record["decision_date"], outcome=record["disposal_nature"], text=wrapped(_text(record, 1400, "chunk_body"))))


def medium_document(record: dict[str, Column], kind: Column) -> Column:
    """A case note without numbers, its parties noised, its text in other words."""
    parties = {k: noised_party(X.text_or_empty(record[c]), kind + i) for i, (k, c) in enumerate((("pet", "petitioner"), ("res", "respondent")))}
    return X.strip(fill(MEDIUM, **parties, court=record["court_name"], year=record["year"], date=record["decision_date"], outcome=record["disposal_nature"], text=wrapped(synonyms(_text(record, 1400, "chunk_body")))))


def hard_document(record: dict[str, Column], seed: Column) -> Column:
    """An overview without parties or numbers: other words, sentences in another order."""
    said = shuffled_sentences(synonyms(_text(record, 1600, "chunk_body", "chunk_holding"), hard=True), seed)
    return X.strip(fill(HARD, year=record["year"], text=wrapped(said)))


def summary(record: dict[str, Column], raw_text: Column) -> Column:
    """The summary that a record's fields give by themselves, without a language model; facts and holding are cut to 400 characters."""
    first = lambda *names, other: F.coalesce(*(F.nullif(X.text_or_empty(record[n]), F.lit("")) for n in names if n in record), other)
    facts = first("chunk_opening", "extracted_text_snippet", other=F.substring(X.text_or_empty(raw_text), 1, 500))
    holding = first("chunk_holding", "chunk_body", other=F.lit("Judgment of the Supreme Court of India."))
    parts = {"title": first("parties", "title", other=F.lit("Supreme Court Judgment")), "number": first("nc_display", "case_number", other=F.lit("N/A")), "cnr": first("cnr", other=F.lit("N/A")), "date": first("decision_date", other=F.lit("N/A")), "bench": first("judge", "bench", other=F.lit("BENCH")), "disposal": first("disposal_nature", other=F.lit("Disposed"))}
    return fill(SUMMARY, **parts, facts=F.substring(facts, 1, 400), holding=F.substring(holding, 1, 400))


def text_or_fields(text: Column, petitioner: Column, respondent: Column, cnr: Column, number: Column) -> Column:
    """The text, or where it is blank what the fields say: `P v. R`, the record number, the citation."""
    sides = F.concat(X.text_or_empty(petitioner), F.lit(" v. "), X.text_or_empty(respondent))
    return F.coalesce(F.nullif(X.strip(X.text_or_empty(text)), F.lit("")), F.concat_ws(" ", sides, F.nullif(X.text_or_empty(cnr), F.lit("")), F.nullif(X.text_or_empty(number), F.lit(""))))


def prompt(template: str, text: Column, index: Column, total: Column, first: Column, last: Column) -> Column:
    """A chunk's prompt: the template's {text}, {index}, {total}, {pages} (one page, or first to last)."""
    pages = F.when(first == last, first.cast("string")).otherwise(F.concat(first.cast("string"), F.lit("-"), last.cast("string")))
    return fill(template, text=text, index=index, total=total, pages=pages)

"""Normalisation, extraction and cleaning of text, as Column functions. All run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and phrases that results depend on.
HONORIFICS = "shri|smt|dr|mr|mrs|ms|prof|honble|justice|er"
CLEAN_HONORIFICS = r"Shri|Smt|Dr|Mr|Mrs|Ms|Prof|Hon'ble|Justice|Justice\.|Er"
PROCEDURAL = (
    r"\(?\bdead\b\)?",
    r"\(?\bdeceased\b\)?",
    r"\b(thr\.?|through)\s+lrs?\.?",
    r"\b(thr\.?|through)\s+(legal\s+)?representatives?\b",
    r"\b(minor\s+)?(thr\.?|through)\s+(natural\s+)?guardian\b",
    r"\b(rep\.?|represented)\s+by\b",
)
PARAPHRASES = (
    ("Special Leave Petition", "SLP"),
    ("Civil Appeal", "appeal before this Court"),
    ("Criminal Appeal", "criminal proceeding"),
    ("High Court", "impugned forum"),
    ("Penal Code", "IPC statutory provisions"),
    ("Code of Civil Procedure", "CPC procedural rules"),
    ("Order VII Rule 11", "rejection of plaint application"),
    ("disposed of", "concluded with directions"),
    ("dismissed", "rejected for lack of merit"),
    ("allowed", "granted in favor of appellant"),
)
PARENT_CASE = r"(?i)\b(?:M\.?A\.?|Misc\.?\s*Appl\.?)\s*(?:No\.?\s*\d+\s*(?:of|/)\s*\d+)?\s*\bin\b\s*(.*)"
RELATED = r"\[([\w\-]+)\]\(/matters/[\w\-]+\.md\)"
BENCH = r"\[([A-Z][A-Za-z.\s\*]{3,80}?,?\s*JJ?\.?)\]"
MISREAD_CNR = r"(?i)\bESCR[-_\s]*[A-Za-z0-9]{10,14}\b"
STRICT_CNR = r"\bESCR\d{12}\b"
CITATION = r"\b(\d{4})\s*INSC\s*(\d+)\b"
LOOSE_YEAR = r"\b(20[12]\d)\b"
SCANNED_CNR = r"(?i)\b(?:ESCR|[A-Z]{4,7})\d{10,12}\b"
REPORT = r"\[(\d{4})\]\s*(\d+)\s*SCR\s*(\d+)"
OTHERS = (r"\b(and\s+)?(others|another|ors|anr)\b\.?", "")
BOILERPLATE = ((r"\bgovt\.?\s+of\b", "government of"), (r"\bstate\s+of\b", "state"), (r"\bunion\s+of\s+india\b", "union of india"))
PUNCTUATION = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "•": "*", " ": " "}


def rules(x: Column, *pairs: tuple[str, str]) -> Column:
    """Ordered regular-expression replacements."""
    return reduce(lambda c, p: F.regexp_replace(c, p[0], p[1]), pairs, x)


def text_or_empty(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


#: What (?U)\s matches.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(x, F.lit(WHITE))


def words(x: Column, first: int = -2) -> Column:
    """Words of a text; with `first`, it is read so far only, and what is after as many words is the rest of it (an empty part may stand before them)."""
    return F.filter(F.split(x, "[ \\n\\t\\r]+", first + 2 if first > 0 else -1), lambda w: w != "")


def normalize_cnr(x: Column) -> Column:
    return F.regexp_replace(F.upper(text_or_empty(x)), "[^A-Z0-9]", "")


def normalize_case_number(x: Column) -> Column:
    return rules(F.upper(text_or_empty(x)), (r"\b(NO|NOS|OF)\b", ""), ("[^A-Z0-9]", ""))


def normalize_party(x: Column, boilerplate: bool = True) -> Column:
    low = F.lower(text_or_empty(x))
    steps = [(r"\s*&\s*", " and "), (rf"\b({HONORIFICS})\b\.?", ""), *((p, "") for p in PROCEDURAL), OTHERS]
    if boilerplate:
        steps += BOILERPLATE
    plain = ((r"[^a-z0-9\s]", " "), (r"\s+", " "))
    found = F.trim(rules(strip(low), *steps, *plain))
    return F.when(found == "", F.trim(rules(low, *plain))).otherwise(found)


def clean_party(x: Column, another: bool = True) -> Column:
    """Without honorifics, `&`, ANR (unless another is false: it stands) and ORS written out."""
    abbreviations = [(r"(?i)\bANR\b\.?", "ANOTHER")] * another + [(r"(?i)\bORS\b\.?", "OTHERS")]
    return F.trim(rules(strip(text_or_empty(x)), (rf"(?i)\b({CLEAN_HONORIFICS})\b", ""), (r"\s*&\s*", " AND "), *abbreviations, (r"\s+", " ")))


def case_number_of(nc_display: Column, case_id: Column) -> Column:
    return F.coalesce(F.nullif(text_or_empty(nc_display), F.lit("")), case_id)


def missing_cnr(x: Column) -> Column:
    return F.lower(strip(text_or_empty(x))).isin("", "none", "nan", "null")


def text_mismatch(text: Column, *ids: Column) -> Column:
    """A head text of over 100 characters in which none of the ids stands."""
    text = text_or_empty(text)
    up = F.upper(text)  # which may be longer
    found = [(text_or_empty(i) != "") & F.contains(up, F.upper(text_or_empty(i))) for i in ids]
    return (F.length(text) > 100) & ~reduce(lambda a, b: a | b, found)


def ids_strict(text: Column) -> Column:
    """struct(cnr, year, case_number): case-sensitive record number, citation, and a year of either or of the text."""
    cnr = F.regexp_extract(text, STRICT_CNR, 0)
    cite_year, cite_no = (F.regexp_extract(text, CITATION, i) for i in (1, 2))
    loose = F.regexp_extract(text, LOOSE_YEAR, 1)
    year = F.coalesce(*(F.nullif(y, F.lit("")) for y in (F.substring(cnr, -4, 4), cite_year, loose)))
    return F.struct(cnr.alias("cnr"), F.try_to_number(year, F.lit("9999")).cast("int").alias("year"), F.when(cite_no != "", F.concat(cite_year, F.lit("INSC"), cite_no)).otherwise("").alias("case_number"))


def cnr_ocr(text: Column) -> Column:
    """The broader record number that text recognition leaves, as found."""
    return F.regexp_extract(text, SCANNED_CNR, 0)


def repair_id(token: Column) -> Column:
    """A record number with its letters read as the digits they stand for."""
    bare = F.regexp_replace(token, r"[-_\s]", "")
    return F.concat(F.upper(F.substring(bare, 1, 4)), F.translate(F.substr(bare, F.lit(5)), "OoIlSB", "001158"))


def ocr_safe_cnr(text: Column) -> Column:
    """struct(cnr, corrected): the number as it stands, else of the repaired tokens the first that is one."""
    direct = cnr_ocr(text)
    tokens = F.regexp_extract_all(text, F.lit(MISREAD_CNR), F.lit(0))
    fixed = F.filter(F.transform(tokens, repair_id), lambda t: t.rlike(r"^ESCR\d{10,12}$"))
    found = F.coalesce(F.get(fixed, 0), F.lit(""))
    return F.when(direct != "", F.struct(direct.alias("cnr"), F.lit(False).alias("corrected"))).otherwise(F.struct(found.alias("cnr"), (found != "").alias("corrected")))


def fields_ocr_safe(text: Column) -> Column:
    """struct(cnr, case_number, year, corrected) of a recognised text: its record number as it stands, else repaired; its citation; the year of either, else one that the text names. Missing ones are empty."""
    text = text_or_empty(text)
    cite = [F.regexp_extract(text, f"(?i){CITATION}", i) for i in (1, 2)]
    number = F.when(cite[0] != "", F.concat_ws("INSC", *cite)).otherwise("")
    loose = F.regexp_extract(text, LOOSE_YEAR, 1)

    def found(safe: Column) -> Column:
        year = F.coalesce(F.nullif(F.right(safe["cnr"], F.lit(4)), F.lit("")), F.nullif(cite[0], F.lit("")), loose)
        return F.struct(safe["cnr"].alias("cnr"), number.alias("case_number"), year.alias("year"), safe["corrected"].alias("corrected"))

    return F.get(F.transform(F.array(ocr_safe_cnr(text)), found), 0)


def parent_case(x: Column) -> Column:
    found = strip(F.regexp_extract(text_or_empty(x), PARENT_CASE, 1))
    return F.nullif(F.upper(rules(found, (r"^[(\[{\s\"'`]+", ""), (r"[)\]}\s\"'`]+$", ""))), F.lit(""))


def decision_date(x: Column) -> Column:
    return F.coalesce(F.try_to_date(x, "dd-MM-yyyy"), F.try_to_date(x, "yyyy-MM-dd"))


def is_generic_govt(x: Column, strict_reference: bool = True) -> Column:
    """Only the empty name, as upper-case terms are looked for in lower case; strict_reference=False looks for them in the same case."""
    norm = normalize_party(x)
    return norm == "" if strict_reference else (norm == "") | norm.rlike(r"\b(state|union of india|government|commissioner|collector|secretary)\b")


def paraphrase(x: Column) -> Column:
    """Phrases replaced in order; of more than three lines the first two stay and the others stand in the order of their hash."""
    said = rules(text_or_empty(x), *((rf"(?i)\b{a}\b", b) for a, b in PARAPHRASES))
    lines = F.split(said, "\n")
    rest = F.transform(F.array_sort(F.transform(F.slice(lines, F.lit(3), F.greatest(F.size(lines) - 2, F.lit(1))), lambda s: F.struct(F.md5(s.cast("binary")).alias("h"), s.alias("s")))), lambda p: p["s"])
    return strip(F.when(F.size(lines) > 3, F.array_join(F.concat(F.slice(lines, 1, 2), rest), "\n")).otherwise(said))


def margin_letters(x: Column) -> Column:
    return rules(x, (r"(?m)^\s*[A-H]\s*$", ""), (r"\n{3,}", "\n\n"))


def sanitise_latin(x: Column) -> Column:
    keys = "".join(PUNCTUATION)
    return F.regexp_replace(F.translate(x, keys, "".join(PUNCTUATION.values())), r"[^\x00-\xFF]", "?")


def after_rule(x: Column) -> Column:
    """What follows the first line of three dashes, trimmed; all of it if there is none."""
    parts = F.split(x, "\n---\n", 2)
    return F.when(F.size(parts) > 1, strip(F.get(parts, 1))).otherwise(x)


def clean_extracted(x: Column) -> Column:
    return strip(rules(text_or_empty(x), (r"(\b\w+)-\n(\w+\b)", "$1$2"), (r"[ \t\r\f\x0B]+", " "), (r"(?m)^ +| +$", ""), (r"\n{3,}", "\n\n")))


def file_size(n: Column) -> Column:
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1048576, F.format_string("%.1f KB", F.bround(n / 1024.0, 1))).otherwise(F.format_string("%.2f MB", F.bround(n / 1048576.0, 2)))


def confidence_label(x: Column) -> Column:
    return F.when(x.isNotNull(), F.format_string("%.1f%%", F.bround(x.cast("double"), 1)))


def preview(x: Column, n: int = 300) -> Column:
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit("..."))).otherwise(x)


def blank_to_null(x: Column) -> Column:
    return F.nullif(strip(x.cast("string")), F.lit(""))


def pdf_member(path: Column) -> Column:
    return F.when(F.endswith(path, F.lit(".pdf")), path).otherwise(F.concat(path, F.lit("_EN.pdf")))


def parseable(x: Column) -> Column:
    """At least 50 characters, two fifths of them letters or digits."""
    t = strip(text_or_empty(x))
    return (F.length(t) >= 50) & (F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]", "")) / F.greatest(F.length(t), F.lit(1)) >= 0.4)


def related_ids(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(RELATED), F.lit(1))


def bench_names(x: Column) -> Column:
    raw = F.regexp_replace(F.regexp_extract(x, BENCH, 1), r"\*", "")
    parts = F.filter(F.split(raw, ",| and | AND "), lambda p: F.trim(p) != "")
    return F.transform(parts, lambda p: F.trim(rules(F.trim(p), (r"\.+$", ""), (r"J+$", ""))))


def ingest_fields(text: Column, stem: Column) -> Column:
    """struct(cnr, display, case_id) of a new file: an INSC citation names it, else an SCR citation, else its CNR, else the file's stem (so too where text is null)."""
    text = text_or_empty(text)
    cnr = F.upper(F.regexp_extract(text, f"(?i){STRICT_CNR}", 0))
    insc = F.regexp_extract(text, CITATION, 1), F.regexp_extract(text, CITATION, 2)
    scr = tuple(F.regexp_extract(text, REPORT, i) for i in (1, 2, 3))
    display = F.when(insc[0] != "", F.concat_ws(" INSC ", *insc)).when(scr[0] != "", F.concat(F.lit("["), scr[0], F.lit("] "), scr[1], F.lit(" SCR "), scr[2]))
    case_id = F.when(insc[0] != "", F.concat_ws("INSC", *insc)).when(scr[0] != "", F.concat_ws("_", scr[0], F.lit("SCR"), scr[1], scr[2]))
    other = F.when(cnr != "", cnr).otherwise(stem)
    return F.struct(cnr.alias("cnr"), F.coalesce(display, other).alias("display"), F.coalesce(case_id, other).alias("case_id"))


def title_parties(text: Column) -> Column:
    """struct(title, petitioner, respondent): the first of the first 15 lines with text that holds ` V. ` or ` VERSUS `, and its two sides; else the first line alone."""
    lines = F.slice(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), 1, 15)
    title = F.get(F.filter(lines, lambda x: F.upper(x).rlike(" (V\\.|VERSUS) ")), F.lit(0))
    sides = F.split(title, "(?i) (?:V\\.|VERSUS) ", 2)
    return F.struct(F.coalesce(title, F.get(lines, F.lit(0))).alias("title"), F.trim(F.get(sides, F.lit(0))).alias("petitioner"), F.trim(F.get(sides, F.lit(1))).alias("respondent"))


def noised_cnr(cnr: Column, kind: Column) -> Column:
    """One of three corruptions (kind 0, 1, 2): a dash and the first 0 read as O, lower case, the seventh and eighth digits struck out. Short ids stay."""
    digits = F.substring(cnr, 5, 1 << 20)
    return F.when(F.length(cnr) < 12, cnr).when(kind == 0, F.concat(F.substring(cnr, 1, 4), F.lit("-"), F.regexp_replace(digits, "^([^0]*)0", "$1O"))).when(kind == 1, F.lower(cnr)).otherwise(F.concat(F.substring(cnr, 1, 10), F.lit("XX"), F.substring(cnr, 13, 1 << 20)))


def ocr_noised_cnr(cnr: Column) -> Column:
    """As a scan misreads it: a dash after the prefix, O for 0, I for 1, S for 5."""
    return F.concat(F.substring(cnr, 1, 4), F.lit("-"), F.translate(F.substring(cnr, 5, 1 << 20), "015", "OIS"))


def corpus_name(name: Column) -> Column:
    """struct(number, stage, cnr) of doc_<number>_<stage>_<cnr>.md; null for other names."""
    part = lambda i: F.regexp_extract(name, r"^doc_(\d+)_(easy|medium|hard)_(\w+)\.md$", i)
    return F.when(part(1) != "", F.struct(part(1).cast("int").alias("number"), part(2).alias("stage"), part(3).alias("cnr")))


def duration(seconds: Column) -> Column:
    return F.concat(F.floor(seconds / 60).cast("string"), F.lit("m "), (seconds % 60).cast("int").cast("string"), F.lit("s"))


def canonical(petitioner: Column, respondent: Column, text: Column, court: Column) -> list[Column]:
    """parties (a JSON array), snippet (the first 1500 characters) and court_name (the default where there is none) of a canonical record."""
    named = F.coalesce(blank_to_null(court), F.lit("Supreme Court of India"))
    return [F.to_json(F.array(text_or_empty(petitioner), text_or_empty(respondent))).alias("parties"), F.substring(text_or_empty(text), 1, 1500).alias("snippet"), named.alias("court_name")]

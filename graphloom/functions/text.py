"""Text functions as columns: cleaning, line rules, citations, labels. Patterns that must be just these are marked fixed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

BLANKS = " \t\n\r\x0b\x0c"

# Lines that are page furniture, compared after trimming, from the start, in any case.
FURNITURE = (
    r"^-?\s*\d+\s*-?\s*$",
    r"^www\.hukumonline\.com$",
    r"^Salinan$",
    r"^PRESIDEN\s+REPUBLIK\s+INDONESIA$",
    r"^LEMBARAN\s+NEGARA\s+REPUBLIK\s+INDONESIA$",
    r"^\s*\.{3,}\s*$",
    r"^TAMBAHAN\s+LEMBARAN\s+NEGARA",
)
# Page breaks within running text, in this order, and what replaces them.
PAGE_BREAKS = (
    (r"(?i)\.\s*\.\s*\.?\s*PRESIDEN\s+REPUBLIK\s+INDONESIA\s*", ""),
    (r"(?<!\w)\.\s+\.\s+\.(?!\w)", ""),
    (r"\s*-\s*\d+\s*-\s*", " "),
)
# Line rules, the first that matches counts.
LINE_RULES = (
    ("BAB", r"(?i)^\s*BAB\s+([IVXLCDM]+)\s*$"),
    ("BAGIAN", r"(?i)^\s*Bagian\s+(Ke(?:satu|dua|tiga|empat|lima|enam|tujuh|delapan|sembilan|sepuluh|sebelas|dua\s+belas|tiga\s+belas|empat\s+belas|lima\s+belas))\s*$"),
    ("PARAGRAF", r"(?i)^\s*Paragraf\s+(\d+)\s*$"),
    ("PASAL", r"(?i)^\s*Pasal\s+(\d+[A-Z]?)\s*$"),
    ("AYAT", r"^\s*\((\d+)\)\s+(.+)"),
    ("HURUF", r"^\s*([a-z])\.\s+(.+)"),
    ("ANGKA", r"^\s*(\d+)\.\s+(.+)"),
)
# How texts cite rules, and what counts as a citation at all.
CITATIONS = (r"Pasal\s+\d+(?:\s+ayat\s+\(\d+\))?", r"UU\s+(?:No\.\s*)?\d+(?:\s+Tahun\s+\d+)?")
LEGAL_MARKS = (r"[Pp]asal\s+\d+", r"[Uu]ndang[-\s]*[Uu]ndang", r"UU\s+", r"[Aa]yat\s+\(\d+\)")
# Question words that searches leave out.
STOP_WORDS = "apa siapa bagaimana mengapa dimana kapan berapa yang di dan atau itu ini adalah menurut dalam untuk dari ke pada dengan oleh tentang saja".split()
# File names that tell a document's type, number and year; the first that matches counts.
FILE_NAMES = (
    (r"(?i)(?:UU|Undang.Undang)\s*(?:Nomor|No\.?)\s*(\d+)\s*(?:Tahun)\s*(\d{4})", "UU"),
    (r"(?i)POJK\s*(\d+)\s*[-/]\s*(?:POJK\.?)?\s*0?3?\s*[-/]\s*(\d{4})", "POJK"),
    (r"(?i)PP\s*(?:Nomor|No\.?)\s*(\d+)\s*(?:Tahun)\s*(\d{4})", "PP"),
    (r"(?i)Perpres\s*(?:Nomor|No\.?)\s*(\d+)\s*(?:Tahun)\s*(\d{4})", "Perpres"),
    (r"(?i)Permen\s*\w*\s*(?:Nomor|No\.?)\s*(\d+)\s*(?:Tahun)\s*(\d{4})", "Permen_Kominfo"),
)
# Fixed value: a fenced block, with or without one of these languages.
FENCE = r"(?s)```(?:cypher|sql|plaintext)?\s*\n?(.*?)```"
# Fixed value: file names in a short form.
COMPACT_NAME = r"(?i)(UU|PP|Perpres)[_\-](\d+)[_\-](\d{4})"
# Titles within the first page, and what a document of that kind is called.
TITLES = (
    (r"(?is)UNDANG-UNDANG\s+REPUBLIK\s+INDONESIA\s+.*?TENTANG\s+(.+?)(?:\n|$)", "Undang-Undang"),
    (r"(?is)PERATURAN\s+OTORITAS\s+JASA\s+KEUANGAN.*?TENTANG\s+(.+?)(?:\n|$)", "POJK"),
)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stripped(c: str | Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.btrim(_col(c), F.lit(BLANKS))


def words(c: str | Column) -> Column:
    """The words between blanks, none for null."""
    return F.filter(F.split(F.coalesce(_col(c), F.lit("")), r"\s+"), lambda w: w != "")


def count_tokens(c: str | Column) -> Column:
    """1.3 tokens a word, rounded down."""
    return F.floor(F.size(words(c)) * F.lit(1.3)).cast("int")


def strip_page_breaks(c: str | Column) -> Column:
    return reduce(lambda x, rule: F.regexp_replace(x, rule[0], rule[1]), PAGE_BREAKS, _col(c))


def strip_furniture(c: str | Column, rules: tuple[str, ...] = FURNITURE) -> Column:
    """Without the lines that match a rule after trimming; blank lines become empty ones."""
    any_rule = "(?i)" + "|".join(f"(?:{r})" for r in rules)
    kept = F.filter(F.split(_col(c), "\n"), lambda x: (stripped(x) == "") | ~stripped(x).rlike(any_rule))
    return F.array_join(F.transform(kept, lambda x: F.when(stripped(x) == "", "").otherwise(x)), "\n")


def normalize_whitespace(c: str | Column) -> Column:
    """Single blanks, no more than one empty line, lines and text trimmed."""
    one = F.regexp_replace(F.regexp_replace(_col(c), "[ \t]+", " "), "\n{3,}", "\n\n")
    return stripped(F.array_join(F.transform(F.split(one, "\n"), stripped), "\n"))


def clean_page(selectable: str | Column, ocr: str | Column, scanned: str | Column) -> Column:
    """The scanned text or the selectable one, cleaned; empty if there is none."""
    raw = F.coalesce(F.when(_col(scanned), _col(ocr)).otherwise(_col(selectable)), F.lit(""))
    return normalize_whitespace(strip_furniture(strip_page_breaks(raw)))


def is_scanned(c: str | Column, threshold: int = 50) -> Column:
    return F.length(stripped(F.coalesce(_col(c), F.lit("")))) < threshold


def line_type(c: str | Column) -> Column:
    out = F.lit(None).cast("string")
    for name, rule in reversed(LINE_RULES):
        out = F.when(_col(c).rlike(rule), name).otherwise(out)
    return out


def line_part(c: str | Column, kind: str | Column, group: int) -> Column:
    """The number (1) or the rest (2) of a line of a known type."""
    out = F.lit(None).cast("string")
    for name, rule in LINE_RULES:
        if group == 1 or "(.+)" in rule:
            out = F.when(_col(kind) == name, F.regexp_extract(_col(c), rule, group)).otherwise(out)
    return out


def clean_ocr_number(c: str | Column) -> Column:
    """Digits, after letters that scans confuse with them were replaced (fixed values)."""
    return F.regexp_replace(F.translate(F.regexp_replace(_col(c), r"\s+", ""), "lIOogGSs", "11008655"), "[^0-9]", "")


def normalize_label(c: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(stripped(c)), r"\s+", " "), r"^(pasal|ayat|bab|bagian)\s+", "")


def sanitized(c: str | Column) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(_col(c), "[^a-zA-Z0-9_]", "_"), "_+", "_"), F.lit("_"))


def generated_id(label: str | Column, kind: str | Column) -> Column:
    return F.concat(_col(kind), F.lit("_"), sanitized(F.substring(stripped(label), 1, 50)))


def file_metadata(name: str | Column) -> dict[str, Column]:
    """document_id, number and year from a file's name; without a rule that matches, the sanitised name and year 0."""
    base = _col(name)
    plain = F.btrim(F.regexp_replace(F.regexp_replace(base, "[^a-zA-Z0-9]", "_"), "_+", "_"), F.lit("_"))
    doc, number, year = plain, F.lit("unknown"), F.lit(0)
    take = lambda rule, k: F.regexp_extract(base, rule, k)
    found = base.rlike(COMPACT_NAME)
    doc = F.when(found, F.concat_ws("_", take(COMPACT_NAME, 1), take(COMPACT_NAME, 2), take(COMPACT_NAME, 3))).otherwise(doc)
    number = F.when(found, F.concat_ws("/", take(COMPACT_NAME, 2), take(COMPACT_NAME, 3))).otherwise(number)
    year = F.when(found, F.try_to_number(take(COMPACT_NAME, 3), F.lit("9999")).cast("int")).otherwise(year)
    for rule, prefix in reversed(FILE_NAMES):
        found = base.rlike(rule)
        doc = F.when(found, F.concat_ws("_", F.lit(prefix), take(rule, 1), take(rule, 2))).otherwise(doc)
        number = F.when(found, F.concat_ws("/", take(rule, 1), take(rule, 2))).otherwise(number)
        year = F.when(found, F.try_to_number(take(rule, 2), F.lit("9999")).cast("int")).otherwise(year)
    return {"document_id": doc, "number": number, "year": year}


def title(text: str | Column, number: str | Column, default: str | Column) -> Column:
    out = _col(default)
    for rule, kind in reversed(TITLES):
        out = F.when(_col(text).rlike(rule), F.concat(F.lit(f"{kind} Nomor "), _col(number), F.lit(" tentang "), stripped(F.regexp_extract(_col(text), rule, 1)))).otherwise(out)
    return out


def citations(c: str | Column) -> Column:
    """The distinct citations of a text, sorted."""
    return F.array_sort(F.array_distinct(F.concat(*(F.regexp_extract_all(_col(c), F.lit(rule), F.lit(0)) for rule in CITATIONS))))


def has_legal_mark(c: str | Column) -> Column:
    return reduce(lambda a, b: a | b, (_col(c).rlike(rule) for rule in LEGAL_MARKS))


def keywords(c: str | Column, most: int = 5) -> Column:
    """The first words of a question that are longer than two letters and no question words."""
    plain = F.regexp_replace(F.lower(_col(c)), r"\b(" + "|".join(STOP_WORDS) + r")\b", " ")
    return F.slice(F.filter(words(plain), lambda w: F.length(w) > 2), 1, most)


def bigrams(c: str | Column) -> Column:
    long = F.filter(words(c), lambda w: F.length(w) > 2)
    return F.transform(F.slice(long, 1, F.greatest(F.size(long) - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", w, F.get(long, i + 1)))


def normalize_query(c: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(stripped(c)), r"\s+", " "), r"\s*([{}()\[\],:])\s*", "$1")


def query_shape(c: str | Column) -> Column:
    """Whether a query returns something and closes what it opens."""
    n = lambda sign: F.length(_col(c)) - F.length(F.replace(_col(c), F.lit(sign), F.lit("")))
    return F.upper(_col(c)).contains("RETURN") & (n("(") == n(")")) & (n("[") == n("]"))


def syntax_ok(c: str | Column) -> Column:
    return F.lower(stripped(c)).rlike("^(match|return|call|with)")


def without_fence(c: str | Column) -> Column:
    """The first fenced block of an answer, on one line or more, or the answer without a fence that nothing closes."""
    fenced = _col(c).rlike(FENCE)
    left_open = F.rtrim(stripped(F.regexp_replace(_col(c), r"\A[^\n]*\n?", "")), F.lit("`"))
    return F.when(fenced, stripped(F.regexp_extract(_col(c), FENCE, 1))).when(F.startswith(_col(c), F.lit("```")), left_open).otherwise(stripped(c))


def parsed_json(c: str | Column) -> Column:
    """The JSON of an answer, or of its widest braces, as a variant; null if neither is JSON."""
    return F.coalesce(F.try_parse_json(_col(c)), F.try_parse_json(F.nullif(F.regexp_extract(_col(c), r"(?s)\{.*\}", 0), F.lit(""))))


def truncated(c: str | Column, most: int = 200) -> Column:
    return F.when(F.length(_col(c)) > most, F.concat(F.substring(_col(c), 1, most), F.lit("..."))).otherwise(_col(c))


def embed_text(label: str | Column, content: str | Column) -> Column:
    return F.when(F.coalesce(_col(content), F.lit("")) != "", F.concat(_col(label), F.lit(": "), F.substring(_col(content), 1, 500))).otherwise(_col(label))


def sft_prompt(context: str | Column, question: str | Column, response: str | Column) -> Column:
    return F.concat(F.lit("### Instruction:\n"), _col(context), F.lit("\n\n### Input:\n"), _col(question), F.lit("\n\n### Output:\n"), _col(response))

"""Scalar text functions, Column -> Column, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

THAI_DIGITS, ARABIC_DIGITS = "๐๑๒๓๔๕๖๗๘๙", "0123456789"
# Thai number words and their values (fixed values).
NUMBER_WORDS = (
    ("ศูนย์", 0), ("หนึ่ง", 1), ("สอง", 2), ("สาม", 3), ("สี่", 4), ("ห้า", 5), ("หก", 6), ("เจ็ด", 7), ("แปด", 8), ("เก้า", 9), ("สิบ", 10),
    ("สิบเอ็ด", 11), ("สิบสอง", 12), ("สิบสาม", 13), ("สิบสี่", 14), ("สิบห้า", 15), ("สิบหก", 16), ("สิบเจ็ด", 17), ("สิบแปด", 18), ("สิบเก้า", 19),
    ("ยี่สิบ", 20), ("ร้อย", 100), ("พัน", 1000), ("หมื่น", 10000),
)
BLANK = r"[\s\p{Z}\x1c-\x1f\x85]"


def replace_all(col: Column, *rules: tuple[str, str]) -> Column:
    for pattern, new in rules:
        col = F.regexp_replace(col, pattern, new)
    return col


def strip(col: Column) -> Column:
    """Remove outer blanks of any kind, as opposed to ``trim``, which removes spaces."""
    return F.regexp_replace(col, rf"^{BLANK}+|{BLANK}+$", "")


def blank_to_null(col: Column) -> Column:
    return F.when(strip(col) != "", col)


def sanitize_id(col: Column) -> Column:
    return replace_all(strip(F.lower(col)), (r"\s+", "_"), (r"[^a-z0-9_฀-๿-]", ""))


def document_id(col: Column) -> Column:
    """Like ``sanitize_id``, ``unknown_doc`` for nothing."""
    return F.coalesce(F.nullif(sanitize_id(col), F.lit("")), F.lit("unknown_doc"))


def file_stem_id(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/\\]+)$", 1)
    return F.translate(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), " -", "__")


def normalize_whitespace(col: Column) -> Column:
    return strip(replace_all(col, ("[​-‍﻿]", ""), (" ", " "), (r"\n{3,}", "\n\n"), (r" {2,}", " ")))


def printable(col: Column) -> Column:
    """Printable characters and line breaks only, blanks squeezed, none beside a break."""
    return strip(replace_all(col, (r"[\p{C}\p{Z}&&[^ \n]]", ""), (r"[ \t]+", " "), (r" *\n *", "\n")))


def thai_spacing(col: Column) -> Column:
    """Drop blanks between Thai letters, squeeze other blanks and blank lines."""
    return strip(replace_all(col, (r"(?<=[฀-๿])[ \t]+(?=[฀-๿])", ""), (r"[ \t]+", " "), (r"\n\s*\n+", "\n\n")))


def thai_one_line(col: Column) -> Column:
    return strip(replace_all(col, (r"(?<=[฀-๿])\n+(?=[฀-๿])", ""), (r"\s+", " "), (r"(?<=[฀-๿]) +(?=[฀-๿])", "")))


def clean_cells(rows: Column) -> Column:
    """Cells without NUL and outer blanks; nulls and numbers pass."""
    return F.transform(rows, lambda r: F.transform(r, lambda c: thai_spacing(F.regexp_replace(c, "\u0000", ""))))


def markdown_text(col: Column) -> Column:
    return thai_spacing(F.regexp_replace(col, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""))


def sanitize_html(col: Column) -> Column:
    return replace_all(col, (r"(?is)<script.*?>.*?</script>", ""), (r"(?i) on\w+=", " data-blocked-event="), (r"(?i)javascript:", "blocked:"))


def html_headers(col: Column) -> Column:
    """The texts of header cells, tags removed, blank-joined."""
    cells = F.transform(F.regexp_extract_all(col, F.lit(r"(?is)<th[^>]*>(.*?)</th>"), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, "<[^>]+>", " ")))
    return F.array_join(cells, " ")


def strip_tags(col: Column) -> Column:
    return F.trim(replace_all(col, ("<[^>]+>", " "), (r"\s+", " ")))


def truncate_html(col: Column, limit: int = 4000) -> Column:
    """Cut to ``limit`` characters, then back to the last complete row if there is one; a table left open is closed."""
    head = F.substring(col, 1, limit)
    back = F.position(F.reverse(F.lit("</tr>")), F.reverse(head))
    cut = F.when(back > 0, head.substr(F.lit(1), F.length(head) - back + 1)).otherwise(head)
    open_ = F.regexp_count(cut, F.lit("<table")) > F.regexp_count(cut, F.lit("</table>"))
    return F.when(F.length(col) <= limit, col).when(open_, F.concat(cut, F.lit("</table>"))).otherwise(cut)


def section_title(col: Column) -> Column:
    """A heading without its number or capital letter, which must end in a full stop or bracket."""
    return F.substring(replace_all(strip(col), (r"^(?:[0-9]+(?:\.[0-9]+)*|[A-Z])[.)]\s*", ""), (rf"{BLANK}+", " ")), 1, 150)


def display_section(col: Column, limit: int = 50) -> Column:
    base = F.coalesce(F.nullif(strip(col), F.lit("")), F.lit("General"))
    return F.when(F.length(base) > limit, F.concat(F.substring(base, 1, limit - 3), F.lit("..."))).otherwise(base)


def to_arabic_digits(col: Column) -> Column:
    return F.translate(col, THAI_DIGITS, ARABIC_DIGITS)


def to_thai_digits(col: Column) -> Column:
    return F.translate(col, ARABIC_DIGITS, THAI_DIGITS)


def number_words(col: Column) -> Column:
    """Thai number words as digits, the longest word first."""
    for word, value in sorted(NUMBER_WORDS, key=lambda x: -len(x[0])):
        col = F.replace(col, F.lit(word), F.lit(str(value)))
    return col


def shift_years(col: Column, delta: int, low: int = 2400, high: int = 2700) -> Column:
    """Groups of four digits from ``low`` to ``high`` moved by ``delta``: the text is cut at such groups and joined again."""
    parts = F.split(F.regexp_replace(col, r"([0-9]{4})", "\u0001$1\u0001"), "\u0001")
    year = lambda p: p.try_cast("int")
    moved = F.transform(parts, lambda p: F.when(p.rlike(r"^[0-9]{4}$") & year(p).between(low, high), (year(p) + delta).cast("string")).otherwise(p))
    return F.array_join(moved, "")


def query_variants(col: Column) -> Column:
    """The spellings of a query, first seen first: as is, Arabic digits, Thai digits, number words as Arabic and as Thai
    digits, years moved by 543 either way."""
    arabic, words = to_arabic_digits(col), number_words(col)
    return F.array_distinct(F.array(col, arabic, to_thai_digits(col), words, to_thai_digits(words), shift_years(arabic, -543), shift_years(arabic, 543)))


def tokens(col: Column) -> Column:
    return F.regexp_extract_all(F.lower(col), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def keyword_overlap(a: Column, b: Column, stop: tuple[str, ...] = ()) -> Column:
    """Distinct common words longer than one character, without ``stop``."""
    both = F.array_intersect(tokens(a), tokens(b))
    return F.size(F.filter(both, lambda w: (F.length(w) > 1) & ~w.isin(*stop) if stop else F.length(w) > 1))


def strip_context(col: Column) -> Column:
    """Without the contextual prefix, which runs from ``[Doc:`` to the first blank line."""
    at = F.locate("\n\n", col)
    return F.when(col.startswith("[Doc:") & (at > 0), col.substr(at + 2, F.length(col))).otherwise(col)


def with_context(content: Column, name: Column, summary: Column, section: Column) -> Column:
    """Content behind its contextual prefix; unchanged without a summary."""
    head = F.concat(F.lit("[Doc: "), name, F.coalesce(F.concat(F.lit(" | Section: "), blank_to_null(section)), F.lit("")), F.lit("]\n"), summary, F.lit("\n\n"))
    return F.when(blank_to_null(summary).isNull(), content).otherwise(F.concat(head, content))


def meaningful_words(col: Column) -> Column:
    return col.rlike(r"[A-Za-z0-9_฀-๿]{3,}")


def meaningful_marks(col: Column) -> Column:
    return F.regexp_count(col, F.lit(r"[A-Za-z0-9฀-๿]")) >= 2


def meaningful_any(col: Column) -> Column:
    return col.rlike(r"[\p{L}\p{N}]")


def amount(col: Column) -> Column:
    """Number behind commas, currency sign, blanks and accounting parentheses; null for anything else."""
    s = F.regexp_replace(col, r"[,฿\s]", "")
    s = F.when(s.rlike(r"^\(.*\)$"), F.concat(F.lit("-"), s.substr(F.lit(2), F.length(s) - 2))).otherwise(s)
    return F.when(s.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), s.try_cast("double"))


def usd(col: Column) -> Column:
    """Dollar amount with more places the smaller it is."""
    return F.when(col.isNull() | (col == 0), "$0.00").when(col < 0.01, F.format_string("$%.5f", col)).when(col < 1, F.format_string("$%.4f", col)).otherwise(F.format_string("$%.2f", col))


def flatten_list(col: Column) -> Column:
    return F.array_join(col, ",")


def lenient_json(col: Column, schema: str, pattern: str = r"\{[^{}]*\}") -> Column:
    """The first JSON object within prose; null where there is none or it does not parse."""
    return F.from_json(F.nullif(F.regexp_extract(col, rf"(?s)({pattern})", 1), F.lit("")), schema)


def greedy_json(col: Column, schema: str) -> Column:
    """The object from the first opening to the last closing brace of a prose text."""
    return lenient_json(col, schema, r"\{.*\}")


def json_list(col: Column, schema: str) -> Column:
    """The list from the first opening to the last closing bracket of a prose text."""
    return lenient_json(col, schema, r"\[.*\]")


def escape_html(col: Column) -> Column:
    return replace_all(col, ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))


def log_text(col: Column, most: int = 300) -> Column:
    """A log line squeezed to single blanks, cut, and escaped for HTML."""
    line = strip(F.regexp_replace(col, rf"{BLANK}+", " "))
    return escape_html(F.when(F.length(line) > most, F.concat(F.substring(line, 1, most), F.lit("…"))).otherwise(line))


def normal_string(col: Column) -> Column:
    """Lower case without outer blanks; null for nothing."""
    return F.nullif(F.lower(strip(col)), F.lit(""))


def normal_enum(col: Column, known: tuple[str, ...], default: str) -> Column:
    n = normal_string(col)
    return F.when(n.isin(*known), n).otherwise(default)


def safe_box(col: Column) -> Column:
    """A box of four numbers, from an array of strings; null for anything else."""
    numbers = F.transform(col, lambda x: x.try_cast("double"))
    return F.when((F.size(col) == 4) & F.forall(numbers, lambda x: x.isNotNull()), numbers)


def sse_frames(col: Column) -> Column:
    """event and data of the frames of a server-sent stream: frames end with a blank line, data lines are joined."""
    field = lambda f, name: F.transform(F.filter(F.split(f, "\n"), lambda line: line.startswith(name)), lambda line: F.regexp_replace(line, rf"^{name}:? ?", ""))
    frames = F.filter(F.split(F.regexp_replace(col, "\r\n?", "\n"), r"\n\n+"), lambda f: strip(f) != "")
    return F.transform(frames, lambda f: F.struct(F.coalesce(F.try_element_at(field(f, "event"), F.lit(1)), F.lit("message")).alias("event"), F.array_join(field(f, "data"), "\n").alias("data")))


def bearer(col: Column) -> Column:
    return F.nullif(F.regexp_extract(col, r"(?i)^\s*bearer\s+(\S+)\s*$", 1), F.lit(""))


def label_cleanup(col: Column) -> Column:
    return F.regexp_replace(F.lower(col), "[^a-z_]", "")

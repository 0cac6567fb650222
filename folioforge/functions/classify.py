"""Rule tables (fixed values) and the expressions built from them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.text import strip

# Chunk intents: pattern, score, priority.
INTENTS = {
    "troubleshooting": (r"(?:แก้ปัญหา|error|fail|not\s*working|เสีย|ซ่อม|troubleshoot)", 3, 5),
    "safety": (r"(?:ความปลอดภัย|warning|danger|ระวัง|ห้าม|อันตราย)", 3, 5),
    "installation": (r"(?:วิธี|ขั้นตอน|how\s*to|install|setup|การติดตั้ง|วิธีการ)", 2, 4),
    "identity": (r"(?:ผู้|ชื่อ|ลงนาม|อนุมัติ|who|name|signature)", 2, 3),
    "financial": (r"(?:ราคา|ค่าใช้จ่าย|เงิน|บาท|cost|price)", 2, 3),
    "reference": (r"(?:ความหมาย|คือ|definition|spec|สเปค|คุณลักษณะ)", 1, 2),
}
GENERAL = ("general", 1)
# Further words of the query side.
QUERY_MORE = {"identity": "ใคร", "financial": "งวด|จ่าย|ค่าจ้าง", "reference": "เกี่ยวกับอะไร"}
SCOPES = (("procedure", r"(?:step|ขั้นตอนที่|\d+\.)"), ("warning", "(?:warning|คำเตือน)"), ("tabular", "(?:table|ตาราง)"), ("example", "(?:ตัวอย่าง|example|กรณี)"))
MONEY = r"(\d+(?:,\d{3})*(?:\.\d{2})?)\s*(?:บาท|baht|฿)"
YEAR = r"(?:ปี\s*)?(\d{4}|พ\.ศ\.\s*\d{4})"
THAI_NAME = r"(?:นาย|นาง|นางสาว|คุณ|ดร\.|ศ\.|รศ\.|ผศ\.)\s*[฀-๿]+\s+[฀-๿]+"
QNA_BREAK = r"(?i)(?:ถาม|q|question)\s*[:\-]"
# Intents and entities of layout blocks.
LAYOUT_INTENTS = {
    "installation": ("install", "setup", "mounting", "connection", "wiring", "การติดตั้ง", "ต่อสาย"),
    "operation": ("operate", "use", "function", "start", "stop", "การใช้งาน", "วิธีใช้"),
    "troubleshooting": ("error", "fault", "problem", "solution", "fix", "แก้ปัญหา", "อาการเสีย"),
    "maintenance": ("maintain", "clean", "replace", "check", "inspection", "บำรุงรักษา"),
    "safety": ("safety", "warning", "caution", "danger", "hazard", "ความปลอดภัย", "อันตราย"),
    "specification": ("spec", "dimension", "weight", "voltage", "technical data", "ข้อมูลจำเพาะ"),
}
LAYOUT_ENTITIES = ("power button", "led", "lcd", "battery", "fuse", "sensor", "switch", "terminal", "cable", "motor", "pump", "valve", "controller")
DOC_TYPES = {
    "bank_statement": ("รายการเดินบัญชี", "statement", "ยอดคงเหลือ", "เลขที่บัญชี", "account no", "withdrawal", "deposit", "balance"),
    "invoice": ("invoice", "ใบแจ้งหนี้", "ใบวางบิล", "invoice no", "เลขที่ใบแจ้งหนี้"),
    "receipt": ("receipt", "ใบเสร็จ", "ใบเสร็จรับเงิน", "receipt no"),
    "contract": ("contract", "agreement", "สัญญา", "ข้อตกลง", "mou"),
    "manual": ("manual", "handbook", "guide", "คู่มือ", "instruction"),
    "qna": ("ถาม:", "ตอบ:", "คำถาม", "เฉลย", "question", "answer"),
}
QNA_HINTS = ("ถาม:", "คำถาม", "ข้อที่", "จงตอบ", "เลือกคำตอบ", "question")
EXAM = ("exam", "test", "quiz", "ข้อสอบ", "แบบฝึกหัด")
SECTIONS = (
    ("summary", ("summary", "สรุป", "overview", "executive summary", "บทคัดย่อ", "abstract")),
    ("transactions", ("รายการเดินบัญชี", "statement", "movement", "invoice", "receipt", "ใบแจ้งหนี้", "ใบเสร็จ", "tax form")),
    ("legal_section", ("contract", "agreement", "สัญญา", "ข้อตกลง", "mou", "official", "ประกาศ", "ระเบียบ", "gazette")),
    ("work_section", ("resume", "cv", "curriculum vitae", "ประวัติ", "minutes", "บันทึกการประชุม", "agenda", "วาระ")),
    ("instruction_section", ("manual", "guide", "handbook", "คู่มือ", "instruction", "methodology", "introduction")),
    ("footer", ("ลงชื่อ", "ผู้มีอำนาจลงนาม", "ขอแสดงความนับถือ", "signature")),
)
HEADERS = (
    (("date", "วันที่", "วันเดือนปี"), "date"),
    (("description", "รายการ", "details"), "description"),
    (("withdrawal", "debit", "จ่าย"), "amount_out"),
    (("deposit", "credit", "รับ"), "amount_in"),
    (("balance", "คงเหลือ"), "balance"),
    (("amount", "จำนวนเงิน"), "amount"),
    (("qty", "จำนวน"), "quantity"),
    (("unit", "หน่วย"), "unit"),
    (("price", "ราคา"), "unit_price"),
)
# Roles of text blocks in the order in which they are tried: what the text (as is, in lower case, or without blanks at its
# beginning) holds, or a rule of ``text_role``.
TEXT_ROLES = (
    ("qna_question", (("bare", ("ถาม:",)), ("text", ("คำถาม",)), ("lower", ("question",)))),
    ("qna_answer", (("bare", ("ตอบ:",)), ("text", ("เฉลย",)), ("lower", ("answer",)))),
    ("qna_question", (("rule", "short question"),)),
    ("title", (("rule", "title"),)),
    ("account_info", (("lower", ("เลขที่บัญชี", "account no", "bank")),)),
    ("transaction_header", (("lower", ("วันที่", "date", "amount", "balance", "คงเหลือ")),)),
    ("transaction_row", (("rule", "row"),)),
    ("legal_clause", (("lower", ("ข้อที่", "article", "clause", "section", "มาตรา")), ("rule", "numbered clause"))),
    ("warning_note", (("lower", ("คำเตือน", "warning", "caution", "ข้อควรระวัง", "note:", "หมายเหตุ")),)),
    ("instruction_step", (("lower", ("ขั้นตอนที่", "step", "method", "วิธีทำ")),)),
    ("note", (("lower", ("หมายเหตุ", "remark")),)),
    ("footer_text", (("lower", ("ลงชื่อ", "signature")),)),
)
PLANNER = "และ|กับ|เทียบ|เปรียบเทียบ|ต่างกัน|ทั้ง.+และ|มีอะไรบ้าง|กี่ประเภท|vs|and|compare|both|multiple"
LEVEL_WORDS = (("error", "error|exception|traceback|fail"), ("warning", "warn"), ("debug", "debug"))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once; expressions outside generated code would repeat it."""
    return F.transform(F.array(value), f)[0]


def matches(col: Column, pattern: str) -> Column:
    """``col.rlike(pattern)`` for a group of alternatives, plain words by substring search, which is many times cheaper; an
    alternative with blanks in it only where its first word stands."""
    out = F.lit(False)
    for word in pattern.removeprefix("(?:").removesuffix(")").split("|"):
        head = re.split(r"\\s", word)[0]
        if not re.search(r"[\\().\[\]*+?^$]", head) and head:
            out = out | (col.contains(head) if head == word else col.contains(head) & col.rlike(word))
        else:
            out = out | col.rlike(word)
    return out


def contains_any(col: Column, words: Iterable[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | col.contains(w)
    return out


def first_of(rules: Iterable[tuple[Column, str]], default: str | None) -> Column:
    out = None
    for cond, label in rules:
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(F.lit(default))


def _combined(text: Column, section: Column) -> Column:
    return F.lower(F.concat(F.coalesce(text, F.lit("")), F.lit(" "), F.coalesce(section, F.lit(""))))


def intents(text: Column, section: Column, most: int = 5) -> Column:
    """Matching intents, highest score first, in declared order among equals; ``general`` for none."""
    ordered = sorted(INTENTS.items(), key=lambda x: -x[1][1])
    hit = let(_combined(text, section), lambda t: F.array_compact(F.array(*(F.when(matches(t, p), F.lit(n)) for n, (p, _s, _q) in ordered))))
    return let(hit, lambda h: F.when(F.size(h) == 0, F.array(F.lit(GENERAL[0]))).otherwise(F.slice(h, 1, most)))


def primary_intent(names: Column) -> Column:
    """The intent of the highest priority; the later name among equals."""
    prio = F.create_map(*(F.lit(x) for n, (_p, _s, q) in INTENTS.items() for x in (n, q)), F.lit(GENERAL[0]), F.lit(GENERAL[1]))
    ranked = F.transform(names, lambda n: F.struct(F.coalesce(F.try_element_at(prio, n), F.lit(0)).alias("p"), n.alias("n")))
    return F.coalesce(F.array_max(ranked)["n"], F.lit(GENERAL[0]))


def answer_scope(text: Column, section: Column) -> Column:
    t = _combined(text, section)
    return first_of(((matches(t, p), n) for n, p in SCOPES), "general")


def entities(text: Column, section: Column, most: int = 10) -> Column:
    """Money, years and titled Thai names of the first 5000 characters, distinct and sorted. Any blank of Unicode separates,
    a no-break one becomes a plain one; digits are 0 to 9."""
    t = F.substring(F.replace(_combined(text, section), F.lit("\u00a0"), F.lit(" ")), 1, 5000)
    found = lambda pattern, group: F.regexp_extract_all(t, F.lit(pattern.replace(r"\s", r"[\s\p{Z}]")), F.lit(group))
    money, years, names = found(MONEY, 0), found(YEAR, 1), found(THAI_NAME, 0)
    return F.slice(F.array_sort(F.array_distinct(F.concat(money, years, names))), 1, most)


def query_intent(query: Column) -> Column:
    """The intent of the highest score; the first declared among equals; null for none."""
    q = F.lower(query)
    rules = [(matches(q, p) | matches(q, QUERY_MORE[n]) if n in QUERY_MORE else matches(q, p), n, s) for n, (p, s, _q) in INTENTS.items()]
    return first_of(((c, n) for c, n, _s in sorted(rules, key=lambda r: -r[2])), None)


def block_type(text: Column) -> Column:
    up = F.upper(text)
    return first_of(
        (
            (up.rlike(r"^(WARNING|CAUTION|DANGER|คำเตือน|ข้อควรระวัง)[:\s]"), "warning"),
            (up.rlike(r"^(NOTE|NOTICE|IMPORTANT|หมายเหตุ|สำคัญ|ข้อสังเกต)[:\s]"), "note"),
            (text.rlike(r"(?i)^(\d+\.|Step\s+\d+|ขั้นตอนที่\s+\d+|[A-Z]\.)\s"), "step"),
        ),
        "normal",
    )


def scope_of_block(kind: Column) -> Column:
    return first_of(((kind == "step", "procedure"), (kind == "warning", "warning"), (kind == "note", "note")), "general")


def layout_intents(text: Column, section: Column) -> Column:
    return let(_combined(text, section), lambda t: F.array_compact(F.array(*(F.when(contains_any(t, w), F.lit(n)) for n, w in LAYOUT_INTENTS.items()))))


def layout_entities(text: Column) -> Column:
    return let(F.lower(text), lambda t: F.array_compact(F.array(*(F.when(t.contains(w), F.lit(w)) for w in LAYOUT_ENTITIES))))


def document_type(text: Column) -> Column:
    """The type with most keywords; the first declared among equals; ``generic`` for none."""
    t = F.lower(text)
    scores = {n: sum((t.contains(w).cast("int") for w in words[1:]), t.contains(words[0]).cast("int")) for n, words in DOC_TYPES.items()}
    best = F.greatest(*scores.values())
    return F.when(best > 0, first_of(((s == best, n) for n, s in scores.items()), None)).otherwise("generic")


def section_rule(text: Column, heading: Column, index: Column, page: Column) -> Column:
    """The section by ordered rules; ``index`` counts the document's blocks from 0."""
    text = strip(text)
    low = F.lower(text)
    head = (heading & ((index < 10) | (F.coalesce(page, F.lit(0)) <= 2))) | ((index == 0) & (F.length(text) <= 120))
    qna = contains_any(F.replace(text, F.lit(" "), F.lit("")), QNA_HINTS) | contains_any(low, EXAM)
    return first_of(((qna, "qna"), (head, "header"), *((contains_any(low, w), n) for n, w in SECTIONS)), "other")


def text_role(text: Column, section: Column, heading: Column) -> Column:
    """The role of a text block by ordered rules; ``section`` is the tag in extra."""
    text = strip(text)
    parts = {"text": text, "lower": F.lower(text), "bare": F.replace(text, F.lit(" "), F.lit(""))}
    n, sec = F.length(text), F.coalesce(section, F.lit(""))
    more = {
        "short question": text.contains("?") & (n < 200), "title": (sec == "header") & (heading | (n < 120)), "row": (sec == "transactions") & n.between(10, 200),
        "numbered clause": (sec == "legal_section") & text.rlike(r"^[0-9]+\."),
    }

    def holds(rule: tuple) -> Column:
        out = F.lit(False)
        for where, words in rule:
            out = out | (more[words] if where == "rule" else parts["bare"].startswith(words[0]) if where == "bare" else contains_any(parts[where], words))
        return out

    return first_of(((holds(rule), role) for role, rule in TEXT_ROLES), "other")


def header_name(header: Column) -> Column:
    """The canonical name of a table header; the header itself, lower case, if no key is part of it."""
    h = F.trim(F.lower(header))
    out = None
    for keys, name in HEADERS:
        for k in keys:
            out = F.when(h.contains(k), name) if out is None else out.when(h.contains(k), name)
    return out.otherwise(h)


def table_role(columns: Column) -> Column:
    joined = F.lower(F.array_join(columns, " "))
    money = contains_any(joined, ("amount", "ยอด", "debit", "credit", "balance", "price"))
    return first_of(((contains_any(joined, ("date", "วันที่")) & money, "transaction_table"), (contains_any(joined, ("summary", "สรุป", "total", "รวม")), "summary_table")), "other_table")


def needs_planning(query: Column, least: int = 15) -> Column:
    return (F.length(F.trim(query)) >= least) & F.lower(query).rlike(PLANNER)


def log_level(line: Column) -> Column:
    low = F.lower(line)
    return first_of(((low.rlike(p), n) for n, p in LEVEL_WORDS), "info")


def grade(percent: Column) -> Column:
    return first_of(((percent >= 80, "excellent"), (percent >= 70, "good"), (percent >= 50, "fair")), "poor")

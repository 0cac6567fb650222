import re

import pytest

from folioforge.llm.pii import Lexicon, aligned, check_digit, fitted, found, redact, redact_cells, redacted_tables, redacted_texts, text_items, train

NAMES = [(a + b, "given", "latin") for a in ("Kal", "Ros", "Tam", "Vel") for b in ("dric", "wyn", "ira")] + [(a + b, "family", "latin") for a in ("Thor", "Wex", "Dun") for b in ("berg", "more", "low")]
NAMES += [("กานดา", "given", "thai"), ("ใจงาม", "family", "thai")]


@pytest.fixture(scope="module")
def model():
    lex = Lexicon(NAMES)
    return lex, train(["Witness Kaldric Thorberg was present."], lex)


def valid(d12):
    return d12 + next(c for c in "0123456789" if check_digit(d12 + c))


def test_types(model):
    good = valid("912345678901")
    bad = good[:12] + str((int(good[12]) + 1) % 10)
    cases = {
        "Write to a.b@c.example now": ["email"], "to a_b [at] c [dot] test": ["email"], "quoted @ 26.50 per carton": [],
        "Call 089-000-4901 today": ["phone"], "Order 0857-8462 was closed": [], f"ID no. {good}": ["id_number"], f"Reference {bad} belongs": [],
        "holder of Passport\nXZ 8320210 signed": ["id_number"], "lives at Flat 2B, 38 Quill St., Elmsgate 99619.": ["address"], "The branch on Quill Road was closed": [],
        "Witness Kaldric Thorberg was present": ["person_name"], "Mr. Anyone asked": ["person_name"], "Turn left at Wexmore Street": [], "The Tamwyn pump and": [], "Thorberg Metering sent": [],
        "ผู้ติดต่อ นางสาว กานดา ใจงาม แล้ว": ["person_name"], "[EMAIL] and [PHONE]": [], "": [],
    }
    for text, kinds in cases.items():
        assert redact(text, *model)[1] == kinds, text


def test_rest_unchanged(model):
    assert redact("Say: ａ.ｂ@c.example – ok", *model)[0] == "Say: [EMAIL] – ok"
    plain, at = aligned("a​b ｃ")
    assert plain == "ab c" and len(at) == 5
    text = "nothing here ⚠️ " * 400
    assert redact(text, *model) == (text, [])


def test_frames(spark):
    lexicon = spark.createDataFrame(NAMES, "name string, kind string, script string")
    blocks = spark.createDataFrame([("b1", "mail a@b.test", 1), ("b1", "mail a@b.test", 1), ("b2", None, 1), ("b3", "", 1)], "id string, content string, redacted int")
    tables = spark.createDataFrame([("t1", [["Mr. Anyone", None], ["x", "a@b.test"]]), ("t2", None), ("t3", [])], "id string, rows array<array<string>>")
    got = {tuple(r) for r in found(text_items(blocks, tables), lexicon).collect()}
    assert got == {("block", "b1", "email"), ("table", "t1", "person_name"), ("table", "t1", "email")}
    assert {(r.id, r.redacted) for r in redacted_texts(blocks, lexicon).collect()} == {("b1", "mail [EMAIL]"), ("b2", None), ("b3", "")}
    assert {r.id: r.redacted for r in redacted_tables(tables, lexicon).collect()} == {"t1": [["[PERSON_NAME]", None], ["x", "[EMAIL]"]], "t2": None, "t3": []}
    assert found(text_items(blocks.limit(0), tables.limit(0)), lexicon).count() == 0


def test_redacted_as_found(spark):
    """One fit: what is found in a table is redacted in it, also over two cells and with its neighbours as context."""
    lexicon = spark.createDataFrame(NAMES, "name string, kind string, script string")
    rows = {"t1": [["Contact", "Kaldric Thorberg"], ["Call", "089-000-4901"]], "t2": [["Mail", "a@b.test", None], None, ["", "quoted @ 26.50"]], "t3": [["none"]]}
    tables = spark.createDataFrame(list(rows.items()), "id string, rows array<array<string>>")
    blocks = spark.createDataFrame([("b1", "Witness Kaldric Thorberg was present."), ("b2", "Order 0857-8462 was closed")], "id string, content string")
    items = text_items(blocks, tables)
    model = fitted(items.select("text"), lexicon)
    kinds = {}
    for r in found(items, lexicon, model).collect():
        kinds.setdefault(r.item_id, set()).add(f"[{r.pii_type.upper()}]")
    out = {r.id: " ".join(c for x in r.redacted if x is not None for c in x if c is not None) for r in redacted_tables(tables, lexicon, model).collect()}
    out |= {r.id: r.redacted for r in redacted_texts(blocks, lexicon, model).collect()}
    assert {i: set(re.findall(r"\[[A-Z_]+\]", t)) for i, t in out.items() if "[" in t} == kinds
    assert {"t1", "t2", "b1"} == set(kinds)
    assert all(0 <= m.lesion <= 1 for m in model[1].values())


def test_span_over_cells(model):
    got = redact_cells([["Mr.", "Kaldric Thorberg"], None, [None, "x"]], *model)
    assert got[1] is None and got[2] == [None, "x"] and "[PERSON_NAME]" in "".join(got[0]) and "Thorberg" not in "".join(got[0])

from pyspark.sql import functions as F

from folioforge.functions import classify as C
from folioforge.functions import models as L
from folioforge.functions import text as X


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_text(spark):
    t = lambda v, f, kind="string": one(spark, v, f, kind)
    assert t("  My Doc: (1) ", X.sanitize_id) == "my_doc_1" and t("!!", X.document_id) == "unknown_doc"
    assert t("/a/b c-d.tar.gz", X.file_stem_id) == "b_c_d.tar"
    assert t("​a  b c\n\n\n\nd ", X.normalize_whitespace) == "a b c\n\nd"
    assert t("ก า ร ทำ  x y", X.thai_spacing) == "การทำ x y" and t("การ\nทำ a\nb", X.thai_one_line) == "การทำ a b"
    assert t("1.2. Title  here", X.section_title) == "Title here"
    assert t("x" * 60, X.display_section) == "x" * 47 + "..." and t("  ", X.display_section) == "General"
    assert t("<tr>1</tr><tr>2</tr>", lambda c: X.truncate_html(c, 14)) == "<tr>1</tr>"
    assert t("<th> <b>A</b></th><td>x</td><TH>B</TH>", X.html_headers) == "A B"
    assert t(None, X.normalize_whitespace) is None and t("", X.printable) == ""


def test_numbers(spark):
    t = lambda v, f: one(spark, v, f)
    got = [t(v, X.amount) for v in ("1,234.50", "(500)", "฿ 20", "5d", "", None, "1e3", "-")]
    assert got == [1234.5, -500.0, 20.0, None, None, None, 1000.0, None]
    assert t("งวดที่สิบเอ็ด", X.number_words) == "งวดที่11"
    assert t("ปี 2569 and 2026, 12345", lambda c: X.shift_years(c, -543)) == "ปี 2026 and 2026, 12345"
    assert t("ปี ๒๕๖๙", X.query_variants)[:3] == ["ปี ๒๕๖๙", "ปี 2569", "ปี 2026"]
    assert [one(spark, v, X.usd, "double") for v in (None, 0.001, 0.5, 12.345)] == ["$0.00", "$0.00100", "$0.5000", "$12.35"] or one(spark, 12.345, X.usd, "double") in ("$12.35", "$12.34")


def test_context_and_json(spark):
    t = lambda v, f: one(spark, v, f)
    assert t("[Doc: a]\nsum\n\nbody\n\nmore", X.strip_context) == "body\n\nmore" and t("plain\n\nx", X.strip_context) == "plain\n\nx"
    assert t("```json\n{\"k\": 3}\n``` ok", lambda c: X.lenient_json(c, "k int")).k == 3
    assert t("no json", lambda c: X.lenient_json(c, "k int")) is None
    assert t("Bearer abc", X.bearer) == "abc" and t("abc", X.bearer) is None


def test_rules(spark):
    t = lambda v, f: one(spark, v, f)
    none = F.lit(None).cast("string")
    assert t("How to fix an error", lambda c: C.intents(c, none)) == ["troubleshooting", "installation"]
    assert t("x", lambda c: C.primary_intent(F.array(F.lit("safety"), F.lit("troubleshooting")))) == "troubleshooting"
    assert t("x", lambda c: C.primary_intent(F.array(F.lit("financial"), F.lit("identity")))) == "identity"
    assert t("ราคา 1,200 บาท ปี 2569", lambda c: C.entities(c, none)) == ["1,200 บาท", "2569"]
    assert t("ใครจ่าย", C.query_intent) == "identity" and t("zzz", C.query_intent) is None
    assert [t(v, C.block_type) for v in ("Warning: hot", "NOTE: x", "2. go", "hi")] == ["warning", "note", "step", "normal"]
    assert t("an invoice no 3 with a receipt", C.document_type) == "invoice" and t("", C.document_type) == "generic"
    assert [t(v, C.header_name) for v in ("Unit Price", "update", "รายการ", "Foo ")] == ["unit", "date", "description", "foo"]
    assert t("short and", C.needs_planning) is False and t("compare the two plans", C.needs_planning) is True


def test_model_boundaries(spark):
    df = spark.createDataFrame([("a",), (None,), ("bbb",)], "x string")
    assert [r.y for r in df.select(L.scored(F.col("x"), lambda: lambda v: [float(len(s)) for s in v]).alias("y")).collect()] == [1.0, 0.0, 3.0]

    def broken():
        raise OSError("no model")

    assert {r.y for r in df.select(L.scored(F.col("x"), broken, 0.5).alias("y")).collect()} == {0.5}
    v = df.select(L.embedded(F.col("x"), lambda: lambda t: [[3.0, 4.0] for _ in t]).alias("y")).first().y
    assert abs(v[0] - 0.6) < 1e-6
    got = [one(spark, r, L.verdict) for r in ('{"verdict": "No"}', "partial, because", "maybe", "", None)]
    assert got == ["no", "partial", "yes", "yes", "yes"]
    assert one(spark, "1: header\nx\n2: nonsense\n3: footer", lambda c: L.labels(c, ["header", "footer"])) == {1: "header", 3: "footer"}

import pytest
from pyspark.sql import functions as F

from folioforge.functions import models as L
from folioforge.functions import text as X
from folioforge.operators import accounts as A
from folioforge.operators import blocks as B
from folioforge.operators import evaluation as E
from folioforge.operators import intake as I
from folioforge.operators import tables as T
from folioforge.operators import telemetry as M
from folioforge.operators.validation import validate


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_layout(spark):
    line = lambda size, *texts: ([(t, size) for t in texts],)
    page = [
        (0, [0.0, 10.0, 9.0, 20.0], [line(9.0, "Running header")]), (0, [0.0, 100.0, 9.0, 110.0], [line(20.0, " 1. Scope ", "")]), (1, None, None),
        (0, [0.0, 200.0, 9.0, 210.0], [line(10.0, "first line"), line(10.0, "second line")]), (0, None, [line(10.0, "-")]), (0, None, []),
    ]
    rows = [("d", 1, page), ("d", 2, [(0, None, [line(10.0, "Warning: hot")])]), ("e", 1, [])]
    got = I.layout_blocks(spark.createDataFrame(rows, I.LAYOUT)).orderBy("doc_id", "id").collect()
    assert [(r.id, r.content, r.section, r.heading_level, r.block_type) for r in got] == [
        ("txt_0001", "1. Scope", "Scope", "H1", "heading"), ("txt_0002", "first line second line", "Scope", None, "normal"), ("txt_0003", "Warning: hot", "Scope", None, "warning"),
    ]
    assert I.layout_blocks(spark.createDataFrame([], I.LAYOUT)).count() == 0


def test_recognised_text(spark):
    texts = spark.createDataFrame([("a", "d", 1, "old"), ("b", "e", 1, "kept")], "id string, doc_id string, page int, content string")
    pages = spark.createDataFrame([("d", 1, "new"), ("d", 2, " "), ("e", 1, None)], "doc_id string, page int, content string")
    assert {(r.id, r.content) for r in I.recognised(texts, pages).collect()} == {("ocr_1", "new"), ("b", "kept")}


def test_tables_in(spark):
    schema = "id string, columns array<string>, rows array<array<string>>"
    t = spark.createDataFrame([("t", ["a"], [["-", None], ["x", ""], ["Date", "Sum"], ["1 May", " 5 "], ["", ""]]), ("n", None, None), ("e", [], [])], schema)
    got = {r.id: (r.header, r.rows) for r in I.header_row(t).collect()}
    assert got == {"t": (["Date", "Sum"], [["1 May", "5"]])}
    assert [r.x for r in t.orderBy("id").select(I.is_table(F.col("columns"), F.col("rows")).alias("x")).collect()] == [False, False, False]
    copies = spark.createDataFrame([("d", "b", [["1 "]], "stream"), ("d", "a", [["1"]], "stream"), ("d", "v", [["1"]], "vision"), ("e", "c", [["1"]], "stream")], "doc_id string, id string, rows array<array<string>>, method string")
    assert {(r.doc_id, r.id, r.found) for r in I.first_tables(copies, F.when(F.col("method") == "vision", 0).otherwise(1)).collect()} == {("d", "v", 3), ("e", "c", 1)}
    extra = spark.createDataFrame([("t", None, " Cat ", None, {"summary": " s ", "role": "DATA"}, None, None, None), ("u", "md", None, "r", None, "<p>", "i.png", True)], "id string, markdown string, category string, role string, extra map<string,string>, html_content string, image_path string, is_complex boolean")
    got = {r.id: tuple(r)[1:] for r in I.table_extra(extra).collect()}
    assert got == {"t": ("s", "cat", "", "", "data", None, False), "u": ("", "general", "md", "<p>", "r", "i.png", True)}
    answers = spark.createDataFrame([("q", "A [SHOW_TABLE:CAT= x ] B [SHOW_TABLE:CAT=]C[SHOW_TABLE:CAT=none]"), ("p", "plain"), ("n", None)], "id string, answer string")
    tables = spark.createDataFrame([("q", "x", 2, "d", None, "<t2>"), ("q", "x", 1, "d", "i.png", None), ("q", "y", 0, "d", None, "<t0>")], "id string, category string, rank int, doc_id string, image_path string, html_content string")
    assert {r.id: r.answer for r in T.with_tables(answers, tables).collect()} == {"q": "A <img src='/ingested/d/i.png'> B <t0>C", "p": "plain", "n": None}


def test_images_and_types(spark):
    images = spark.createDataFrame([("i", "d", 0, "a\\b.png", "A warning sign"), ("j", "d", 1, None, " - "), ("k", "d", 1, "x", None)], "id string, doc_id string, page int, file_path string, caption string")
    got = I.image_chunks(images).collect()
    assert [(r.id, r.intents) for r in got] == [("d::image::i", "safety")] and "Path: a/b.png\nPage: ?\n" in got[0].content
    blocks = spark.createDataFrame([("1", "d", 1, "Q: why?"), ("2", "d", 2, "A: so"), ("3", "e", 1, "answer: x"), ("4", "e", 2, "question: y"), ("5", "f", None, "ถาม: ก ตอบ: ข"), ("6", "g", 1, None)], "id string, doc_id string, page int, content string")
    assert {r.doc_id for r in I.qna_documents(blocks).collect()} == {"d", "f"}
    many = spark.createDataFrame([(f"{k:03d}", "d", 1, " " if k == 3 else "x" * 900) for k in range(30)] + [("n", "e", 1, None)], "id string, doc_id string, page int, content string")
    assert {r.doc_id: len(r.preview) for r in I.previews(many).collect()} == {"d": 2702}
    box = one(spark, [0.0, 0.0, 595.0, 421.0], lambda c: I.image_box(c, F.lit(595.0), F.lit(842.0), (100, 200)), "array<double>")
    assert box == [0.0, 100.0, 100.0, 200.0]


def test_markdown(spark):
    schema = "id string, doc_id string, page int, content string, role string, bbox array<double>, extra map<string,string>"
    texts = spark.createDataFrame([("b", "d", None, "low", None, [0.0, 50.0, 1.0, 60.0], {}), ("a", "d", 1, "Top", None, None, {"role": "title"}), ("c", "d", 1, None, None, None, None)], schema)
    got = B.markdown(texts).collect()
    assert len(got) == 1 and got[0].markdown == "\n\n--- \n## 📑 Page 1\n\n\n\n# Top\n\nlow"


def test_models(spark):
    assert one(spark, 'ok ["a", " ", "b", "c", "d"]', L.paraphrases) == ["a", "b", "c"] and one(spark, "none", L.paraphrases) == []
    p = one(spark, 'so {"needs_planning": true, "subqueries": ["x"]} end', L.plan)
    assert p.needs_planning and p.subqueries == ["x"] and not one(spark, "?", L.plan).needs_planning
    assert [one(spark, v, L.judged) for v in ('{"score": 0.7}', "score: 9", "x")] == [0.7, None, None]
    assert one(spark, "a", lambda c: L.replied(c, lambda: (lambda b: [x.upper() for x in b]))) == "A"
    assert one(spark, "a", lambda c: L.replied(c, lambda: 1 / 0, "fallback")) == "fallback"
    docs = spark.createDataFrame([(1, "a", 1, None), (1, "b", 2, None), (2, "c", 1, 0.1), (2, "d", 2, 0.9)], "query_id int, doc_id string, prev_rank int, s double")
    assert [r.doc_id for r in L.reranked(docs, F.col("s"), 1).orderBy("query_id").collect()] == ["a", "d"]
    assert one(spark, "x", lambda c: L.tagged(c, F.lit("good"), F.lit("rule"), ("good",))) == "good"
    assert L.recognition("auto", True) == (False, True) and L.recognition("off", True) == (False, False) and L.recognition("auto", False) == (True, False)
    with pytest.raises(ValueError):
        L.recognition("api", False)
    turns = [("user", str(k)) for k in range(9)] + [("assistant", " ")]
    m = one(spark, turns, lambda c: L.messages(F.lit("sys"), c, F.lit("q")), "array<struct<role:string,content:string>>")
    assert [x.content for x in m] == ["sys", "3", "4", "5", "6", "7", "8", "q"]


def test_strings(spark):
    t = lambda v, f, kind="string": one(spark, v, f, kind)
    assert [t(v, X.section_title) for v in ("2024 report", "1.Intro", "A) Part", "a) part", "1.2) x  y")] == ["2024 report", "Intro", "Part", "a) part", "x y"]
    assert t("<table><tr>1</tr><tr>22</tr></table>", lambda c: X.truncate_html(c, 20)) == "<table><tr>1</tr></table>"
    assert t("<a onclick='x'><SCRIPT a>b</script>", X.sanitize_html) == "<a data-blocked-event='x'>"
    assert t(" a\n<b> & \"c\" ", lambda c: X.log_text(c, 6)) == "a &lt;b&gt; …"
    assert t("ปี 25691234", lambda c: X.shift_years(c, -543)) == "ปี 20261234"
    assert t(["1", "2", "x", "4"], X.safe_box, "array<string>") is None and t(["1", "2", "3.5", "4"], X.safe_box, "array<string>") == [1.0, 2.0, 3.5, 4.0]
    frames = t("event: token\ndata: a\ndata: b\n\ndata: {}\n\n", X.sse_frames)
    assert [(f.event, f.data) for f in frames] == [("token", "a\nb"), ("message", "{}")]
    assert t(" Step ", lambda c: X.normal_enum(c, ("step",), "normal")) == "step" and t("?", lambda c: X.normal_enum(c, ("step",), "normal")) == "normal"


def test_accounts_and_costs(spark):
    users = spark.createDataFrame([(1, "ann"), (2, "bob")], "id long, username string")
    added, rows = A.inserted(users, spark.createDataFrame([("ann", "x"), (" cy ", " "), ("cy", None), ("", "y"), (None, "z")], "username string, email string"))
    assert [tuple(r) for r in added.collect()] == [(3, "cy", None)] and [tuple(r) for r in rows.collect()] == [(3, "hybrid")]
    assert [r.ok for r in spark.createDataFrame([("AÄ", "aÄ"), ("Ä", "ä")], "a string, b string").select(A.same_name(F.col("a"), F.col("b")).alias("ok")).collect()] == [True, False]
    log = spark.createDataFrame([("u", 1.0), (None, 2.0)], "user_id string, cost_usd double")
    assert [M.of_user(log, u).count() for u in ("u", None, "-1", "0")] == [1, 2, 2, 2]
    assert M.scope("u", False, "all") == "u" and M.scope("u", True, "all") is None and M.scope("u", False, "system") is None and M.clamped(99) == 30
    prices = spark.createDataFrame([("m", 1e6, 0.0)], "model string, rate_input_per_m double, rate_output_per_m double")
    calls = spark.createDataFrame([(k, m, 1, 0) for k, m in enumerate(["m", " openai/m", "M", "x/m", None])], "k int, model string, prompt_tokens int, completion_tokens int")
    assert [r.unit_cost for r in M.priced(calls, prices).orderBy("k").collect()] == [1.0, 1.0, 1.0, 0.0, 0.0]
    r = spark.createDataFrame([("q<", 1.0, 0.0)], "question string, recall double, match double")
    assert [x.html for x in E.report_html(r, "Run").collect()] == ["<h1>Run</h1>", "<tr><td>q&lt;</td><td>1.0</td><td>0.0</td></tr>"]


def test_rules_on_bundles(spark):
    meta = spark.createDataFrame([("d", "f", 5)], "doc_id string, file_name string, page_count int")
    text = "id string, doc_id string, page int, content string, section string, role string, bbox array<double>, extra map<string,string>, bundle string"
    texts = spark.createDataFrame([("a", "d", 1, " x　", "s", "r", None, {"section": "s"}, "d"), ("b", "z", 1, "xx", None, None, None, None, "d")], text)
    tables = spark.createDataFrame([("t", "z", 1, "c", None, ["h"], [["1"]], None, {"role": "x"}, "d")], "id string, doc_id string, page int, category string, role string, columns array<string>, rows array<array<string>>, bbox array<double>, extra map<string,string>, bundle string")
    images = spark.createDataFrame([("i", "d", 9, "", "d"), ("j", "d", -1, "p", "d"), ("j", "z", 1, "p", "d")], "id string, doc_id string, page int, file_path string, bundle string")
    got = {(r.item_id, r.code) for r in validate(meta, texts, tables, images).collect()}
    assert {("a", "TEXT_BLOCK_VERY_SHORT"), ("a", "TEXT_NO_ROLE"), ("b", "TEXT_NO_SECTION"), ("b", "TEXT_DOC_ID_MISMATCH"), ("t", "TABLE_DOC_ID_MISMATCH"), ("i", "IMAGE_NO_PATH"), ("i", "IMAGE_PAGE_OUT_OF_RANGE"), ("j", "IMAGE_PAGE_INVALID"), ("j", "IMAGE_DOC_ID_MISMATCH"), ("j", "DUPLICATE_IMAGE_ID")} <= got
    assert not {("a", "TEXT_NO_SECTION"), ("t", "TABLE_NO_ROLE"), ("a", "TEXT_DOC_ID_MISMATCH")} & got and (None, "PAGE_COUNT_MISMATCH") in got

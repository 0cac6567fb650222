import random

from pyspark.sql import functions as F

from folioforge.operators import blocks as B
from folioforge.operators import evaluation as E
from folioforge.operators import retrieval as R
from folioforge.operators import store as S
from folioforge.operators import tables as T
from folioforge.operators import telemetry as M
from folioforge.operators.validation import validate

BLOCK = "id string, doc_id string, page int, content string, section string, role string, bbox array<double>, extra map<string,string>"


def block(i, text, page=1, section="s", doc="d", role=None, box=None, **extra):
    return (f"b{i:03d}", doc, page, text, section, role, box, {k: str(v) for k, v in extra.items()})


def test_carry_crosses_pages(spark):
    rows = [block(0, "Head", extra_=1, is_heading="true"), block(1, "a"), block(2, "b", page=3), block(3, "1. ", page=3, is_heading="true"), block(4, "c", page=4), block(5, "x", doc="e")]
    got = {r.id: r.filled_section for r in B.filled_sections(spark.createDataFrame(rows, BLOCK)).collect()}
    assert got == {"b000": "Head", "b001": "Head", "b002": "Head", "b003": "1." if got["b003"] == "1." else "Head", "b004": got["b003"], "b005": None}
    assert {r.id: r.pos for r in B.positions(spark.createDataFrame(rows, BLOCK)).collect()} == {"b000": 0, "b001": 1, "b002": 2, "b003": 3, "b004": 4, "b005": 0}


def test_merge(spark):
    rows = [
        block(0, "one", box=[0.0, 0.0, 9.0, 10.0], block_type="normal", font_size=11), block(1, "two", box=[0.0, 20.0, 9.0, 30.0], block_type="normal", font_size=11),
        block(2, "far", box=[0.0, 60.0, 9.0, 70.0], block_type="normal", font_size=11), block(3, "1. a", box=[0.0, 99.0, 9.0, 100.0], block_type="step"), block(4, "2. b", box=[0.0, 300.0, 9.0, 310.0], block_type="step"),
    ]
    got = [(r.content, r.kind) for r in B.merged(spark.createDataFrame(rows, BLOCK)).orderBy("id").collect()]
    assert got == [("one two", "normal"), ("far", "normal"), ("1. a\n2. b", "step_sequence")]


def chunk_ids(spark, rows):
    return sorted(tuple(r.block_ids) for r in B.chunk_groups(spark.createDataFrame(rows, BLOCK)).collect())


def test_chunking(spark):
    assert chunk_ids(spark, [block(0, "x" * 700), block(1, "y" * 400), block(2, "z" * 200)]) == [("b000", "b001"), ("b002",)]
    assert chunk_ids(spark, [block(0, "x" * 1000), block(1, "y" * 100), block(2, "z" * 101)]) == [("b000", "b001"), ("b001", "b002")]
    assert chunk_ids(spark, [block(0, "an error here"), block(1, "plain words")])[0] == ("b000",)
    assert chunk_ids(spark, [block(0, "w" * 200), block(1, "Q: why", page=2), block(2, "v" * 200, section="t", page=2)]) == [("b000",), ("b001",), ("b001", "b002")]
    assert chunk_ids(spark, []) == []


def test_chunking_cut_into_segments_equals_one_fold(spark):
    rng = random.Random(7)
    rows = [block(k, rng.choice(["word ", "error ", "Q: ", "บาท "]) * rng.randrange(1, 60), page=k // 5 + 1, section=rng.choice("ab"), heading_level=rng.choice(["H1", "", ""])) for k in range(150)]
    frame = spark.createDataFrame(rows, BLOCK)
    from folioforge.functions import classify as C
    from folioforge.functions.text import meaningful_words, normalize_whitespace

    t = normalize_whitespace(F.col("content"))
    names = C.intents(t, F.col("section"))
    flat = [r.asDict() for r in frame.select("doc_id", "page", "id", "section", F.length(t).alias("size"), F.length("content").alias("raw"), (F.col("extra")["heading_level"] == "H1").alias("h1"), t.rlike(C.QNA_BREAK).alias("qna"), names.alias("intents"), C.primary_intent(names).alias("primary")).where(meaningful_words(t)).orderBy("page", "id").collect()]
    whole = sorted(tuple(x[2]) for x in B._chunk(flat))
    assert chunk_ids(spark, rows) == whole


def test_tables(spark):
    cols, rows = ["Date", "Qty", "Unit Price", "Qty"], [["1 May", "2", "(3)", "4"], ["", "", "", ""], ["2 May", "5"]]
    df = spark.createDataFrame([("t", cols, rows), ("e", [], []), ("n", None, None)], "id string, columns array<string>, rows array<array<string>>")
    got = T.transactions(df).orderBy("row_no").collect()
    assert [(r.date_raw, r.amount) for r in got] == [("1 May", None), ("2 May", None)]
    md = df.where("id = 't'").select(T.to_markdown(F.col("columns"), F.col("rows")).alias("m")).first().m
    assert md.split("\n")[-1] == "| 2 May | 5 |  |  |"
    h = df.where("id = 't'").select(T.inferred_header(F.array().cast("array<string>"), F.col("rows")).alias("x")).first().x
    assert h.columns is not None and len(h.rows) in (2, 3)


def test_html():
    assert T.parse_html("<table><tr><th>A</th><th>B</th></tr><tr><td>1</td></tr></table>") == (["A", "B"], [["1", ""]], False, False)
    assert T.parse_html("<table><tr><td>A</td></tr><tr><td rowspan=2>1</td></tr></table>")[:3] == ([], [], True)
    assert T.parse_html("<tr><td>only</td></tr>")[:2] == ([], []) and T.parse_html("") == ([], [], False, False)
    assert T.parse_html("<tr><th colspan='2'>A</th></tr><tr><td>x &amp; y</td></tr>") == (["A"], [["x & y"]], False, True)


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red dog"), (3, None), (4, ""), (5, "blue cat sat"), (6, "green owl sat here")], "doc_id long, text string")
    got = R.bm25(docs, [(1, "dog fox")]).collect()
    assert {r.doc_id for r in got} == {1, 2} and [r.rank for r in sorted(got, key=lambda r: r.rank)] == [1, 2]
    assert R.bm25(docs, [(1, "nowhere")]).count() == 0
    a = spark.createDataFrame([(1, 1), (2, 2)], "doc_id long, rank int")
    b = spark.createDataFrame([(2, 1), (3, 2)], "doc_id long, rank int")
    assert [r.doc_id for r in R.rrf(a, b).orderBy("rank").collect()] == [2, 1, 3]
    s = spark.createDataFrame([(1, 0.01, ["x"], 1), (2, 0.02, [], 2)], "doc_id long, score double, intents array<string>, prev_rank int")
    assert [r.doc_id for r in R.threshold_boost(s, "x").orderBy(F.desc("final")).collect()] == [1, 2]


def test_telemetry(spark):
    log = spark.createDataFrame([(1, "2024-01-01 10:00:00", "Ask", None, "m", 1.0, "u"), (2, "2024-01-02 11:00:00", "ask", "p", None, None, None)], "line_no long, ts string, endpoint string, provider string, model string, cost_usd double, user_id string").withColumn("ts", F.to_timestamp("ts"))
    got = {(r.dimension, r.key): (r.calls, r.cost) for r in M.grouping_sets(log).collect()}
    assert got[("total", "all")] == (2, 1.0) and got[("endpoint", "ask")] == (2, 1.0) and got[("provider", "unknown")] == (1, 1.0)
    assert [r.line_no for r in M.last_days(log, 1).collect()] == [2]
    for n in (0, 1, 2, 20):
        vals = spark.createDataFrame([("k", float(v)) for v in range(1, n + 1)], "by string, v double")
        want = None if n < 2 else float(sorted(range(1, n + 1))[max(1, int(n * 0.95)) - 1])
        rows = M.p95_distributed(vals, "by", "v").collect()
        assert (rows[0].p95 if rows else None) == want
        assert vals.agg(M.p95("v").alias("x")).first().x == want


def test_store_validation_eval(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "id string, v int")
    once = S.upsert(old, new)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, S.upsert(once, new).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    files = spark.createDataFrame([("x", "metadata.json"), ("x", "text.json"), ("x", "table_clean.json"), ("x", "image.json"), ("y", "text.json")], "doc_id string, name string")
    assert {r.doc_id: r.complete for r in S.completeness(files).collect()} == {"x": True, "y": False}
    meta = spark.createDataFrame([("d", "f", 1), ("e", "", None)], "doc_id string, file_name string, page_count int")
    texts = spark.createDataFrame([block(1, "x", page=9), block(1, "x", page=9)], BLOCK)
    tables = spark.createDataFrame([], "id string, doc_id string, page int, category string, role string, columns array<string>, rows array<array<string>>, bbox array<double>")
    codes = {r.code for r in validate(meta, texts, tables).collect()}
    assert {"PAGE_COUNT_MISMATCH", "MISSING_FILE_NAME", "NO_TEXT_BLOCKS", "DUPLICATE_TEXT_ID", "TEXT_PAGE_OUT_OF_RANGE", "TEXT_BLOCK_VERY_SHORT", "TEXT_NO_ROLE"} <= codes
    r = spark.createDataFrame([("The cat", ["cat", "dog"]), (None, [])], "a string, k array<string>").select(E.keyword_recall(F.col("a"), F.col("k")).alias("x")).collect()
    assert [v.x for v in r] == [0.5, 1.0]


def test_leading_rows_of_a_hot_document(spark):
    rng = random.Random(5)
    rows = [(f"d{k % 3 and 1}", f"{k:04d}", "x" * rng.choice([0, 1, 40, 300])) for k in range(900)] + [("n", "0", None)]
    got = {(r.doc, r.id) for r in B.leading(spark.createDataFrame(rows, "doc string, id string, t string"), "doc", "id", F.length("t"), 900, 7).collect()}
    want = set()
    for d in {r[0] for r in rows}:
        before = 0
        for _, i, t in sorted((r for r in rows if r[0] == d), key=lambda r: r[1]):
            if before < 900:
                want.add((d, i))
            before += len(t or "")
    assert got == want

from folioforge.llm import scans
from folioforge.llm.scans import defects, number, observed, skeleton


def _doc(spark):
    rows, ident = [], 0
    native = "The secretary shall return the quarterly deposit and the modern garden of the read-only cabinet for the transfer"
    for k in range(8):
        rows.append((f"n{k}", "native", 1, native, {"extractor": "native"}))
    heads = ["Annual report of the garden", "Annual rep0rt of the garden", "ANNUAL REPORT OF THE GARDEN", "Annual report of the garden"]
    for page, head in enumerate(heads, 1):
        body = {1: "The secretary shall ret-\nurn the deposit", 2: "The read-\nonly cabinet for the transfer", 3: "The modem garden of thc transfer", 4: "See 831\nfor the transfer"}[page]
        rows.append((f"t{ident:03d}", "scan", page, f"{head}\n{body}\nPage {page + 6}", {"extractor": "ocr"}))
        ident += 1
    rows += [rows[-1], ("z0", "scan", None, None, None), ("z1", "scan", 2, "", None), ("z2", "other", None, "x", None)]
    return spark.createDataFrame(rows, "id string, doc_id string, page int, content string, extra map<string,string>")


def test_defects(spark):
    df = _doc(spark)
    got = {(r.block_id, r.defect) for r in defects(df.withColumn("state", df.id)).collect()}
    assert {(f"t{k:03d}", d) for k in range(4) for d in ("header",)} <= got
    # z1 is an empty last block of page 2, so that page's number is not at its edge
    assert {("t000", "page_number"), ("t002", "page_number"), ("t003", "page_number")} <= got
    assert ("t000", "hyphen") in got and ("t001", "hyphen") not in got
    assert ("t002", "misread") in got and ("t001", "misread") not in got
    assert not {d for b, d in got if b.startswith("n")}
    assert defects(df.limit(0)).count() == 0


def test_numbers_and_shapes():
    assert [number(x) for x in ("12", "๑๒", "xiv", "IX", "abc", "")] == [12, 12, 14, 9, 0, 0]
    assert observed("- 7 -")[1:] == (7, True) and observed("Page 3 of 9")[1:] == (3, True)
    a, b = observed("14 | Annual report"), observed("Annual rep0rt    15")
    assert a[0] == b[0] and (a[1], b[1]) == (14, 15)
    assert observed("8,825.00")[1] == 0 and observed("")[1] == 0 and observed("x" * 500) == (0, 0, False)
    assert skeleton("revievved") == skeleton("reviewed") and skeleton("farm") != skeleton("barn")


def test_model():
    at = lambda r, n: r * scans.NUMBER + n
    best = scans.train([(at(2, 0), at(0, 2), 50), (at(0, 0), at(0, 0), 500), (at(0, 2), at(2, 0), 20), (at(0, 1), at(0, 0), 30), (at(2, 3), -1, 5)])
    assert best[at(2, 0), at(0, 2)] == (0, 2) and best[at(0, 0), at(0, 0)] == (3, 3) and best[at(0, 2), at(2, 0)] == (2, 0)
    assert best[at(0, 1), at(0, 0)] == (3, 3) and best[at(2, 3), -1] == (1, -1)


def test_repair(spark):
    got = {r.id: r.repaired for r in scans.repaired(_doc(spark)).collect()}
    assert got["t000"].startswith("The secretary shall return the deposit") and "Annual" not in got["t000"]
    assert got["t001"].startswith("The read-only cabinet") and "modern garden of the transfer" in got["t002"]
    assert got["t003"] == "See 831 for the transfer" and got["z0"] is None and got["n0"].startswith("The secretary")
    assert scans.paragraphs("", set(), set(), {}) == "" and scans.paragraphs("a\n\nb", set(), set(), {}) == "a\nb"


def test_same_repair_whatever_the_number_of_misread_words(spark, monkeypatch):
    rows = _doc(spark).collect()
    rows += [(f"o{k:02d}", "native", 1, rows[0].content, {"extractor": "native"}) for k in range(30)] + [("m1", "scan", 5, "the ｍodem garden\nof the sccre-\ntary and the read-\nonly cabinet", {"extractor": "ocr"}), ("m2", "scan", 6, "a modem gardcn -\nthe depos1t", {"extractor": "ocr"})]
    df = spark.createDataFrame([tuple(r) for r in rows], "id string, doc_id string, page int, content string, extra map<string,string>")
    few = ({r.id: r.repaired for r in scans.repaired(df).collect()}, {tuple(r) for r in defects(df).collect()})
    monkeypatch.setattr(scans, "MISREADS", 0)
    assert few == ({r.id: r.repaired for r in scans.repaired(df).collect()}, {tuple(r) for r in defects(df).collect()})
    assert few[0]["m1"].startswith("the modern garden of the") and "transfer" in few[0]["t002"]


def test_layout():
    text = "A first paragraph whose lines run on\nto the full width of the column and\nend here.\nThe second paragraph starts with this\nline and goes on\n1. a list item\n2. another one"
    want = ["A first paragraph whose lines run on to the full width of the column and end here.", "The second paragraph starts with this line and goes on", "1. a list item", "2. another one"]
    assert scans.paragraphs(text, set(), set(), {}).split("\n") == want
    codes = scans.layout_codes(text.split("\n"))
    model = scans.train_layout(list(zip(codes, codes[1:], [50] * 6)))
    assert scans.paragraphs(text, set(), set(), {}, model).split("\n") == want
    assert scans.breaks([], model) == [] and scans.train_layout([])[0].sum() == 1

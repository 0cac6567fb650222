from pyspark.sql import functions as F

from folioforge.llm import sitelines
from folioforge.llm.sitelines import stock_lines, templates, without_stock_lines

STOCK = "This copy was issued by the counter and may not be forwarded, no. {}."


def _tables(spark):
    blocks = []
    for k in range(6):
        line = STOCK.format(k) if k % 2 else STOCK.format(k).upper().replace(" ", "  ")
        blocks.append((f"b{k}", f"d{k}", f"own words of document {k}\n{line}", k))
        blocks.append((f"b{k}", f"d{k}", f"own words of document {k}\n{line}", k))
    blocks += [("x1", "unlisted", STOCK.format(1), 0), ("x2", "d0", None, 0), ("x3", "d1", "", 0), ("x4", "d0", "Total\nTotal", 0), ("x5", "d1", "Total", 0), ("x6", "d2", "Total", 0)]
    meta = [(f"d{k}", " Scanner" if k % 2 else "scanner ") for k in range(6)] + [("d0", "scanner"), (None, "scanner"), ("d9", None)]
    return spark.createDataFrame(blocks, "id string, doc_id string, content string, removed int"), spark.createDataFrame(meta, "doc_id string, source string")


def test_found(spark):
    b, m = _tables(spark)
    got = {(r.block_id, r.line_no) for r in stock_lines(b, m).collect()}
    assert got == {(f"b{k}", 2) for k in range(6)}
    assert stock_lines(b.limit(0), m).count() == 0
    assert stock_lines(b, m.limit(0)).count() == 0


def test_thresholds(spark):
    b, m = _tables(spark)
    assert stock_lines(b, m, min_docs=7).count() == 0
    assert stock_lines(b.where("doc_id in ('d0', 'd1')"), m).count() == 0


def test_removal(spark):
    b, m = _tables(spark)
    got = {r.id: (r.clean_content, r.removed) for r in without_stock_lines(b, m).collect()}
    assert got["b1"] == ("own words of document 1", 1) and got["x1"][1] == 0 and got["x2"] == (None, 0) and got["x4"][0] == "Total\nTotal"


def test_templates(spark):
    """Lines of one leaf that differ in a slot share a template with a wildcard; only lines that repeat are stock lines."""
    stock, other = "Issued by the county archive for reading alpha only", "Issued by the county archive for reading gamma only"
    rows = [(f"b{k}", f"d{k}", stock if k < 4 else other) for k in range(6)] + [("own", "d0", "An entirely different line of this one document")]
    blocks = spark.createDataFrame(rows, "id string, doc_id string, content string")
    meta = spark.createDataFrame([(f"d{k}", "scanner") for k in range(6)], "doc_id string, source string")
    t = templates(blocks, meta).collect()
    assert len(t) == 1 and t[0].docs == 6 and t[0].lines == 6 and "<*>" in t[0].template and 0 < t[0].fixed < 1
    assert {r.block_id for r in stock_lines(blocks, meta).collect()} == {"b0", "b1", "b2", "b3"}


def test_templates_decide(spark, monkeypatch):
    """Lines of a template without a wildcard are found by the template; only those of others are counted on their own."""
    stock, other, fixed = "Issued by the county archive for reading alpha only", "Issued by the county archive for reading gamma only", "Printed in the reading room, copy {}"
    rows = [(f"b{k}", f"d{k}", f"{stock if k < 4 else other}\n{fixed.format(k)}") for k in range(6)] + [("own", "d0", "An entirely different line of this one document")]
    blocks = spark.createDataFrame(rows, "id string, doc_id string, content string")
    meta = spark.createDataFrame([(f"d{k}", "scanner") for k in range(6)], "doc_id string, source string")
    real, counted = sitelines._covering, {}

    def covering(lines, listed, min_docs, min_share, *keys):
        counted[keys] = lines.count()
        return real(lines, listed, min_docs, min_share, *keys)

    monkeypatch.setattr(sitelines, "_covering", covering)
    found = {(r.block_id, r.line_no) for r in stock_lines(blocks, meta).collect()}
    assert found == {(f"b{k}", 1) for k in range(4)} | {(f"b{k}", 2) for k in range(6)}
    assert counted == {("leaf",): 13, ("own", "rest"): 6}

    def every(lines, listed, min_docs, min_share, *keys):
        return lines.select("source", "leaf", F.lit(1).alias("docs")).distinct() if keys == ("leaf",) else real(lines, listed, min_docs, min_share, *keys)

    monkeypatch.setattr(sitelines, "_covering", every)
    assert {(r.block_id, r.line_no) for r in stock_lines(blocks, meta).collect()} == found | {("own", 1)}

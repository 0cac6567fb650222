import re

from folioforge.functions import classify as C
from folioforge.plans.queries import QUERIES


def test_entity_lists_of_any_text(spark, tmp_path):
    """Every block has a row, whatever its characters; against the patterns run in Python."""
    texts = {
        "plain": "due 2026, 1,200 baht", "dash": "1,200.50\u00a0baht – 1999", "accent": "café 2024\u2009 and 300\u202fbaht", "emoji": "⚠️ 1,000\u3000บาท พ.ศ.\u00a02569", "none": None, "empty": "",
        "name": "คุณ\u00a0สมชาย\u2003ใจดี — 44 ฿", "section": "ok",
    }
    sections = {"none": "year 1987", "section": "12\u00a0baht"}
    schema = "id string, content string, section string"
    spark.createDataFrame([(k, t, sections.get(k)) for k, t in texts.items()], schema).write.parquet(str(tmp_path / "text_blocks.parquet"))
    got = {r.id: r.entities for r in QUERIES["entity_lists"](spark, str(tmp_path)).collect()}

    def brute(k):
        t = f"{texts[k] or ''} 12,500.50 baht {sections.get(k) or ''}".lower().replace("\u00a0", " ")[:5000]
        found = {m.group(g) for p, g in ((C.MONEY, 0), (C.YEAR, 1), (C.THAI_NAME, 0)) for m in re.finditer(p, t)}
        return "|".join(sorted(found)[:10])

    assert got == {k: brute(k) for k in texts}


def test_log_levels_of_all_events(spark, tmp_path):
    """Events of no or little value have a row too."""
    values = {1: None, 2: 0.0, 3: 0.004, 4: 0.5, 5: 1.0, 6: 12.345}
    spark.createDataFrame([(k, "error", v) for k, v in values.items()], "event_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.event_id: (r.level, r.usd) for r in QUERIES["log_levels"](spark, str(tmp_path)).collect()}
    assert {k: u for k, (_l, u) in got.items()} == {1: "$0.00", 2: "$0.00", 3: "$0.00400", 4: "$0.5000", 5: "$1.00", 6: "$12.35"}
    assert {lv for lv, _u in got.values()} == {"error"}

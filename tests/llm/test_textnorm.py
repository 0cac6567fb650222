from pyspark.sql import functions as F

from folioforge.llm.textnorm import canonical, confusable_words, irregular, resolve_token, with_canonical


def test_forms():
    assert canonical("ＴＨＢ ５") == ("THB 5", ["width"])
    assert canonical("ﬁnal")[0] == "final"
    assert canonical("café") == ("café", ["accent"])
    assert canonical("a​b c") == ("ab c", ["invisible", "blank"])
    assert canonical("pаy") == ("pay", ["mixed_script"])
    assert canonical("เเละ นํา") == ("และ นำ", ["split_thai"])


def test_not_cases():
    for s in ("12 m² ½ ™ №", "“q” – —", "ООО Вельтрана", "Δ = 0.4", "⚠️ 👩‍🔧", "line\nbreak", "", "THBบาท"):
        assert canonical(s) == (s, [])


def test_idempotent_and_scripts():
    s = "ρrіmаrу ＴＥＳＴ é ﻿x"
    once = canonical(s)[0]
    assert canonical(once) == (once, [])
    assert resolve_token("сору") == ("сору", "whole")
    assert resolve_token("жz") == ("жz", None)  # no common script
    assert resolve_token("жx") == ("жх", "other")


def test_frame(spark):
    df = spark.createDataFrame([(1, "ok", "x"), (1, "ok", "x"), (2, "ａ", "y"), (3, None, "z"), (4, "", "w"), (5, "b​" * 5000, "v")], "id int, content string, forms string")
    got = {r.id: (r.canonical, r.forms) for r in with_canonical(df, "content").collect()}
    assert got[1] == ("ok", []) and got[2] == ("a", ["width"]) and got[3] == (None, []) and got[4] == ("", []) and got[5][0] == "b" * 5000
    assert sorted(r.id for r in irregular(df, "content").collect()) == [2, 5]
    assert irregular(df.where(F.lit(False)), "content").count() == 0


def test_foreign_letters_in_latin_words():
    """Also letters without an exact look-alike; Latin words stay Latin, other scripts' words stay theirs."""
    for old, new in (("Яeport", "Report"), ("тest", "test"), ("кey", "key")):
        assert canonical(old) == (new, ["mixed_script"])
    assert canonical("москвa") == ("москва", []) and canonical("μmol kWΩ") == ("μmol kWΩ", [])
    assert canonical("𝐛old ᴀbc ɑpple") == ("bold abc apple", ["styled"])


def test_confusable_words(spark):
    df = spark.createDataFrame([("a", "a сору of сору and Вельтрана"), ("b", "plain"), ("c", None), ("d", "")], "id string, content string")
    assert [(r.id, r.words) for r in confusable_words(df, "content").collect()] == [("a", ["сору"])]
    styled = spark.createDataFrame([("a", "𝐛old"), ("b", "pаy")], "id string, content string")
    assert [r.id for r in irregular(styled, "content").collect()] == ["b"]
    assert {r.id: r.canonical for r in with_canonical(styled, "content").collect()} == {"a": "bold", "b": "pay"}

from hypothesis import given, settings
from hypothesis import strategies as st

from folioforge.llm.splitting import split_items, split_text


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. \n1กำเ้", max_size=700), st.integers(20, 120), st.integers(0, 15))
def test_round_trip(text, limit, overlap):
    spans = split_text(text, limit, overlap)
    assert all(0 < b - a <= limit for a, b in spans) or text == ""
    whole, end = "", 0
    for k, (a, b) in enumerate(spans):
        assert a <= end and b >= end
        if k:
            assert end - a >= overlap
        whole += text[end:b]
        end = b
    assert whole == text


def test_natural_boundaries():
    text = "One two three. " * 20 + "\n\n" + "Four five six. " * 20
    for a, b in split_text(text, 200, 20)[:-1]:
        assert text[b - 1].isspace()
    assert len(split_text("x" * 1000, 100, 10)) > 10


def test_frame(spark):
    df = spark.createDataFrame([("a", "x " * 100, 50, 5, 9), ("b", "short", 50, 5, 9), ("c", None, 50, 5, 9), ("d", "", 50, 5, 9)], "id string, content string, max_chars int, overlap_chars int, piece_no int")
    got = split_items(df).collect()
    assert {r.id for r in got} == {"a", "b", "d"}
    a = sorted((r for r in got if r.id == "a"), key=lambda r: r.piece_no)
    assert [r.piece_no for r in a] == list(range(1, len(a) + 1)) and all(len(r.content) <= 50 for r in a)
    assert split_items(df.limit(0)).count() == 0


def test_parts_are_kept_whole_where_they_fit():
    first, second = "a" * 39 + " ", "word " * 18
    text = first + "\n\n" + second + "\n\n" + "tail " * 30
    spans = split_text(text, 100, 0)
    assert any(second.strip() in text[a:b] for a, b in spans)
    for (_, end), (start, _) in zip(spans, spans[1:]):
        assert start == end
    words = "alpha beta gamma delta " * 40
    for (_, end), (start, _) in zip(split_text(words, 120, 30), split_text(words, 120, 30)[1:]):
        assert words[start - 1] == " " and 30 <= end - start <= 54

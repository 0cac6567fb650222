import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioforge.llm import mixing, packing
from folioforge.llm.tokens import encoding


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_best_two_fit(sizes):
    bins = packing.best_two_fit(sizes, 50)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 50 for b in bins)
    assert len(bins) <= max(0, -(-2 * sum(sizes) // 50))


def test_pack(spark):
    rng = random.Random(2)
    items = [(k, rng.randrange(1, 900), "x") for k in range(3000)] + [(9001, 5000, "x"), (9002, None, "x"), (9003, 0, "x"), (None, 5, "x"), (7, 10, "x"), (7, 10, "x")]
    specs = spark.createDataFrame([(1, 1000), (2, 2048)], "spec_id int, capacity_tokens int")
    df = spark.createDataFrame(items, "item_id long, tokens int, container_id string")
    got = packing.pack(df, specs, group=1000).toPandas()
    assert (got.groupby("container_id").tokens.sum() <= got.groupby("container_id").capacity_tokens.first()).all()
    total = sum(t or 0 for i, t, _ in items if i is not None)
    assert got.groupby("spec_id").tokens.sum().tolist() == [total, total]
    big = got[(got.item_id == 9001) & (got.spec_id == 1)].sort_values("piece_no")
    assert big.tokens.tolist() == [1000] * 5 and big.piece_start.tolist() == [0, 1000, 2000, 3000, 4000]
    assert (got[got.item_id < 9000].piece_no == 1).all()
    assert all(r.unused_share < 0.03 for r in packing.unused(packing.pack(df, specs)).collect())
    assert packing.pack(df.limit(0), specs).count() == 0 and packing.pack(df, specs.limit(0)).count() == 0


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE", 300)
    rng = random.Random(3)
    docs = [(k, "Big " if k % 3 else "big", rng.randrange(20, 400)) for k in range(4000)] + [(10_000 + k, "small", rng.randrange(20, 400)) for k in range(300)] + [(20_000, None, 5), (20_001, "other", 5), (20_002, "small", None)]
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 3), ("absent", 0.2, 4)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame(docs, "doc_id long, source string, tokens int")
    mixed, plan = mixing.mix(df, targets)
    shares = {r.source: (r.actual_share, r.share, r.most_copies) for r in mixing.report(mixed, plan).collect()}
    assert abs(shares["big"][0] - 0.625) < 0.01 and abs(shares["small"][0] - 0.375) < 0.01 and shares["small"][2] <= 3
    assert shares["absent"][1] is None and shares["other"][1] is None
    got = mixed.toPandas()
    assert got.virtual_finish.is_monotonic_increasing and not got.duplicated(["doc_id", "copy"]).any()
    half = mixing.report(*mixing.mix(df, targets, budget=20_000)).toPandas()
    assert abs(half.mixed_tokens.sum() - 20_000) < 500
    assert mixing.mix(df.limit(0), targets)[0].count() == 0


def test_tokens_round_trip():
    enc = encoding()
    for s in ("Hello  world\n", "ใบแจ้งหนี้ 12", ""):
        assert enc.decode(enc.encode_ordinary(s)) == s


def test_budget_that_cannot_be_kept(spark):
    df = spark.createDataFrame([(k, "a" if k % 2 else "b", 10) for k in range(100)], "doc_id long, source string, tokens int")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    with pytest.warns(UserWarning, match="cut to 1000"):
        mixed, plan = mixing.mix(df, targets, budget=5000)
    assert mixed.count() == 100 and {r.budget for r in plan.collect()} == {1000.0}

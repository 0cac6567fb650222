import itertools
import random
from collections import Counter

import pytest

from folioforge.llm import neardup
from folioforge.llm.components import components
from folioforge.llm.neardup import cells, copy_groups, copy_pairs, table_sketches, text_sketches, words
from folioforge.session import Scratch


def brute(items, threshold):
    parent = {i: i for i in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(items, 2):
        if sum((items[a] & items[b]).values()) >= threshold * max(sum(items[a].values()), sum(items[b].values())) and items[a] and items[b]:
            parent[find(a)] = find(b)
    return {tuple(sorted(p)) for p in itertools.combinations(items, 2) if find(p[0]) == find(p[1])}


def test_against_brute_force(spark):
    rng = random.Random(5)
    texts = {}
    for g in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([30, 60, 120]))]
        for k in range(rng.choice([1, 2, 4])):
            w = list(base)
            for _ in range(k * 2):
                w[rng.randrange(len(w))] = f"z{rng.randrange(999)}"
            texts[f"c{g:02d}{k}"] = " ".join(w).title() + ("." if k % 2 else "")
    items = {i: Counter(zip(*(words(t)[k:] for k in range(3)))) for i, t in texts.items()}
    rows = [(i, t, 1) for i, t in texts.items()] * 2 + [(None, "x y z", 1), ("n", None, 1), ("e", "", 1)]
    got = copy_groups(text_sketches(spark.createDataFrame(rows, "id string, content string, kind int"), "chunk"), {"chunk": 0.55})
    assert {(r.id_a, r.id_b) for r in copy_pairs(got).collect()} == brute(items, 0.55)


def test_tables_and_kinds(spark):
    base = [[f"cell {r} {c}", str(r)] for r in range(10) for c in range(2)]
    near = [list(r) for r in base]
    near[0][0], near[3][1] = "other", "99"
    tables = spark.createDataFrame([("t1", base), ("t2", near[::-1]), ("t3", [["a", None], None]), ("t4", None), ("t5", [])], "id string, rows array<array<string>>")
    chunks = spark.createDataFrame([("t1", "a b c d e f"), ("t9", "A b, c d e f!")], "id string, content string")
    got = copy_groups(table_sketches(tables, "table").unionByName(text_sketches(chunks, "chunk")), {"table": 0.65, "chunk": 0.55})
    assert {tuple(r) for r in copy_pairs(got).collect()} == {("table", "t1", "t2"), ("chunk", "t1", "t9")}
    assert copy_groups(text_sketches(chunks.limit(0), "chunk"), {"chunk": 0.55}).count() == 0
    assert copy_groups(table_sketches(tables.limit(0), "table"), {"table": 0.65}).count() == 0
    assert copy_groups(table_sketches(tables.where("id in ('t4', 't5')"), "table"), {"table": 0.65}).count() == 0


def test_hot_group(spark):
    """A third of all rows are copies of one text: one group, without all its pairs."""
    rng = random.Random(1)
    hot = [f"h{k}" for k in range(60)]
    rows = []
    for k in range(300):
        w = list(hot)
        w[rng.randrange(60)] = f"e{k}"
        rows.append((f"hot{k:04d}", " ".join(w)))
    rows += [(f"own{k:04d}", " ".join(f"o{rng.randrange(10**6)}" for _ in range(20))) for k in range(600)]
    got = copy_groups(text_sketches(spark.createDataFrame(rows, "id string, content string"), "chunk"), {"chunk": 0.55}).collect()
    assert len(got) == 300 and {r.size for r in got} == {300}


@pytest.mark.parametrize("n", [0, 1, 40])
def test_components(spark, n):
    edges = [(k, k + 1) for k in range(n)] + [(100, 101), (101, 102), (5000, 102)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(n + 1) if n) and got[5000] == 100 and got[101] == 100


def test_normal_forms():
    assert words("The CAFÉ, ｔｗｏ words — !") == words("the café two words")
    assert cells("1,200.50\x1f\x1f - \x1fa b") == ["120050", "a b"]


def _pairs_near(rng, kind, n, share):
    """Pairs of records whose common elements just reach ``share``."""
    out = []
    for k in range(n):
        size = rng.randrange(20, 60)
        keep = -(-share * size // 1)
        base = [f"v{rng.randrange(10**9)}" for _ in range(size)] if kind == "cells" else []
        if kind == "short":  # the equal cells are short, the changed ones long
            base = [str(rng.randrange(10**6)) if i < keep else f"a long description {rng.randrange(10**9)} of it" for i in range(size)]
        other = base[: int(keep)] + [f"x{rng.randrange(10**9)}" for _ in range(size - int(keep))]
        out += [(f"p{k:04d}a", [[c] for c in base]), (f"p{k:04d}b", [[c] for c in other])]
    return out


@pytest.mark.parametrize("kind", ["cells", "short"])
def test_recall_at_the_threshold(spark, kind):
    rng = random.Random(9)
    df = spark.createDataFrame(_pairs_near(rng, kind, 400, 0.65), "id string, rows array<array<string>>")
    got = {(r.id_a, r.id_b) for r in copy_pairs(copy_groups(table_sketches(df, "table"), {"table": 0.65})).collect()}
    assert len(got) >= 392 and all(a[:5] == b[:5] for a, b in got)


def test_hot_cells(spark):
    """Cells that every table has are left out of the samples, not of the comparison."""
    rng = random.Random(2)
    hot = ["ok", "total", "yes", "1", "2", "3"]
    rows = []
    for k in range(120):
        own = [f"c{rng.randrange(10**9)}" for _ in range(9)]
        rows += [(f"t{k:03d}a", [hot, own]), (f"t{k:03d}b", [own[:7] + ["new", f"n{k}"], hot])]
    got = {(r.id_a, r.id_b) for r in copy_pairs(copy_groups(table_sketches(spark.createDataFrame(rows, "id string, rows array<array<string>>"), "table"), {"table": 0.65})).collect()}
    assert got == {(f"t{k:03d}a", f"t{k:03d}b") for k in range(120)}


def test_hot_cells_at_the_threshold(spark):
    """Pairs that just reach the threshold, a quarter of their cells common to all tables: every one is found."""
    rng = random.Random(4)
    hot = ["ok", "total", "yes", "1", "2"]
    rows = []
    for k in range(1500):
        own = [f"c{rng.randrange(10**9)}" for _ in range(15)]
        rows += [(f"t{k:04d}a", [hot, own]), (f"t{k:04d}b", [own[:8] + [f"n{rng.randrange(10**9)}" for _ in range(7)], hot])]
    got = {(r.id_a, r.id_b) for r in copy_pairs(copy_groups(table_sketches(spark.createDataFrame(rows, "id string, rows array<array<string>>"), "table"), {"table": 0.65})).collect()}
    assert got == {(f"t{k:04d}a", f"t{k:04d}b") for k in range(1500)}


def test_crowded_cells(spark):
    """Tables of numbers, states and few dates: crowded cells are divided by the next common cell, and no copy is lost."""
    rng = random.Random(6)
    tables = {}
    for k in range(400):
        base = [[str(r), f"text {rng.randrange(10**9)}", f"day {rng.randrange(25)}", rng.choice(["open", "done"])] for r in range(rng.choice([4, 6]))]
        tables[f"t{k:03d}a"] = base
        if k % 4 == 0:  # all own texts replaced: what is left in common stands in many tables
            tables[f"t{k:03d}b"] = [[r[0], f"new {rng.randrange(10**9)}", r[2], r[3]] for r in base]
    items = {i: Counter(c for r in t for c in r) for i, t in tables.items()}
    got = copy_groups(table_sketches(spark.createDataFrame(list(tables.items()), "id string, rows array<array<string>>"), "table"), {"table": 0.65})
    assert {(r.id_a, r.id_b) for r in copy_pairs(got).collect()} == brute(items, 0.65)


def _stock_texts(rng, n, stock):
    """Texts of stock sentences, every tenth with a copy that has one of them replaced."""
    pool = [" ".join(f"w{rng.randrange(3000)}" for _ in range(12)) for _ in range(stock)]
    out = {}
    for k in range(n):
        parts = rng.sample(pool, 8)
        out[f"s{k:05d}a"] = ". ".join(parts)
        if k % 10 == 0:
            out[f"s{k:05d}b"] = ". ".join([" ".join(f"n{rng.randrange(10**6)}" for _ in range(12)), *parts[1:]])
    return out


@pytest.mark.parametrize("direct", [2, neardup.DIRECT])
def test_stock_sentences(spark, monkeypatch, direct):
    """Buckets of either way to compare them, of texts and of tables, hold the pairs that brute force finds."""
    monkeypatch.setattr(neardup, "DIRECT", direct)
    texts = _stock_texts(random.Random(3), 200, 150)
    rng = random.Random(6)
    tables = {f"t{k:03d}": [[str(r), f"day {rng.randrange(9)}", rng.choice(["open", "done"]), f"v{rng.randrange(60)}"] for r in range(4)] for k in range(250)}
    sketches = text_sketches(spark.createDataFrame(list(texts.items()), "id string, content string"), "chunk")
    sketches = sketches.unionByName(table_sketches(spark.createDataFrame(list(tables.items()), "id string, rows array<array<string>>"), "table"))
    got = {tuple(r) for r in copy_pairs(copy_groups(sketches, {"chunk": 0.55, "table": 0.65})).collect()}
    runs = {i: Counter(zip(*(words(t)[k:] for k in range(3)))) for i, t in texts.items()}
    items = {i: Counter(c for r in t for c in r) for i, t in tables.items()}
    assert got == {("chunk", *p) for p in brute(runs, 0.55)} | {("table", *p) for p in brute(items, 0.65)}


def test_pairs_ruled_out_are_not_moved(spark):
    """Pairs that meet under a key but differ in their bits are not shuffled: a larger corpus moves hardly more bytes a text."""

    def moved(n):
        df = spark.createDataFrame(list(_stock_texts(random.Random(8), n, 300).items()), "id string, content string")
        status = spark.sparkContext._jsc.sc().statusStore()
        before = status.executorList(True).head().totalShuffleWrite()
        got = copy_pairs(copy_groups(text_sketches(df, "chunk"), {"chunk": 0.55})).count()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        assert got >= n // 10
        return (status.executorList(True).head().totalShuffleWrite() - before) / n

    few, many = moved(300), moved(1500)
    assert many < 1.3 * few


def test_linked_cells_are_not_divided(spark):
    """Elements that always come together: dividing a key by the next of them leaves all its pairs, so it is compared whole."""
    nodes = [(n, n, "table", [*range(10), *range(1000 + 4 * n, 1004 + 4 * n)]) for n in range(60)]
    df = spark.createDataFrame(nodes, "node long, component long, kind string, grams array<int>")
    with Scratch() as tmp:
        got = [(r.key, r.node) for r in neardup.rare_cells(df, {"table": 0.5}, tmp).select("key", "node").collect()]
    by = {}
    for key, node in got:
        by.setdefault(key, set()).add(node)
    assert any(len(v) == 60 for v in by.values()) and len(got) <= 4 * 60

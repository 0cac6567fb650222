import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from folioforge.operators import retrieval as R

VEC = "doc_id long, source string, embedding array<double>"


def vectors(spark, n=500, dims=6, seed=1):
    rng = random.Random(seed)
    rows = [(k, "abc"[k % 3], [round(rng.uniform(-1, 1), 3) for _ in range(dims)]) for k in range(n)]
    return rows, spark.createDataFrame(rows + [(n, "a", None)], VEC)


def best(rows, q, top):
    s = [(-round(float(np.dot(v, q)), 5), i) for i, _s, v in rows]
    return [i for _, i in sorted(s)[:top]]


def test_vectors_in_blocks(spark, monkeypatch):
    """Blocks smaller than either side give what one comparison of all rows gives."""
    monkeypatch.setattr(R, "DENSE_BLOCK", 3)
    monkeypatch.setattr(R, "CORPUS_BLOCK", 40)
    rows, df = vectors(spark)
    q = df.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("q"))
    got = {}
    for r in R.vector_topk(df, q, 7).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.doc_id
    want = {i: best(rows, v, 7) for i, _s, v in rows if i % 50 == 0}
    assert {i: [d[k] for k in sorted(d)] for i, d in got.items()} == want
    assert R.vector_topk(df, q.limit(0), 7).count() == 0 and R.vector_topk(df.limit(0), q, 7).count() == 0


def test_filter_strategies(spark):
    rows, df = vectors(spark)
    q = spark.createDataFrame([(1, rows[0][2]), (2, rows[1][2])], "query_id int, q array<double>")
    ids = lambda f, k: [r.doc_id for r in f.where(F.col("query_id") == k).orderBy("rank").collect()]
    native = R.filtered_search(df, q, 5, source=["b"])
    assert ids(native, 1) == best([r for r in rows if r[1] == "b"], rows[0][2], 5)
    late = R.filtered_search(df, q, 5, source=["a", "b"])
    assert ids(late, 2) == [i for i in best(rows, rows[1][2], 100) if rows[i][1] in "ab"][:5]
    assert R.filtered_search(df, q, 5, source=["nowhere"]).count() == 0


def test_index_follows_its_files(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, "red fox"), (2, "red red dog"), (3, None), (4, ""), (5, "blue cat"), (6, "green owl")], "doc_id long, text string").write.parquet(path)
    read = lambda: spark.read.parquet(path)
    one = R.text_index(read())
    assert R.text_index(read()) is one
    spark.createDataFrame([(7, "dog dog dog")], "doc_id long, text string").write.mode("append").parquet(path)
    two = R.text_index(read())
    assert two is not one and {r.doc_id for r in R.bm25(read(), [(1, "dog")]).collect()} == {2, 7}


def test_fusion_per_query_and_ties(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1)], "query_id int, doc_id int, rank int")
    b = spark.createDataFrame([(1, 12, 1), (1, 13, 2), (2, 9, 1)], "query_id int, doc_id int, rank int")
    got = [(r.query_id, r.doc_id) for r in R.rrf(a, b, by="query_id").orderBy("query_id", "rank").collect()]
    assert got == [(1, 10), (1, 12), (1, 11), (1, 13), (2, 10), (2, 9)]
    kept = R.only_documents(a, spark.createDataFrame([(11,), (11,)], "doc_id int")).collect()
    assert [(r.doc_id, r["rank"]) for r in kept] == [(11, 1)]
    assert R.rerank_pool(5) == 10 and R.rerank_pool(2) == 5 and R.rerank_pool(5, False) == 5


def test_post_filter(spark):
    docs = spark.createDataFrame([("My Doc", "text", None), ("other", "table", "x")], "doc_id string, source string, page string")
    assert [r.doc_id for r in R.post_filter(docs, doc_ids=["my doc "]).collect()] == ["My Doc"]
    assert R.post_filter(docs, custom={"page": ""}).count() == 1 and R.post_filter(docs, sources=["table"]).count() == 1
    shown = R.sources(spark.createDataFrame([(1, "[Doc: a]\nsum\n\nbody", ""), (2, "x", "own")], "rank int, window string, orig_content string"))
    assert {r["rank"]: r.content for r in shown.collect()} == {1: "body", 2: "own"}


def words(n, seed):
    rng = random.Random(seed)
    return [(f"d{k:03d}", " ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randrange(40))) if k % 9 else "w1 w2 w2 rare") for k in range(n)]


def test_texts_in_blocks(spark, monkeypatch):
    """Blocks smaller than either side, equal texts, empty ones and words that multiply or are added give what the formula gives."""
    monkeypatch.setattr(R, "TEXT_BLOCK", 50)
    monkeypatch.setattr(R, "CORPUS_TEXTS", 90)
    docs = words(400, 5)
    asked = [(k, t) for k, (_i, t) in enumerate(docs) if k % 3 == 0]
    got = {}
    for r in R.bm25(spark.createDataFrame(docs, "doc_id string, text string"), asked, top=8).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.doc_id, r.score)
    tf = {i: Counter(t.split()) for i, t in docs}
    df = Counter(w for c in tf.values() for w in c)
    raw = {w: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    idf = {w: x if x >= 0 else R.IDF_FLOOR * sum(raw.values()) / len(raw) for w, x in raw.items()}
    mean = sum(map(Counter.total, tf.values())) / len(docs)
    want = {}
    for q, t in asked:
        score = lambda c: round(sum(idf[w] * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * c.total() / mean)) for w in t.split()), 6)  # noqa: E731, B023
        best = [(-s, i) for s, i in sorted((-score(c), i) for i, c in tf.items())[:8] for s in [s] if s < 0]
        if best:
            want[q] = {k + 1: (i, s) for k, (s, i) in enumerate(best)}
    assert {q: {k: i for k, (i, _s) in x.items()} for q, x in got.items()} == {q: {k: i for k, (i, _s) in x.items()} for q, x in want.items()}
    assert all(abs(got[q][k][1] - s) < 2e-6 for q, x in want.items() for k, (_i, s) in x.items())


def test_best_rows_are_kept_from_block_to_block(spark, monkeypatch):
    """What leaves a search does not grow with the number of blocks: ``top`` rows a query and task."""
    monkeypatch.setattr(R, "ranked", lambda scored, by, top: scored)
    monkeypatch.setattr(R, "CORPUS_BLOCK", 10)
    monkeypatch.setattr(R, "CORPUS_TEXTS", 10)
    _rows, df = vectors(spark)
    q = df.where("doc_id in (1, 2)").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("q"))
    assert R.vector_topk(df.coalesce(2), q.coalesce(1), 5).count() <= 2 * 5 * 2
    docs = spark.createDataFrame(words(400, 6), "doc_id string, text string").coalesce(2)
    assert R.bm25(docs, [(1, "w1 w2"), (2, "w1 w3")], top=5).count() <= 2 * 5 * 2

"""Whole retrieval queries on small tables, against their SQL twins."""

import random

import duckdb
import pytest

from folioforge.operators import retrieval as R
from folioforge.plans.queries import ORACLES, QUERIES


@pytest.fixture
def tables(spark, tmp_path):
    """60 questions and 140 other texts of few words; 300 texts of symbols that no question finds, in bundles of their own."""
    rng = random.Random(8)
    words = ["install", "setup", "error", "fail", "warning", "contract", "๒๕๖๙", "2569", "12", *(f"w{k}" for k in range(60))]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(3, 60)))
    ids = [100 * k for k in range(1, 61)] + [100 * k + j for k in range(1, 21) for j in range(1, 8)]
    docs = [(i, text(), rng.choice([" Scanner", "mail", "web"]), rng.choice([f"b{i // 500}", "all"])) for i in ids]
    docs += [(100_001 + 100 * k, "".join(chr(rng.randrange(0x2500, 0x27C0)) for _ in range(3000)), "mail", f"s{k}") for k in range(300)]
    vectors = [(i, [round(rng.uniform(-1, 1), 3) for _ in range(4)], i % 5) for i in ids if i % 3 == 0]
    spark.createDataFrame(docs, "doc_id long, text string, source string, bundle_id string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").repartition(2).write.parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path)


def both(spark, tables, name):
    """The sorted rows of a query and of its twin."""
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet/*.parquet'")
    want = con.execute(ORACLES[name])
    order = sorted(c[0] for c in want.description)
    return sorted(tuple(r[c] for c in order) for r in QUERIES[name](spark, tables).collect()), sorted(want.df()[order].itertuples(index=False, name=None))


def test_texts_not_found_are_not_moved(spark, tables, monkeypatch):
    """Reranking and page windows move the texts that were found, not the corpus; without broadcasts the rows are the same."""
    status = spark.sparkContext._jsc.sc().statusStore()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = status.executorList(True).head().totalShuffleWrite()
        got, want = both(spark, tables, "answer_sources")
        moved = status.executorList(True).head().totalShuffleWrite() - before
        assert got == want and len(got) > 200
        assert moved < 1_000_000  # the symbols alone are 2.7 million bytes
        monkeypatch.setattr(R, "FEW", 0)
        assert both(spark, tables, "answer_sources")[0] == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_filtered_search_hands_on_best_rows_only(spark, tables, monkeypatch):
    """However many blocks the texts lie in, ``top`` rows a question and task are ranked, and the rows are those of the twin."""
    handed, ranked = [], R.ranked

    def counted(scored, by, top):
        handed.append((scored.count(), scored.rdd.getNumPartitions() * top * 60))
        return ranked(scored, by, top)

    monkeypatch.setattr(R, "CORPUS_TEXTS", 10)
    monkeypatch.setattr(R, "TEXT_BLOCK", 100)
    monkeypatch.setattr(R, "ranked", counted)
    got, want = both(spark, tables, "hybrid_filtered")
    assert got == want and len(got) > 200
    rows, most = handed[-1]
    assert 0 < rows <= most

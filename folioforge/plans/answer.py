"""Retrieval queries, up to the whole path from questions to sources.

The questions are the documents whose id is divisible by 100, asked with their whole text and their vector against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import classify as C
from folioforge.functions import text as X
from folioforge.operators import retrieval as R
from folioforge.plans.registry import any_of, query
from folioforge.session import stage, table

_WORDS = "[\\p{L}\\p{N}_]+"
_ASKED = "(SELECT doc_id AS query_id, text AS query FROM documents WHERE doc_id % 100 = 0)"


def _bm25_sql(asked: str = _ASKED, top: int = 30) -> str:
    return f"""WITH tok AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{_WORDS}') AS t FROM documents),
      st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
      dfs AS (SELECT token, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(t) AS token FROM tok) GROUP BY token),
      raw AS (SELECT token, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM dfs, st),
      idf AS (SELECT token, CASE WHEN idf < 0 THEN (SELECT 0.25 * avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
      q AS (SELECT query_id, token, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '{_WORDS}')) AS token FROM {asked}) GROUP BY ALL),
      hit AS (SELECT doc_id, token, len(any_value(t)) AS dl, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS token FROM tok) WHERE token IN (SELECT token FROM q) GROUP BY doc_id, token),
      sc AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM hit JOIN q USING (token) JOIN idf USING (token), st GROUP BY query_id, doc_id),
      bm AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM sc QUALIFY rank <= {top}),
      bm25 AS (SELECT query_id, doc_id, score, rank FROM bm WHERE score > 0)"""


def _vec_sql(name: str = "vec", where: str = "TRUE", top: int = 30) -> str:
    return f"""{name} AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, round(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))), 5) AS score,
      CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, e.vec_id) AS INT) AS rank FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q WHERE {where} QUALIFY rank <= {top})"""


def _rrf_sql(lists: str, top: int, source: str) -> str:
    """CTE ``lists`` (query_id, doc_id, rank, list) fused per query."""
    return f"""{lists} AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, seen, doc_id) AS INT) AS rank FROM (
      SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 8) AS rrf, min((list, rank)) AS seen FROM ({source}) GROUP BY query_id, doc_id) QUALIFY rank <= {top})"""


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return v, v.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("q"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("doc_id % 100 = 0 and text is not null").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


@query(_bm25_sql() + " SELECT * FROM bm25")
def bm25_topk(spark, d):
    return R.bm25(_texts(spark, d), _asked(spark, d))


@query("WITH " + _vec_sql() + " SELECT query_id, doc_id, score, rank FROM vec")
def vector_topk(spark, d):
    return R.vector_topk(*_vectors(spark, d))


@query("WITH " + _vec_sql(where="e.label = 3") + " SELECT query_id, doc_id, score, rank FROM vec")
def vector_filtered_topk(spark, d):
    return R.vector_topk(*_vectors(spark, d), where=F.col("label") == 3)


@query(
    "WITH " + _vec_sql("native", "e.label = -1", 10) + ", " + _vec_sql("wide", top=150)
    + """ SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM (
          SELECT query_id, doc_id, score FROM wide JOIN (SELECT vec_id AS doc_id, label FROM embeddings) USING (doc_id) WHERE label IN (1, 2)) QUALIFY rank <= 10"""
)
def vector_strategies(spark, d):
    """Filters of several values: the nearest vectors are fetched first and filtered afterwards."""
    v, q = _vectors(spark, d)
    return R.filtered_search(v, q, 10, label=[1, 2])


@query(
    "WITH " + _vec_sql("native", "e.label = 3", 10) + ", none AS (SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 100 = 0 AND vec_id NOT IN (SELECT query_id FROM native)), "
    + _vec_sql("wide", top=150) + " SELECT query_id, doc_id, score, rank FROM native UNION ALL SELECT query_id, doc_id, score, rank FROM wide WHERE query_id IN (SELECT query_id FROM none) AND FALSE"
)
def vector_native_filter(spark, d):
    """A filter of one value goes to the vectors; only queries that it leaves without results would fall back."""
    v, q = _vectors(spark, d)
    return R.filtered_search(v, q, 10, label=[3])


_HYBRID = "SELECT query_id, doc_id, rank, 0 AS list FROM vec UNION ALL SELECT query_id, doc_id, rank, 1 FROM bm25"


@query(_bm25_sql() + ", " + _vec_sql() + ", " + _rrf_sql("fused", 30, _HYBRID) + " SELECT query_id, doc_id, rrf, rank FROM fused")
def hybrid_rrf(spark, d):
    """The flagship: the best documents of a dense and a lexical search for each question, fused by reciprocal rank."""
    return hybrid(spark, d)


def hybrid(spark: SparkSession, d: str, queries: DataFrame | None = None, top: int = 30) -> DataFrame:
    v, q = _vectors(spark, d)
    return R.rrf(R.vector_topk(v, q), R.bm25(_texts(spark, d), _asked(spark, d) if queries is None else queries), top=top, by="query_id")


_SCANNED = "(SELECT doc_id FROM documents WHERE lower(trim(source)) IN ('scanner', 'mail'))"


@query(
    _bm25_sql() + ", " + _vec_sql(where=f"e.vec_id IN {_SCANNED}")
    + f", kept AS (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INT) AS rank FROM bm25 WHERE doc_id IN {_SCANNED}), "
    + _rrf_sql("fused", 30, _HYBRID.replace("bm25", "kept")) + " SELECT query_id, doc_id, rrf, rank FROM fused"
)
def hybrid_filtered(spark, d):
    """Hybrid search within some documents: vectors are filtered before the cut, the lexical list after it."""
    v, q = _vectors(spark, d)
    ids = table(spark, d, "documents").where(F.lower(F.trim("source")).isin("scanner", "mail")).select("doc_id")
    dense = R.vector_topk(v.join(ids.distinct(), "doc_id", "left_semi"), q)
    return R.rrf(dense, R.only_documents(R.bm25(_texts(spark, d), _asked(spark, d)), ids), top=30, by="query_id")


# Each question and its rewrites: Arabic and Thai digits. A rewrite has the key 3 x question + its place.
_VARIANTS = (
    "(SELECT query_id * 3 + k AS query_id, query FROM (SELECT query_id, k, query, row_number() OVER (PARTITION BY query_id, query ORDER BY k) AS again FROM ("
    f"SELECT query_id, 0 AS k, query FROM {_ASKED} UNION ALL SELECT query_id, 1, translate(query, '๐๑๒๓๔๕๖๗๘๙', '0123456789') FROM {_ASKED} UNION ALL "
    f"SELECT query_id, 2, translate(query, '0123456789', '๐๑๒๓๔๕๖๗๘๙') FROM {_ASKED})) WHERE again = 1)"
)
_MULTI = (
    _bm25_sql(_VARIANTS) + ", " + _vec_sql() + f", keys AS (SELECT query_id FROM {_VARIANTS}), "
    + _rrf_sql("each_", 30, "SELECT k.query_id, v.doc_id, v.rank, 0 AS list FROM keys k JOIN vec v ON v.query_id = k.query_id // 3 UNION ALL SELECT query_id, doc_id, rank, 1 FROM bm25")
    + ", " + _rrf_sql("merged", 30, "SELECT query_id // 3 AS query_id, doc_id, rank, query_id % 3 AS list FROM each_")
)


@query(_MULTI + " SELECT query_id, doc_id, rrf, rank FROM merged")
def multi_query_rrf(spark, d):
    """Every question with its rewrites: a hybrid search each, fused once more per question."""
    return multi(spark, d)


def variants(asked: DataFrame) -> DataFrame:
    forms = F.array_distinct(F.array("query", X.to_arabic_digits(F.col("query")), X.to_thai_digits(F.col("query"))))
    place = lambda v: F.when(v == F.col("query"), 0).when(v == X.to_arabic_digits(F.col("query")), 1).otherwise(2)
    each = asked.select("query_id", F.explode(F.transform(forms, lambda v: F.struct(v.alias("query"), place(v).alias("k")))).alias("x"))
    return each.select((F.col("query_id") * 3 + F.col("x.k")).alias("query_id"), F.col("x.query").alias("query"))


def multi(spark: SparkSession, d: str) -> DataFrame:
    v, q = _vectors(spark, d)
    asked = stage(variants(_asked(spark, d)))
    dense, lexical = R.vector_topk(v, q), R.bm25(_texts(spark, d), asked)
    question = F.floor(F.col("query_id") / 3).cast("long")
    keys = asked.select("query_id", question.alias("question"))
    dense = keys.join(dense.withColumnRenamed("query_id", "question"), "question").select("query_id", "doc_id", "rank")
    each = stage(R.rrf(dense, lexical, top=30, by="query_id"))
    lists = [each.where(F.col("query_id") % 3 == k).select(question.alias("query_id"), "doc_id", "rank") for k in range(3)]
    return R.rrf(*lists, top=30, by="query_id")


_DOC_T = "lower(coalesce(text, '') || ' ')"
_NAMES = ", ".join(f"CASE WHEN regexp_matches({_DOC_T}, '{p}') THEN '{n}' END" for n, (p, _s, _q) in sorted(C.INTENTS.items(), key=lambda x: -x[1][1]))
_WANT = " ".join(f"WHEN regexp_matches(lower(query), '(?:{p}{'|' + C.QUERY_MORE[n] if n in C.QUERY_MORE else ''})') THEN '{n}'" for n, (p, _s, _q) in sorted(C.INTENTS.items(), key=lambda x: -x[1][1]))
# The surrogate of the cross-encoder: the share of a question's words that a document has.
_POOL = f""", asked AS (SELECT query_id, CASE {_WANT} END AS wanted, list_distinct(regexp_extract_all(lower(query), '{_WORDS}')) AS words FROM {_ASKED}),
      scored AS (SELECT query_id, doc_id, wanted, round(len(list_intersect(words, regexp_extract_all(lower(text), '{_WORDS}'))) / len(words), 6) AS score, rank, [{_NAMES}] AS intents
        FROM {{ranks}} JOIN asked USING (query_id) JOIN documents USING (doc_id)),
      pool AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS INT) AS prev_rank FROM scored QUALIFY prev_rank <= 10),
      final AS (SELECT query_id, doc_id, round(score + CASE WHEN list_contains(intents, wanted) THEN 0.3 ELSE 0 END, 6) AS final, prev_rank FROM
        (SELECT *, bool_or(score >= 0.05) OVER (PARTITION BY query_id) AS hit FROM pool) WHERE score >= 0.05 OR NOT hit),
      best AS (SELECT query_id, doc_id, final, CAST(row_number() OVER (PARTITION BY query_id ORDER BY final DESC, prev_rank) AS INT) AS rank FROM final QUALIFY rank <= 5)"""


def _reranked(spark: SparkSession, d: str, ranks: DataFrame, top: int = 5) -> DataFrame:
    """query_id, doc_id, final, rank: reranked, thresholded, boosted by intent, cut to ``top``. A document is read once however
    many questions found it, and its text stays where it lies."""
    asked = stage(_asked(spark, d).select("query_id", C.query_intent(F.col("query")).alias("wanted"), F.array_distinct(X.tokens(F.col("query"))).alias("words")))
    pairs = stage(ranks.select("query_id", "doc_id", "rank")).join(asked, "query_id")
    found = pairs.groupBy("doc_id").agg(F.max(F.col("wanted").isNotNull()).alias("boosts"))
    texts = _texts(spark, d).select("doc_id", "text").join(R.few(found), "doc_id")
    intents = F.when(F.col("boosts"), C.intents(F.col("text"), F.lit("")))  # only where a boost can come of them
    facts = texts.select("doc_id", F.array_distinct(X.tokens(F.col("text"))).alias("has"), intents.alias("intents"))
    score = F.round(F.size(F.array_intersect("words", "has")) / F.size("words"), 6)
    scored = pairs.join(facts, "doc_id").select("query_id", "doc_id", "wanted", "rank", score.alias("score"), "intents")
    order = R.Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    pool = scored.withColumn("prev_rank", F.row_number().over(order)).where(F.col("prev_rank") <= R.rerank_pool(top))
    return R.boosted(pool, top)


@query(_bm25_sql() + _POOL.replace("{ranks}", "bm25") + " SELECT query_id, doc_id, final, rank FROM best")
def rerank_boost(spark, d):
    return _reranked(spark, d, R.bm25(_texts(spark, d), _asked(spark, d)))


@query(
    _MULTI + _POOL.replace("{ranks}", "merged")
    + """, m AS (SELECT b.query_id, c.bundle_id AS doc_id, c.doc_id // 10 AS page, c.doc_id AS chunk_id, c.text AS content, rank FROM best b JOIN documents c USING (doc_id)
        QUALIFY row_number() OVER (PARTITION BY b.query_id, c.bundle_id, c.doc_id // 10 ORDER BY rank) = 1),
      p AS (SELECT m.*, c.doc_id AS near_id, c.text AS near FROM m LEFT JOIN documents c ON c.bundle_id = m.doc_id AND c.doc_id // 10 = m.page AND c.text <> m.content AND trim(c.text) <> ''),
      r AS (SELECT *, sum(length(near)) OVER (PARTITION BY query_id, chunk_id ORDER BY near_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM p)
      SELECT query_id, rank, doc_id, page, chunk_id, 'text' AS source, md5(content || coalesce(string_agg(chr(10) || chr(10) || near, '' ORDER BY near_id) FILTER (length(content) + running <= 3000), '')) AS content
      FROM r GROUP BY query_id, rank, doc_id, page, chunk_id, content"""
)
def answer_sources(spark, d):
    """The whole path: questions and their rewrites, hybrid search, fusion, reranked pool, threshold, intent boost, window of
    the page, sources with the original content."""
    best = stage(_reranked(spark, d, multi(spark, d)))
    chunks = _texts(spark, d).select(F.col("bundle_id").alias("doc_id"), F.floor(F.col("doc_id") / 10).cast("long").alias("page"), F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    pages = chunks.join(R.few(best.select(F.col("doc_id").alias("chunk_id")).distinct()), "chunk_id").select(F.col("doc_id").alias("d"), F.col("page").alias("p")).distinct()
    near = stage(chunks.join(R.few(pages), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("page") == F.col("p")), "left_semi"))  # whole pages
    matched = best.select("query_id", "rank", F.col("doc_id").alias("chunk_id")).join(near, "chunk_id")
    return R.sources(R.page_window(matched, near).withColumn("source", F.lit("text"))).withColumn("content", F.md5("content"))

"""Lexical, dense and fused retrieval, reranking and context expansion as DataFrame plans.

A set of queries meets the corpus in blocks: queries are packed some to a row, and so are the rows of the corpus where they
lie; each pair of blocks is scored as a matrix, and a task keeps the best rows of each query from pair to pair. So neither side
need be small, no pair of rows is ever a row, and a block of queries (whose size is fixed) is all that is sent to a task besides
the corpus. Corpus statistics are aggregated once, into an index that later searches reuse as long as the corpus stays the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import sanitize_id, strip_context, tokens
from folioforge.session import stage

K1, B, IDF_FLOOR, RRF_K = 1.5, 0.75, 0.25, 60
FEW = 500_000  # rows of keys that are broadcast
TOP_N, MIN_SCORE, BOOST, WINDOW_CHARS = 30, 0.05, 0.3, 3000
DENSE_BLOCK, TEXT_BLOCK = 256, 2048  # queries of a block
CORPUS_BLOCK, CORPUS_TEXTS = 2048, 2048  # vectors and texts of a block
DENSE_SHARE, MEETINGS = 0.002, 2_000_000  # of a matrix that a word fills to be multiplied; other meetings that are added at once


def postings(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, token, tf, dl: one row per distinct token of a document; built without a shuffle."""
    sized = docs.select(F.col(doc).alias("doc_id"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    exploded = sized.select("doc_id", F.size("t").alias("dl"), F.explode("t").alias("token"))
    return exploded.groupBy("doc_id", "token", "dl").agg(F.count("*").alias("tf"))


def _one(column: pa.Array) -> pa.Array:
    """A column as one row, an array."""
    return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), pa.concat_arrays([column]))


def _bytes(*numbers: np.ndarray) -> list[pa.Array]:
    return [pa.array([x.tobytes()], pa.binary()) for x in numbers]


def in_blocks(rows: DataFrame, size: int, pack: Callable[[pa.RecordBatch], list[pa.Array]], schema: str) -> DataFrame:
    """``size`` consecutive rows of a partition as one row; nothing is moved."""
    names = [x.split()[0] for x in schema.split(", ")]

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i in range(0, b.num_rows, size):
                yield pa.RecordBatch.from_arrays(pack(b.slice(i, size)), names)

    return rows.mapInArrow(work, schema)


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of ``size`` rows, an array for each column."""
    return in_blocks(rows, size, lambda part: [_one(c) for c in part.columns], ", ".join(f"{f.name} array<{f.dataType.simpleString()}>" for f in rows.schema.fields))


def postings_packed(terms: DataFrame, size: int) -> DataFrame:
    """Blocks of ``size`` documents (doc_id, t): their ids, the distinct words, in how many documents each is, and word by word
    these documents and how often they have it; the documents' lengths and the sum of these."""

    def pack(part: pa.RecordBatch) -> list[pa.Array]:
        dl, coded = pc.list_value_length(part.column("t")).to_numpy(), part.column("t").flatten().dictionary_encode()
        key = np.sort(coded.indices.to_numpy() * np.int64(len(dl)) + np.repeat(np.arange(len(dl)), dl))
        first = np.flatnonzero(np.diff(key, prepend=-1))
        df = np.bincount(key[first] // len(dl), minlength=len(coded.dictionary)).astype("int32")
        numbers = _bytes(*(x.astype("int32") for x in (key[first] % len(dl), np.diff(first, append=len(key)), dl)))
        return [_one(part.column("doc_id")), _one(coded.dictionary), _one(pa.array(df)), *numbers, pa.array([len(key)])]

    return in_blocks(terms, size, pack, f"doc_id array<{terms.schema['doc_id'].dataType.simpleString()}>, word array<string>, df array<int>, doc binary, tf binary, dl binary, words bigint")


def weights_packed(queries: DataFrame, size: int) -> DataFrame:
    """Blocks of ``size`` queries (query_id, term, w): their ids, the distinct words, in how many queries each is, and word by
    word these queries and its weights."""

    def pack(part: pa.RecordBatch) -> list[pa.Array]:
        count, coded = pc.list_value_length(part.column("term")).to_numpy(), part.column("term").flatten().dictionary_encode()
        codes, whose = coded.indices.to_numpy(), np.repeat(np.arange(len(count), dtype="int32"), count)
        order = np.argsort(codes, kind="stable")
        numbers = _bytes(np.bincount(codes, minlength=len(coded.dictionary)).astype("int32"), whose[order], part.column("w").flatten().to_numpy()[order])
        return [_one(part.column("query_id")), _one(coded.dictionary), *numbers]

    return in_blocks(queries, size, pack, f"query_id array<{queries.schema['query_id'].dataType.simpleString()}>, term array<string>, qf binary, query binary, w binary")


class _Best:
    """The best ``top`` rows so far for each query of a block; scores are rounded to ``places``, ties go to the smaller id. With
    ``positive``, rows scored zero or less are none."""

    def __init__(self, queries: int, top: int, places: int, positive: bool) -> None:
        self.top, self.places, self.positive = top, places, positive
        self.query, self.score, self.ids = np.empty(0, "int64"), np.empty(0), None
        self.low = np.full(queries, -np.inf)  # the last of the best scores, once there are ``top``

    def add(self, s: np.ndarray, ids: np.ndarray) -> None:
        """``s``: the scores, queries x ``ids``."""
        low = self.low.copy()
        if s.shape[1] > self.top:
            for k in np.flatnonzero(np.isneginf(low)):
                low[k] = np.partition(s[k], -self.top)[-self.top]
        least = low - 10.0**-self.places  # rounding lifts no score further
        if self.positive:
            least = np.maximum(least, np.nextafter(0, 1))
        query, at = np.nonzero(s >= least[:, None])
        score = np.round(s[query, at], self.places)
        if self.positive:
            query, at, score = (x[score > 0] for x in (query, at, score))
        if not len(query):
            return
        found = ids[at] if self.ids is None else np.concatenate([self.ids, ids[at]])
        query, score = np.concatenate([self.query, query]), np.concatenate([self.score, score])
        order = np.lexsort((found, -score, query))
        number = np.bincount(query, minlength=len(low))
        kept = order[np.arange(len(order)) - np.repeat(np.cumsum(number) - number, number) < self.top]
        self.query, self.score, self.ids = query[kept], score[kept], found[kept]
        full = number >= self.top
        self.low[full] = self.score[np.cumsum(np.minimum(number, self.top))[full] - 1]


def searched(corpus: DataFrame, asked: DataFrame, score: Callable[[dict], np.ndarray], places: int, top: int, positive: bool = False) -> DataFrame:
    """query_id, doc_id, score, rank: the best ``top`` rows of the blocks ``corpus`` (doc_id, ...) for each query of the blocks
    ``asked`` (query_id, ...). ``score`` gives the matrix queries x rows of a pair of blocks. A task keeps the best rows of its
    queries from pair to pair, so that ``top`` rows a query leave it however many blocks it met."""
    kinds = [df.schema[c].dataType.elementType.simpleString() for c, df in (("query_id", asked), ("doc_id", corpus))]

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, _Best] = {}
        for b in it:
            types = [b.schema.field(c).type.value_type for c in ("query_id", "doc_id")]
            for i in range(b.num_rows):
                pair = {n: c[i].values if isinstance(c, pa.ListArray) else c[i].as_py() for n, c in zip(b.schema.names, b.columns)}
                key = tuple(pair["query_id"].to_pylist())
                if key not in held:
                    held[key] = _Best(len(key), top, places, positive)
                held[key].add(score(pair), pair["doc_id"].to_numpy(zero_copy_only=False))
        for key, best in held.items():
            if best.ids is not None:
                columns = [pa.array(key, types[0]).take(pa.array(best.query)), pa.array(best.ids, types[1]), pa.array(best.score)]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "doc_id", "score"])

    met = corpus.crossJoin(asked)  # of blocks: a stated set of queries against all rows
    return ranked(met.mapInArrow(work, f"query_id {kinds[0]}, doc_id {kinds[1]}, score double"), "query_id", top)


def spread(queries: DataFrame, block: int) -> DataFrame:
    """``queries`` in partitions that seldom hold more than ``block`` rows."""
    return queries.repartition(max(1, -(-queries.count() * 10 // (block * 9))), F.xxhash64("query_id"))


def _spans(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` numbers from each ``first`` on, and the place of the first that each belongs to."""
    whose = np.repeat(np.arange(len(count)), count)
    return np.arange(len(whose)) + (first - np.cumsum(count) + count)[whose], whose


def _bm25(pair: dict, avgdl: float) -> np.ndarray:
    """BM25 of a block of queries and one of documents: words that meet in much of the matrix by a product of matrices, the
    others meeting by meeting."""
    doc, tf, dl, qf, query = (np.frombuffer(pair[c], "int32") for c in ("doc", "tf", "dl", "qf", "query"))
    df, w, shape = pair["df"].to_numpy(), np.frombuffer(pair["w"]), (len(pair["query_id"]), len(pair["doc_id"]))
    gain = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[doc] / avgdl))
    at = pc.fill_null(pc.index_in(pair["word"], value_set=pair["term"]), -1).to_numpy()
    word = np.flatnonzero(at >= 0)
    nd, nq = df[word].astype("int64"), qf[at[word]].astype("int64")
    d0, q0 = (np.cumsum(df) - df)[word], (np.cumsum(qf) - qf)[at[word]]
    dense = nd * nq >= DENSE_SHARE * shape[0] * shape[1]
    (p, k), (r, j) = _spans(d0[dense], nd[dense]), _spans(q0[dense], nq[dense])
    left, right = np.zeros((shape[0], dense.sum())), np.zeros((dense.sum(), shape[1]))
    left[query[r], j], right[k, doc[p]] = w[r], gain[p]
    out = (left @ right).ravel()
    nd, nq, d0, q0 = nd[~dense], nq[~dense], d0[~dense], q0[~dense]
    for part in np.split(np.arange(len(nd)), np.flatnonzero(np.diff(np.cumsum(nd * nq) // MEETINGS)) + 1):
        p, k = _spans(d0[part], nd[part])
        r, i = _spans(q0[part][k], nq[part][k])
        p = p[i]
        out += np.bincount(query[r] * np.int64(shape[1]) + doc[p], w[r] * gain[p], len(out))
    return out.reshape(shape)


class TextIndex:
    """The words of all documents in blocks and the corpus's statistics, staged once. ``df`` is distributed; two numbers are held
    here."""

    def __init__(self, docs: DataFrame, doc: str = "doc_id", text: str = "text") -> None:
        terms = docs.select(F.col(doc).alias("doc_id"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("t"))
        self.blocks = stage(postings_packed(terms, CORPUS_TEXTS))
        self.n, self.avgdl = self.blocks.agg(F.coalesce(F.sum(F.size("doc_id")), F.lit(0)), F.sum("words") / F.sum(F.size("doc_id"))).first()
        counts = self.blocks.select(F.explode(F.arrays_zip("word", "df")).alias("x")).groupBy(F.col("x.word").alias("token"))
        self.df = stage(counts.agg(F.sum("x.df").alias("df")))
        idf = F.log(F.lit(self.n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        self.floor = (self.df.agg(F.avg(idf)).first()[0] or 0.0) * IDF_FLOOR
        self.weights = self.df.select("token", F.when(idf < 0, F.lit(self.floor)).otherwise(idf).alias("idf"))

    def search(self, queries: DataFrame, top: int = TOP_N) -> DataFrame:
        """query_id, doc_id, score, rank of the best ``top`` documents by BM25 for ``queries`` (query_id, query)."""
        q = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qtf"))
        q = q.join(self.weights, "token").groupBy("query_id").agg(F.collect_list(F.struct("token", (F.col("qtf") * F.col("idf")).alias("w"))).alias("x"))
        q = stage(q.select("query_id", F.col("x.token").alias("term"), F.col("x.w").alias("w")))  # a row a query; counted and packed
        asked = stage(weights_packed(spread(q, TEXT_BLOCK), TEXT_BLOCK))
        avgdl = self.avgdl or 1.0
        return searched(self.blocks.drop("words"), asked, lambda pair: _bm25(pair, avgdl), 6, top, positive=True)


def few(rows: DataFrame) -> DataFrame:
    """``rows``, marked to be broadcast if they are at most ``FEW``; beyond it the join that takes them gives the same rows."""
    return F.broadcast(rows) if rows.count() <= FEW else rows


_INDEXES: dict[tuple, TextIndex] = {}


def text_index(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> TextIndex:
    """The index of ``docs``, built again only when its files have changed: the version is their names, sizes and times."""
    jvm, conf = docs.sparkSession.sparkContext._jvm, docs.sparkSession.sparkContext._jsc.hadoopConfiguration()
    files = []
    for name in sorted(docs.inputFiles()):
        p = jvm.org.apache.hadoop.fs.Path(name)
        s = p.getFileSystem(conf).getFileStatus(p)
        files.append((name, s.getLen(), s.getModificationTime()))
    key = (docs.sparkSession.sparkContext.applicationId, tuple(docs.columns), doc, text, tuple(files))
    if not files:
        return TextIndex(docs, doc, text)
    for old in [k for k in _INDEXES if k[:4] == key[:4] and {f[0] for f in k[4]} & {f[0] for f in files} and k != key]:
        del _INDEXES[old]
    if key not in _INDEXES:
        _INDEXES[key] = TextIndex(docs, doc, text)
    return _INDEXES[key]


def bm25(docs: DataFrame, queries: DataFrame | list[tuple[int, str]], doc: str = "doc_id", text: str = "text", top: int = TOP_N) -> DataFrame:
    """query_id, doc_id, score, rank of the best ``top`` documents by BM25 (k1 1.5, b 0.75; idf ln(N-df+.5)-ln(df+.5), a
    negative one replaced by a quarter of the mean idf). Repeated query words count each time. Scores are rounded to six
    places, ties go to the smaller id, and documents scored zero or less drop out after the cut."""
    if isinstance(queries, list):
        queries = docs.sparkSession.createDataFrame(queries, "query_id int, query string")
    return text_index(docs, doc, text).search(queries, top)


def ranked(scored: DataFrame, by: str, top: int) -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _dot(pair: dict) -> np.ndarray:
    q, v = (np.stack(pair[c].to_numpy(zero_copy_only=False)).astype(float) for c in ("q", "v"))
    return q @ v.T


def vector_topk(vectors: DataFrame, queries: DataFrame, top: int = TOP_N, where: Column | None = None, vec: str = "embedding") -> DataFrame:
    """query_id, doc_id, score (inner product, rounded to five places), rank for ``queries`` (query_id, q). Filters run before
    the scores, so a filtered search is exact. Rows without a vector take no part."""
    if where is not None:
        vectors = vectors.where(where)
    known = vectors.where(F.col(vec).isNotNull()).select("doc_id", F.col(vec).alias("v"))
    asked = spread(queries.where("q is not null").select("query_id", "q"), DENSE_BLOCK)
    return searched(packed(known, CORPUS_BLOCK), packed(asked, DENSE_BLOCK), _dot, 5, top)


def conjunction(**equal: object) -> Column:
    return reduce(lambda a, b: a & b, (F.col(k) == v for k, v in equal.items()), F.lit(True))


def post_filter(docs: DataFrame, sources: list[str] | None = None, doc_types: list[str] | None = None, custom: dict[str, str] | None = None, doc_ids: list[str] | None = None) -> DataFrame:
    """Membership and string-equality filters; document ids are compared in their sanitised form; a missing value equals the
    empty string."""
    out = docs
    if doc_ids:
        out = out.where(sanitize_id(F.col("doc_id").cast("string")).isin(*(sanitize_id(F.lit(x)) for x in doc_ids)))
    if sources:
        out = out.where(F.col("source").isin(sources))
    if doc_types:
        out = out.where(F.col("doc_type").isin(doc_types))
    for k, v in (custom or {}).items():
        out = out.where(F.coalesce(F.col(k).cast("string"), F.lit("")) == v)
    return out


def filtered_search(vectors: DataFrame, queries: DataFrame, top: int = TOP_N, **lists: list) -> DataFrame:
    """Vector search under filters (column = list of values). Single values filter the vectors themselves; queries for which
    that finds nothing, and all queries when no filter has a single value, take the best max(15 top, 100) of all vectors,
    filtered afterwards. Blank queries are none."""
    single = {c: v[0] for c, v in lists.items() if len(v) == 1}
    asked = queries.where("q is not null")
    native = vector_topk(vectors, asked, top, conjunction(**single)) if single else None
    left = asked if native is None else asked.join(native.select("query_id").distinct(), "query_id", "left_anti")
    keep = reduce(lambda a, b: a & b, (F.col(c).isin(*v) for c, v in lists.items() if v), F.lit(True))
    wide = vector_topk(vectors, left, max(15 * top, 100)).drop("rank").join(vectors.where(keep).select("doc_id"), "doc_id", "left_semi")
    late = ranked(wide.select("query_id", "doc_id", "score"), "query_id", top)
    return late if native is None else native.unionByName(late)


def rrf(*lists: DataFrame, top: int = 10, k: int = RRF_K, by: str | None = None) -> DataFrame:
    """Reciprocal rank fusion of rank lists (doc_id, rank, and ``by`` if the fusion is per query): doc_id, rrf, rank. Among
    equals the one that an earlier list ranks first goes first."""
    own = [by] if by else []
    all_ = reduce(DataFrame.unionByName, (x.select(*own, "doc_id", "rank", F.lit(i).alias("list")) for i, x in enumerate(lists)))
    fused = all_.groupBy(*own, "doc_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 8).alias("rrf"), F.min(F.struct("list", "rank")).alias("seen"))
    order = [F.desc("rrf"), F.col("seen"), F.col("doc_id")]
    if by:
        return fused.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= top).drop("seen")
    best = fused.orderBy(*order).limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order))).drop("seen")  # ``top`` rows


def only_documents(found: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """A rank list (query_id, doc_id, rank) without documents outside ``doc_ids``, ranked anew: the filter comes after the cut."""
    kept = found.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def rerank_pool(top: int, intents: bool = True) -> int:
    """How many rows are reranked so that a boost can still move some up."""
    return max(2 * top, top + 3) if intents else top


def threshold_boost(docs: DataFrame, wanted_intent: str | None, top: int = 5, least: float = MIN_SCORE) -> DataFrame:
    """``docs`` (doc_id, score, intents, prev_rank): drop scores below ``least`` unless none reaches it, add BOOST where the
    intent matches, keep the best ``top``. A missing score is 1; a pool of a few rows, so one partition is right."""
    one = docs.withColumn("query_id", F.lit(0)).withColumn("wanted", F.lit(wanted_intent).cast("string"))
    return boosted(one, top, least).orderBy("rank").select("doc_id", "final")


def boosted(docs: DataFrame, top: int = 5, least: float = MIN_SCORE) -> DataFrame:
    """The rule of ``threshold_boost`` for each query_id of ``docs``, which also hold ``wanted``, the query's intent or null:
    query_id, doc_id, final, rank. Pools of some rows a query."""
    pool = Window.partitionBy("query_id")
    score = F.coalesce("score", F.lit(1.0))
    kept = docs.withColumn("score", score).withColumn("any", F.max(F.col("score") >= least).over(pool)).where((F.col("score") >= least) | ~F.col("any"))
    match = F.coalesce(F.array_contains("intents", F.col("wanted")), F.lit(False))
    scored = kept.withColumn("final", F.round(F.col("score") + F.when(match, BOOST).otherwise(0.0), 6))
    return scored.withColumn("rank", F.row_number().over(pool.orderBy(F.desc("final"), "prev_rank"))).where(F.col("rank") <= top).select("query_id", "doc_id", "final", "rank")


def page_window(matched: DataFrame, chunks: DataFrame, most: int = WINDOW_CHARS) -> DataFrame:
    """``matched`` (doc_id, page, chunk_id, content, rank, and query_id if there are several queries) -> per first match of a
    page its text followed by the page's other chunks in id order, up to the first that would exceed ``most`` characters.
    Blank and equal texts are skipped."""
    own = ["query_id"] if "query_id" in matched.columns else []
    first = matched.withColumn("k", F.row_number().over(Window.partitionBy(*own, "doc_id", "page").orderBy("rank"))).where("k = 1").drop("k")
    near = chunks.select("doc_id", "page", F.col("chunk_id").alias("near_id"), F.col("content").alias("near"))
    room = F.length("content") < most  # else nothing fits
    pairs = first.join(near, (first["doc_id"] == near["doc_id"]) & first["page"].eqNullSafe(near["page"]) & (F.trim("near") != "") & (F.col("near") != F.col("content")) & room, "left")
    fits = F.when(F.length("content") + F.length("near") <= most, F.col("near"))  # of others only the length counts
    pairs = pairs.select(*own, first["doc_id"], first["page"], "chunk_id", "content", "rank", "near_id", F.length("near").alias("size"), fits.alias("near"))
    running = F.sum("size").over(Window.partitionBy(*own, "chunk_id").orderBy("near_id").rowsBetween(Window.unboundedPreceding, 0))
    kept = pairs.withColumn("running", running).withColumn("near", F.when(F.length("content") + F.col("running") <= most, F.col("near")))
    parts = F.array_sort(F.collect_list(F.when(F.col("near").isNotNull(), F.struct("near_id", "near"))))  # at most ``most`` characters
    return kept.groupBy(*own, "doc_id", "page", "chunk_id", "rank", "content").agg(parts.alias("p")).select(
        *own, "doc_id", "page", "chunk_id", "rank", F.array_join(F.concat(F.array("content"), F.transform("p", lambda x: x["near"])), "\n\n").alias("window")
    )


def sources(found: DataFrame) -> DataFrame:
    """What is shown of the passages found (``window``, the original content or the text behind its contextual prefix)."""
    shown = strip_context(F.col("window"))
    if "orig_content" in found.columns:
        shown = F.coalesce(F.nullif(F.col("orig_content"), F.lit("")), shown)
    own = [c for c in ("query_id", "rank", "doc_id", "page", "chunk_id", "source") if c in found.columns]
    return found.select(*own, shown.alias("content"))


def context(sources: DataFrame, cut: int | None = None) -> DataFrame:
    """One row: the numbered sources (rank, doc_id, page, content) joined into the text of a prompt."""
    body = F.substring("content", 1, cut) if cut else F.col("content")
    line = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit("] doc="), F.col("doc_id").cast("string"), F.lit(" page="), F.coalesce(F.col("page").cast("string"), F.lit("?")), F.lit("\n"), body)
    rows = sources.select("rank", line.alias("line")).groupBy().agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("x"))
    return rows.select(F.array_join(F.transform("x", lambda r: r["line"]), "\n\n---\n\n").alias("context"))

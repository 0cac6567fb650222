"""Problem 3: stock lines repeated across the documents of one source.

Lines are parsed into templates in fixed-depth token trees, one tree a source. Case, digits, blanks and marks are no part of
a line's identity, so its letters are cut into tokens; the path to a leaf is (number of letters, first DEPTH tokens), and the
leaf holds a template of SLOTS further slots, each the token on which the leaf's lines agree or a wildcard where they differ.
A leaf's template covers the documents of all its lines.

Every step is an aggregate that merges: each partition grows its own trees (the partial aggregation), the shuffle on the
path merges leaf with leaf, and two templates merge slot by slot. Coverage is counted over (leaf, document) pairs made
distinct first, so that a template in every document of the largest source never meets in one task. Templates that cover
too few documents are dropped with all their lines: a line's documents are among its template's. The lines of the others are
stock lines where the template has no wildcard, since then its documents are theirs. Only lines of a template with a wildcard
go through an exact check, because there a line counts as often as its own letters.

Defined results: null or empty content has no lines; lines of documents without a listed source are never cases;
repeated rows count once per document; a source is compared without case and outer blanks; extra columns are kept, and
ones named like an added column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.textnorm import canonical_text
from folioforge.session import stage

DEPTH, TOKEN, SLOTS = 3, 6, 12  # tree depth in tokens, letters a token, slots of a template
MIN_DOCS, MIN_SHARE, MIN_LETTERS = 3, 0.2, 20


def letters(line: Column) -> Column:
    """The line's letters with their marks, lower case: what is left when every wildcard slot is empty."""
    return F.regexp_replace(F.lower(line), r"[^\p{L}\p{M}]+", "")


def tree_path(key: Column) -> list[Column]:
    return [F.length(key).alias("size"), *(F.substring(key, 1 + TOKEN * k, TOKEN).alias(f"token_{k + 1}") for k in range(DEPTH))]


def document_sources(meta: DataFrame) -> DataFrame:
    """One row per listed document and its source; a document listed under several sources goes to the first by name."""
    src = F.lower(F.trim(F.col("source")))
    return meta.where(F.col("doc_id").isNotNull() & src.isNotNull()).groupBy("doc_id").agg(F.min(src).alias("source"))


def slots(key: Column) -> Column:
    """The tokens behind the path, SLOTS of them; long lines have longer ones. Lines of a leaf are equally long."""
    rest = F.substring(key, 1 + TOKEN * DEPTH, 2**31 - 1)
    width = F.greatest(F.lit(TOKEN), F.ceil(F.length(rest) / SLOTS).cast("int"))
    return F.array(*(rest.substr(1 + width * k, width) for k in range(SLOTS)))


def parsed_lines(blocks: DataFrame, with_key: bool = False) -> DataFrame:
    """block_id, doc_id, line_no, the leaf of each line's place in the tree, and the fingerprint of its letters (two 64-bit
    halves)."""
    lines = blocks.where(F.col("content").isNotNull()).select(
        F.col("id").alias("block_id"), "doc_id", F.posexplode(F.split(canonical_text(F.col("content")), "\n", -1)).alias("pos", "line")
    )
    key = letters(F.col("line"))
    return (
        lines.where(F.col("line").rlike(rf"(?:\p{{L}}\P{{L}}*+){{{MIN_LETTERS}}}"))
        .select("block_id", "doc_id", (F.col("pos") + 1).alias("line_no"), key.alias("key"))
        .select("block_id", "doc_id", "line_no", F.xxhash64(*tree_path(F.col("key"))).alias("leaf"), F.xxhash64("key").alias("own"), F.xxhash64(F.reverse("key"), F.lit(7)).alias("rest"), *(["key"] if with_key else []))
    )


def _covering(lines: DataFrame, listed: DataFrame, min_docs: int, min_share: float, *keys: str) -> DataFrame:
    """source, ``keys``, docs of what stands in at least ``min_docs`` documents and ``min_share`` of the source's."""
    covers = lines.groupBy("source", *keys, "doc_id").agg(F.lit(1).alias("one")).groupBy("source", *keys).agg(F.count("*").alias("docs"))
    wide = covers.where(F.col("docs") >= min_docs).join(listed, "source").where(F.col("docs") >= min_share * F.col("listed") - 1e-9)
    return wide.select("source", *keys, "docs")


def _listed(meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    sources = document_sources(meta.select("doc_id", "source"))
    return sources, sources.groupBy("source").agg(F.count("*").alias("listed"))


def stock_lines(blocks: DataFrame, meta: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """block_id, doc_id, line_no, source of every line that stands in at least ``min_docs`` documents and ``min_share`` of
    the documents listed for its source: all lines of the templates that cover so many and have no wildcard, and those of
    the others that cover so many on their own."""
    sources, listed = _listed(meta)
    lines = stage(parsed_lines(blocks).join(sources, "doc_id"))
    templates = _covering(lines, listed, min_docs, min_share, "leaf").drop("docs")
    open_ = stage(lines.join(templates, ["source", "leaf"], "left_semi"))
    fixed = open_.groupBy("source", "leaf").agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ("own", "rest") for f in (F.min, F.max)))
    fixed = fixed.where("min_own = max_own and min_rest = max_rest").select("source", "leaf")
    mixed = open_.join(fixed, ["source", "leaf"], "left_anti")
    exact = _covering(mixed, listed, min_docs, min_share, "own", "rest").drop("docs")
    found = open_.join(fixed, ["source", "leaf"], "left_semi").unionByName(mixed.join(exact, ["source", "own", "rest"], "left_semi").select(*open_.columns))
    return found.select("block_id", "doc_id", "line_no", "source")


def templates(blocks: DataFrame, meta: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """source, template, docs, lines, fixed of the templates that cover enough documents: tokens joined, ``<*>`` for a
    wildcard slot; ``fixed`` is the share of the slots in use that are no wildcard."""
    sources, listed = _listed(meta)
    lines = parsed_lines(blocks, with_key=True).join(sources, "doc_id")
    lines = stage(lines.select("source", "doc_id", "leaf", F.substring("key", 1, TOKEN * DEPTH).alias("head"), slots(F.col("key")).alias("slot")))
    wide = _covering(lines, listed, min_docs, min_share, "leaf")
    at = [F.struct(F.min(F.col("slot")[k]).alias("low"), F.max(F.col("slot")[k]).alias("high")).alias(f"s{k}") for k in range(SLOTS)]
    grown = lines.groupBy("source", "leaf").agg(F.min("head").alias("head"), F.count("*").alias("lines"), *at)
    each = F.filter(F.array(*(f"s{k}" for k in range(SLOTS))), lambda s: s["high"] != "")
    text = F.transform("each", lambda s: F.when(s["low"] == s["high"], s["low"]).otherwise("<*>"))
    out = grown.join(wide, ["source", "leaf"]).withColumn("each", each).withColumn("text", text)
    fixed = F.when(F.size("text") > 0, F.round(F.size(F.filter("text", lambda x: x != "<*>")) / F.size("text"), 3)).otherwise(1.0)
    return out.select("source", F.array_join(F.concat(F.array("head"), F.col("text")), " ").alias("template"), "docs", "lines", fixed.alias("fixed"))


def without_stock_lines(blocks: DataFrame, meta: DataFrame) -> DataFrame:
    """``blocks`` with ``clean_content`` (stock lines removed, the other lines unchanged) and ``removed`` (how many)."""
    drop = stock_lines(blocks, meta).select("block_id", "line_no").distinct().groupBy(F.col("block_id").alias("__id")).agg(F.collect_list("line_no").alias("__drop"))
    joined = blocks.join(drop, F.col("id") == F.col("__id"), "left").drop("__id")
    none = F.array().cast("array<int>")
    kept = F.filter(F.split("content", "\n", -1), lambda _, i: ~F.array_contains(F.coalesce("__drop", none), i + 1))
    return joined.withColumn("clean_content", F.array_join(kept, "\n")).withColumn("removed", F.size(F.coalesce("__drop", none))).drop("__drop")

"""The pN_ queries of this subpackage: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import mixing, neardup, packing, pii, reading, scans, sitelines, splitting, textnorm
from folioforge.llm.tokens import token_count
from folioforge.session import stage, table

BLOCK = ("block", "text_blocks")
CHUNK = ("chunk", "chunks")


def _items(spark: SparkSession, d: str, *extra: str) -> DataFrame:
    """item_kind, item_id, content (and ``extra`` columns) of text blocks and chunks."""
    parts = []
    for kind, name in (BLOCK, CHUNK):
        t = table(spark, d, name)
        cols = [F.col(c) if c in t.columns else F.col("metadata.section").alias(c) for c in extra]
        parts.append(t.select(F.lit(kind).alias("item_kind"), F.col("id").alias("item_id"), "content", *cols))
    return parts[0].unionByName(parts[1])


def _limited(spark: SparkSession, d: str) -> DataFrame:
    limits = table(spark, d, "split_limits")  # a parameter table of two rows
    return _items(spark, d, "section").join(F.broadcast(limits), "item_kind")


def _copies(spark: SparkSession, d: str) -> DataFrame:
    chunks = neardup.text_sketches(table(spark, d, "chunks"), "chunk")
    tables = neardup.table_sketches(table(spark, d, "table_blocks"), "table")
    return neardup.copy_groups(chunks.unionByName(tables), {"chunk": 0.55, "table": 0.65})


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.copy_pairs(_copies(spark, d))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return _copies(spark, d)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    items = _limited(spark, d)
    return splitting.split_items(items.where(F.length("content") > F.col("max_chars"))).where("n_pieces > 1").select("item_kind", "item_id").distinct()


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    items = _limited(spark, d).dropDuplicates(["item_kind", "item_id"])
    return splitting.split_items(items).select("item_kind", "item_id", "section", "piece_no", "n_pieces", "piece_start", "piece_end", "content")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return sitelines.stock_lines(table(spark, d, "text_blocks").select("id", "doc_id", "content"), table(spark, d, "doc_metadata")).select("block_id", "line_no").distinct()


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "text_blocks").select("id", "doc_id", "content")
    return sitelines.without_stock_lines(blocks, table(spark, d, "doc_metadata")).select("id", "doc_id", "clean_content", "removed")


def p3_templates(spark: SparkSession, d: str) -> DataFrame:
    return sitelines.templates(table(spark, d, "text_blocks").select("id", "doc_id", "content"), table(spark, d, "doc_metadata"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return textnorm.irregular(_items(spark, d), "content").select("item_kind", "item_id").distinct()


def p4_canonical(spark: SparkSession, d: str) -> DataFrame:
    return textnorm.with_canonical(_items(spark, d), "content").select("item_kind", "item_id", "canonical", "forms")


def p4_confusables(spark: SparkSession, d: str) -> DataFrame:
    return textnorm.confusable_words(_items(spark, d), "content").select("item_kind", "item_id", "words")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.defects(table(spark, d, "text_blocks")).select("block_id", "defect")


def p5_text(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired(table(spark, d, "text_blocks"))


def _details(spark: SparkSession, d: str) -> tuple[DataFrame, pii.Model]:
    """Blocks and tables as items, and the one model that all p6 queries use."""
    items = pii.text_items(table(spark, d, "text_blocks"), table(spark, d, "table_blocks"))
    return items, pii.fitted(items.select("text"), table(spark, d, "name_lexicon"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    items, model = _details(spark, d)
    return pii.found(items, table(spark, d, "name_lexicon"), model)


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted_texts(table(spark, d, "text_blocks"), table(spark, d, "name_lexicon"), _details(spark, d)[1])


def p6_redacted_tables(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted_tables(table(spark, d, "table_blocks"), table(spark, d, "name_lexicon"), _details(spark, d)[1])


def _sized(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, source, tokens of the whole texts, counted once."""
    return stage(table(spark, d, "documents").select("doc_id", "source", token_count(F.col("text")).alias("tokens")))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_sized(spark, d).select(F.col("doc_id").alias("item_id"), "tokens"), table(spark, d, "pack_specs")).withColumnRenamed("item_id", "doc_id")


def p7_unused(spark: SparkSession, d: str) -> DataFrame:
    return packing.unused(p7_containers(spark, d))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_sized(spark, d), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(*mixing.mix(_sized(spark, d), table(spark, d, "mix_targets")))


def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_levels(spark, d).where("level = 'demanding'").select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_pieces, p3_found, p3_clean, p3_templates, p4_found, p4_canonical, p4_confusables, p5_found, p5_text, p6_found, p6_redacted, p6_redacted_tables, p7_containers, p7_unused, p8_mix, p8_shares, p9_found, p9_levels)}

ORACLES = {
    "p2_found": """SELECT DISTINCT item_kind, item_id FROM (
        SELECT 'block' AS item_kind, id AS item_id, content FROM text_blocks
        UNION ALL SELECT 'chunk', id, content FROM chunks) JOIN split_limits USING (item_kind)
        WHERE length(content) > max_chars""",
}

"""Validation rules of documents and their blocks, as one issue row per finding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import strip


def _issues(rows: DataFrame, *rules: tuple[str, str, Column], doc: str = "doc_id", item: str | None = "id") -> DataFrame:
    found = F.array_compact(F.array(*(F.when(cond, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"))) for level, code, cond in rules)))
    return rows.select(F.col(doc).alias("doc_id"), (F.col(item) if item else F.lit(None).cast("string")).alias("item_id"), F.explode(found).alias("x")).select("doc_id", "item_id", "x.level", "x.code")


def _lacks(rows: DataFrame, key: str) -> Column:
    """Whether ``extra`` has no such key."""
    return ~F.coalesce(F.map_contains_key("extra", key), F.lit(False)) if "extra" in rows.columns else F.lit(True)


def _elsewhere(rows: DataFrame, kind: str) -> list[tuple[str, str, Column]]:
    """Rows that name another document than the bundle they lie in (column ``bundle``, where there is one)."""
    return [("warning", f"{kind}_DOC_ID_MISMATCH", (F.col("doc_id") != "") & (F.col("bundle") != "") & (F.col("doc_id") != F.col("bundle")))] if "bundle" in rows.columns else []


def _empty(c: str) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def _placed(rows: DataFrame, meta: DataFrame) -> DataFrame:
    return rows.join(meta.groupBy("doc_id").agg(F.max("page_count").alias("page_count")), "doc_id", "left")


def _duplicates(rows: DataFrame, code: str) -> DataFrame:
    """Ids that stand on several rows, counted over whole rows."""
    twice = rows.groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).where("n > 1 and id is not null")
    return twice.select("doc_id", F.col("id").alias("item_id"), F.lit("warning").alias("level"), F.lit(code).alias("code"))


def page_range(meta: DataFrame, *placed: DataFrame) -> DataFrame:
    """First and last page of every listed document over its texts, tables and images."""
    pages = reduce(DataFrame.unionByName, (t.select("doc_id", "page") for t in placed)).groupBy("doc_id").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"))
    return meta.select("doc_id").distinct().join(pages, "doc_id", "left")


def validate(meta: DataFrame, texts: DataFrame, tables: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """doc_id, item_id, level, code of every finding."""
    placed = [t.select("doc_id", "page") for t in (texts, tables, images) if t is not None]
    top = reduce(DataFrame.unionByName, placed).groupBy("doc_id").agg(F.max("page").alias("max_page"))
    m = meta.join(top, "doc_id", "left").join(texts.select("doc_id").distinct().withColumn("has_text", F.lit(True)), "doc_id", "left")
    n = F.col("page_count")
    out = [
        _issues(
            m,
            ("error", "MISSING_DOC_ID", _empty("doc_id")),
            ("warning", "MISSING_FILE_NAME", _empty("file_name")),
            ("warning", "MISSING_PAGE_COUNT", n.isNull() & F.col("max_page").isNotNull()),
            ("warning", "INVALID_PAGE_COUNT", n <= 0),
            ("warning", "PAGE_COUNT_MISMATCH", (n > 0) & (F.col("max_page") > n)),
            ("error", "NO_TEXT_BLOCKS", F.col("has_text").isNull()),
            item=None,
        ),
        _duplicates(texts, "DUPLICATE_TEXT_ID"),
        _duplicates(tables, "DUPLICATE_TABLE_ID"),
    ]
    t = _placed(texts, meta)
    place = lambda kind: (("warning", f"{kind}_PAGE_INVALID", F.col("page") <= 0), ("warning", f"{kind}_PAGE_OUT_OF_RANGE", (F.col("page") > n) & (n > 0)))
    box = lambda kind: ("warning", f"{kind}_BBOX_INVALID", F.size("bbox") != 4)
    out.append(
        _issues(
            t,
            *place("TEXT"),
            ("info", "TEXT_BLOCK_VERY_LONG", F.length("content") > 8000),
            ("info", "TEXT_BLOCK_VERY_SHORT", F.length(strip(F.col("content"))) < 2),
            box("TEXT"),
            ("info", "TEXT_NO_SECTION", _lacks(texts, "section")),
            ("info", "TEXT_NO_ROLE", _lacks(texts, "role")),
            *_elsewhere(texts, "TEXT"),
        )
    )
    b = _placed(tables, meta)
    cols, rows = F.coalesce(F.size("columns"), F.lit(0)), F.coalesce(F.size("rows"), F.lit(0))
    out.append(
        _issues(
            b,
            *place("TABLE"),
            ("warning", "TABLE_NO_HEADER", (cols <= 0) & (rows > 0)),
            ("warning", "TABLE_NO_ROWS", (rows <= 0) & (cols > 0)),
            box("TABLE"),
            ("info", "TABLE_NO_CATEGORY", F.coalesce("category", F.lit("")) == ""),
            ("info", "TABLE_NO_ROLE", _lacks(tables, "role")),
            *_elsewhere(tables, "TABLE"),
        )
    )
    ragged = tables.where("size(columns) > 0").select("doc_id", "id", F.size("columns").alias("n"), F.explode("rows").alias("row")).where(F.size("row") != F.col("n"))
    out.append(ragged.select("doc_id", F.col("id").alias("item_id"), F.lit("warning").alias("level"), F.lit("ROW_LEN_MISMATCH").alias("code")))
    if images is not None:
        out.append(_issues(_placed(images, meta), *place("IMAGE"), ("warning", "IMAGE_NO_PATH", _empty("file_path")), *_elsewhere(images, "IMAGE")))
        out.append(_duplicates(images, "DUPLICATE_IMAGE_ID"))
    return reduce(DataFrame.unionByName, out)

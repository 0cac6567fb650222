"""From extracted layout to blocks and chunks: pages, text items, tables, images, recognised text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import classify as C
from folioforge.functions.text import blank_to_null, meaningful_marks, meaningful_words, normal_string, normalize_whitespace, printable, section_title, strip
from folioforge.operators.blocks import carried, margins

#: A page of extracted layout: text blocks (type 0) hold lines of spans with their font size.
LAYOUT = "doc_id string, page int, blocks array<struct<type:int, bbox:array<double>, lines:array<struct<spans:array<struct<text:string, size:double>>>>>>"
QNA = r"(?is)(?:ถาม|q|question)\s*[:\-].+?(?:ตอบ|a|answer)\s*[:\-]"
ASKS, ANSWERS = r"(?i)(?:ถาม|q|question)\s*[:\-]", r"(?i)(?:ตอบ|a|answer)\s*[:\-]"


def layout_blocks(pages: DataFrame, height: float = 842.0) -> DataFrame:
    """Text blocks of extracted pages: spans joined, mean font, headings by the page's median font, running headers and
    footers and meaningless blocks dropped, section carried on, ids numbered within the document."""
    b = pages.select("doc_id", "page", F.posexplode("blocks").alias("place", "b")).where("b.type = 0")
    spans = F.filter(F.flatten(F.transform("b.lines", lambda x: x["spans"])), lambda s: F.trim(s["text"]) != "")
    b = b.select("doc_id", "page", "place", F.col("b.bbox").alias("bbox"), spans.alias("spans"))
    median = b.select("doc_id", "page", F.explode("spans").alias("s")).groupBy("doc_id", "page").agg(F.median("s.size").alias("page_font"))
    mean = F.aggregate("spans", F.lit(0.0), lambda a, s: a + F.coalesce(s["size"], F.lit(0.0)), lambda a: a / F.greatest(F.size("spans"), F.lit(1)))
    text = printable(F.array_join(F.transform("spans", lambda s: strip(s["text"])), " "))
    b = margins(b.select("doc_id", "page", "place", "bbox", text.alias("content"), mean.alias("font")), height).where((F.col("margin") == "body") & meaningful_marks(F.col("content")))
    b = b.join(median, ["doc_id", "page"], "left").withColumn("page_font", F.coalesce("page_font", F.lit(10.0)))
    big = (F.length("content") < 200) & ~F.col("content").rlike(r"^[0-9.,\s]+$")
    level = F.when(big & (F.col("font") > 1.5 * F.col("page_font")), "H1").when(big & (F.col("font") > 1.2 * F.col("page_font")), "H2")
    b = b.withColumn("heading_level", level).withColumn("block_type", F.when(level.isNotNull(), "heading").otherwise(C.block_type(F.col("content"))))
    b = carried(b, F.when(F.col("heading_level").isNotNull(), F.nullif(section_title(F.col("content")), F.lit(""))), "section", inclusive=True, order="place")
    return numbered(b, "txt_%04d").select("doc_id", "page", "id", "content", "section", "font", "heading_level", "block_type", "bbox")


def numbered(rows: DataFrame, form: str, doc: str = "doc_id", page: str = "page", order: str = "place") -> DataFrame:
    """``rows`` with ``id``, numbered from 1 in a document: ranks inside pages and counts of the pages before, so that no
    document is sorted as a whole."""
    p = F.coalesce(page, F.lit(1))
    d = rows.withColumn("__p", p)
    before = Window.partitionBy(doc).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    counts = d.groupBy(doc, "__p").agg(F.count("*").alias("__n")).select(doc, "__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    at = F.row_number().over(Window.partitionBy(doc, "__p").orderBy(order))
    return d.withColumn("__at", at).join(counts, [doc, "__p"]).withColumn("id", F.format_string(form, (F.col("__at") + F.col("__before")).cast("int"))).drop("__p", "__at", "__before")


def text_items(items: DataFrame) -> DataFrame:
    """Blocks of a document's text items (doc_id, place, text, page, bbox): blank ones dropped, page 1 where none is known."""
    rows = items.where(strip(F.col("text")) != "")
    return rows.select("doc_id", F.concat(F.lit("text_"), F.col("place").cast("string")).alias("id"), F.col("text").alias("content"), F.coalesce("page", F.lit(1)).alias("page"), "bbox", F.lit("paragraph").alias("role"))


def table_images(tables: DataFrame) -> DataFrame:
    """An image block per table with a picture (doc_id, place, page, markdown, image_path, bbox), captioned by its content."""
    caption = F.concat(F.lit("Table "), (F.col("place") + 1).cast("string"), F.lit(": "), F.replace(F.substring(F.coalesce("markdown", F.lit("")), 1, 300), F.lit("\n"), F.lit(" ")), F.lit("..."))
    rows = tables.where("image_path is not null")
    return rows.select(F.concat(F.lit("img_tbl_"), F.col("place").cast("string")).alias("id"), "doc_id", F.coalesce("page", F.lit(1)).alias("page"), F.col("image_path").alias("file_path"), caption.alias("caption"), F.lit("table").alias("section"), F.lit("table_image").alias("category"), "bbox")


def recognised(texts: DataFrame, pages: DataFrame) -> DataFrame:
    """``texts`` (id, doc_id, page, content) with those of a document replaced by what recognition read on its ``pages``
    (doc_id, page, content), if it read anything; documents without recognised text keep theirs."""
    read = pages.where(blank_to_null(F.col("content")).isNotNull()).select(F.concat(F.lit("ocr_"), F.col("page").cast("string")).alias("id"), "doc_id", "page", "content")
    kept = texts.select("id", "doc_id", "page", "content").join(read.select("doc_id").distinct(), "doc_id", "left_anti")
    return kept.select("id", "doc_id", "page", "content").unionByName(read)


def filled_from_metadata(rows: DataFrame, meta: DataFrame) -> DataFrame:
    """doc_id and doc_type of rows that lack them from the metadata of their ``folder``; a metadata's own doc_id goes before
    the folder's name."""
    m = meta.groupBy("folder").agg(F.max("doc_id").alias("__doc"), F.max("doc_type").alias("__type"))
    out = rows.join(m, "folder", "left")
    return out.withColumns({"doc_id": F.coalesce("doc_id", "__doc", "folder"), "doc_type": F.coalesce("doc_type", "__type", F.lit("generic"))}).drop("__doc", "__type")


def header_row(tables: DataFrame) -> DataFrame:
    """id, header, rows of raw tables (id, rows): the row with most meaningful cells of the first three is the header, the first
    of equals; what stands above it goes, as do rows without a meaningful cell."""
    told = lambda c: F.coalesce(c.rlike(r"[\p{L}\p{N}]"), F.lit(False))
    some = F.filter("rows", lambda r: F.exists(r, told))
    scores = F.transform(F.slice("some", 1, 3), lambda r: F.size(F.filter(r, told)))
    at = F.array_position("scores", F.array_max("scores")).cast("int")
    clean = lambda r: F.transform(r, lambda c: F.coalesce(strip(c), F.lit("")))
    t = tables.where("rows is not null").select("id", some.alias("some")).where("size(some) > 0").withColumn("scores", scores).withColumn("at", at)
    return t.select("id", clean(F.element_at("some", F.col("at"))).alias("header"), F.transform(F.slice("some", F.col("at") + 1, F.greatest(F.lit(0), F.size("some") - F.col("at"))), clean).alias("rows"))


def is_table(columns: Column, rows: Column) -> Column:
    """Whether an extracted table is one: more than one row, at least two columns, not a header alone."""
    return (F.coalesce(F.size(rows), F.lit(0)) > 1) & (F.coalesce(F.size(columns), F.lit(0)) >= 2)


def row_hash(rows: Column) -> Column:
    """Fingerprint of a table's cells."""
    return F.md5(F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(strip(c), F.lit(""))), "\u001f")), "\u001e"))


def first_tables(tables: DataFrame, strategy: Column) -> DataFrame:
    """One table per document and content: of the strategy that goes first, then the smallest id. Copies fall together in an
    aggregation."""
    keyed = tables.where("rows is not null").select("doc_id", row_hash(F.col("rows")).alias("content_hash"), F.struct(strategy.alias("s"), "id").alias("x"))
    return keyed.groupBy("doc_id", "content_hash").agg(F.min("x").alias("x"), F.count("*").alias("found")).select("doc_id", F.col("x.id").alias("id"), "content_hash", "found")


def table_extra(tables: DataFrame) -> DataFrame:
    """Summary, category, texts, role and picture of tables: what extra says, else the column, else a default."""
    e = lambda k: F.nullif(F.col("extra")[k], F.lit(""))
    first = lambda *c: F.coalesce(*(F.nullif(x, F.lit("")) if isinstance(x, Column) else F.nullif(F.col(x), F.lit("")) for x in c), F.lit(""))
    return tables.select(
        "id", strip(first(e("summary"))).alias("summary"), F.lower(strip(F.coalesce(e("category"), F.nullif("category", F.lit("")), F.lit("general")))).alias("category"),
        strip(first(e("markdown_content"), e("markdown"), "markdown")).alias("markdown_content"), strip(first(e("html_content"), e("html"), "html_content")).alias("html_content"),
        F.lower(strip(first(e("role"), "role"))).alias("role"), F.coalesce(F.nullif("image_path", F.lit("")), e("image_path")).alias("image_path"),
        F.coalesce("is_complex", F.col("extra")["is_complex"] == "true", F.lit(False)).alias("is_complex"),
    )


def image_chunks(images: DataFrame) -> DataFrame:
    """Chunks of images with a meaningful caption (the text's frame is fixed)."""
    text = normalize_whitespace(F.coalesce("caption", F.lit("")))
    path = F.replace(F.coalesce("file_path", F.lit("")), F.lit("\\"), F.lit("/"))
    shown = F.concat(F.lit("🖼️ [Image Info]\nPath: "), path, F.lit("\nPage: "), F.coalesce(F.nullif(F.col("page"), F.lit(0)).cast("string"), F.lit("?")), F.lit("\nDescription: "), F.col("text"))
    names = C.intents(F.col("text"), F.lit("Image"))
    rows = images.withColumn("text", text).where(meaningful_words(F.col("text")))
    return rows.select(F.concat("doc_id", F.lit("::image::"), "id").alias("id"), "doc_id", F.lit("image").alias("source"), "page", shown.alias("content"), F.array_join(names, ",").alias("intents"))


def all_chunks(*parts: DataFrame) -> DataFrame:
    """Text, table and image chunks (id, doc_id, source, page, content) as one collection."""
    return reduce(DataFrame.unionByName, (p.select("id", "doc_id", "source", "page", "content") for p in parts))


def qna_documents(blocks: DataFrame) -> DataFrame:
    """doc_id of documents in which an answer follows a question (the pattern QNA over all their text). No document is joined
    up: a question and an answer of one block are matched there, those of two by the first asking and the last answering
    block; a mark cut by a block's end is not seen."""
    c = F.col("content")
    at = F.struct(F.coalesce("page", F.lit(1)).alias("p"), "id")
    b = blocks.where("content is not null").select("doc_id", c.rlike(QNA).alias("inside"), F.when(c.rlike(ASKS), at).alias("ask"), F.when(c.rlike(ANSWERS), at).alias("answer"))
    d = b.groupBy("doc_id").agg(F.max("inside").alias("inside"), F.min("ask").alias("ask"), F.max("answer").alias("answer"))
    return d.where(F.col("inside") | (F.col("answer") > F.col("ask"))).select("doc_id")


def previews(blocks: DataFrame, most_blocks: int = 20, most_chars: int = 2000) -> DataFrame:
    """doc_id and the text by which a document is classified: its first blocks, up to the first with which more than
    ``most_chars`` characters are reached. Only the first blocks of a document are kept while they are looked for."""
    at = F.struct(F.coalesce("page", F.lit(1)).alias("p"), "id", strip(F.col("content")).alias("text"))
    w = Window.partitionBy("doc_id").orderBy("x.p", "x.id")
    first = blocks.where("content is not null").select("doc_id", at.alias("x")).withColumn("k", F.row_number().over(w)).where(F.col("k") <= most_blocks).where("x.text <> ''")
    sized = first.withColumn("before", F.coalesce(F.sum(F.length("x.text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("before") <= most_chars)
    return sized.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("k", "x.text"))).alias("p")).select("doc_id", F.array_join(F.transform("p", lambda r: r["text"]), "\n").alias("preview"))


def page_layout(pages: DataFrame, boxes: DataFrame, sizes: DataFrame, default: tuple[float, float] = (595.0, 842.0)) -> DataFrame:
    """Each page (doc_id, page) with its boxes (an empty list where there are none) and its size."""
    b = boxes.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("id", "bbox"))).alias("boxes"))  # boxes of one page
    none = F.array().cast(b.schema["boxes"].dataType)
    out = pages.join(b, ["doc_id", "page"], "left").join(sizes, ["doc_id", "page"], "left")
    return out.select("doc_id", "page", F.coalesce("boxes", none).alias("boxes"), *(F.coalesce(c, F.lit(v)).alias(c) for c, v in zip(("width", "height"), default)))


def image_box(box: Column, width: Column, height: Column, pixels: tuple[int, int], bottom_left: bool = True) -> Column:
    """A box of page units in pixels, from the top; turned corners are put right."""
    x = [box[k] / width * pixels[0] for k in (0, 2)]
    y = [(height - box[k] if bottom_left else box[k]) / height * pixels[1] for k in (1, 3)]
    return F.array(F.least(*x), F.least(*y), F.greatest(*x), F.greatest(*y))


def normal_block(rows: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Semantic strings of blocks in one form: lower case without outer blanks, null for nothing, known block types only."""
    kind = normal_string(F.col("extra")["block_type"])
    return rows.select("id", normal_string(F.col("section")).alias("section"), normal_string(F.col("role")).alias("role"), F.when(kind.isin(*types), kind).otherwise("normal").alias("block_type"), F.coalesce(F.size("bbox") == 4, F.lit(False)).alias("has_box"))

"""Queries of the intake: layout, images, tables, recognised text, classification."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioforge.functions import classify as C
from folioforge.functions import models as L
from folioforge.functions import text as X
from folioforge.operators import blocks as B
from folioforge.operators import intake as I
from folioforge.operators import store as S
from folioforge.operators import tables as T
from folioforge.operators.validation import page_range, validate
from folioforge.plans.registry import BLOCKS, CHUNKS, TABLES, any_of, blocks_of, chunks_of, images_of, query, sql_printable, sql_strip, sql_thai_spacing, tables_of
from folioforge.session import table

_IMAGES = f"(SELECT id, doc_id, page, image_path AS file_path, name AS caption, bbox FROM {TABLES} WHERE image_path IS NOT NULL)"
_FONT = "coalesce(TRY_CAST(extra['font_size'] AS DOUBLE), 10)"
_LINES = f"list_filter(list_transform(string_split(content, chr(10)), lambda x: {sql_strip('x')}), lambda x: x <> '')"


def _pages(spark, d):
    """Blocks as extracted pages: every line a span in the block's font."""
    size = F.coalesce(F.col("extra")["font_size"].try_cast("double"), F.lit(10.0))
    lines = F.transform(F.split("content", "\n", -1), lambda x: F.struct(F.array(F.struct(x.alias("text"), size.alias("size"))).alias("spans")))
    b = blocks_of(spark, d).where("content is not null").select("doc_id", F.coalesce("page", F.lit(1)).alias("page"), F.struct("id", F.lit(0).alias("type"), "bbox", lines.alias("lines")).alias("x"))
    blocks = F.transform(F.array_sort(F.collect_list("x")), lambda x: F.struct(x["type"].alias("type"), x["bbox"].alias("bbox"), x["lines"].alias("lines")))
    return b.groupBy("doc_id", "page").agg(blocks.alias("blocks"))


@query(
    f"""WITH b AS (SELECT doc_id, coalesce(page, 1) AS page, id, bbox, {_FONT} AS font, {_LINES} AS lines FROM {BLOCKS} WHERE content IS NOT NULL),
      m AS (SELECT doc_id, page, median(font) AS page_font FROM (SELECT doc_id, page, font, unnest(lines) FROM b) GROUP BY ALL),
      c AS (SELECT b.doc_id, b.page, b.id AS k, CASE WHEN len(lines) > 0 THEN font ELSE 0 END AS font, coalesce(page_font, 10) AS page_font, {sql_printable("array_to_string(lines, ' ')")} AS content FROM b LEFT JOIN m USING (doc_id, page)
        WHERE NOT coalesce(bbox[4] < 0.07 * 842.0, FALSE) AND NOT coalesce(bbox[2] > 0.93 * 842.0, FALSE)),
      h AS (SELECT *, CASE WHEN length(content) < 200 AND NOT regexp_matches(content, '^[0-9.,\\s]+$') THEN CASE WHEN font > 1.5 * page_font THEN 'H1' WHEN font > 1.2 * page_font THEN 'H2' END END AS heading_level FROM c WHERE len(regexp_extract_all(content, '[A-Za-z0-9฀-๿]')) >= 2)
      SELECT doc_id, page, printf('txt_%04d', row_number() OVER w) AS id, md5(content) AS digest, font, heading_level,
        last_value(CASE WHEN heading_level IS NOT NULL THEN nullif(left(regexp_replace(regexp_replace(content, '^(?:[0-9]+(?:[.][0-9]+)*|[A-Z])[.)]\\s*', ''), '[\\s\\p{{Z}}]+', ' ', 'g'), 150), '') END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section
      FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY page, k)"""
)
def layout_blocks(spark, d):
    b = I.layout_blocks(_pages(spark, d))
    return b.select("doc_id", "page", "id", F.md5("content").alias("digest"), "font", "heading_level", "section")


@query(f"SELECT doc_id, 'text_' || k AS id, coalesce(page, 1) AS page, length(content) AS n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, coalesce(page, 1) ORDER BY id) AS k FROM {BLOCKS}) WHERE {sql_strip('content')} <> ''")
def text_items(spark, d):
    w = Window.partitionBy("doc_id", F.coalesce("page", F.lit(1))).orderBy("id")
    items = blocks_of(spark, d).select("doc_id", F.row_number().over(w).alias("place"), F.col("content").alias("text"), "page", "bbox")
    return I.text_items(items).select("doc_id", "id", "page", F.length("content").alias("n"))


@query(f"SELECT 'img_tbl_' || k AS id, doc_id, coalesce(page, 1) AS page, image_path AS file_path, 'Table ' || (k + 1) || ': ' || replace(left(coalesce(markdown, ''), 300), chr(10), ' ') || '...' AS caption FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY id) - 1 AS k FROM {TABLES}) WHERE image_path IS NOT NULL")
def table_images(spark, d):
    t = tables_of(spark, d).withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("id")) - 1)
    return I.table_images(t).select("id", "doc_id", "page", "file_path", "caption")


_READ = "(SELECT 'ocr_' || page AS id, doc_id, page, min(content) AS content FROM chunks WHERE source = 'text' AND page IS NOT NULL AND trim(content) <> '' GROUP BY doc_id, page)"


@query(f"SELECT id, doc_id, page, md5(content) AS digest FROM (SELECT id, doc_id, page, content FROM {BLOCKS} WHERE doc_id NOT IN (SELECT doc_id FROM {_READ}) UNION ALL SELECT * FROM {_READ})")
def recognised_text(spark, d):
    """What recognition read replaces a document's text; the text chunks of pages stand in for it."""
    pages = table(spark, d, "chunks").where("source = 'text' and page is not null and trim(content) <> ''").groupBy("doc_id", "page").agg(F.min("content").alias("content"))
    return I.recognised(blocks_of(spark, d), pages).select("id", "doc_id", "page", F.md5("content").alias("digest"))


@query(f"SELECT id, kind FROM (SELECT id, 'text' AS kind FROM {BLOCKS} UNION ALL SELECT id, 'image' FROM {_IMAGES} UNION ALL SELECT id, 'table' FROM {TABLES})")
def appended_blocks(spark, d):
    """Images and tables appended to a document's blocks."""
    kinds = (("text", blocks_of(spark, d)), ("image", images_of(spark, d)), ("table", tables_of(spark, d)))
    parts = [t.select("id", F.lit(k).alias("kind")) for k, t in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT DISTINCT doc_id AS name FROM (SELECT doc_id FROM doc_metadata UNION SELECT doc_id FROM text_blocks) WHERE doc_id IS NOT NULL")
def document_list(spark, d):
    names = table(spark, d, "doc_metadata").select("doc_id").unionByName(table(spark, d, "text_blocks").select("doc_id"))
    return names.where("doc_id is not null").distinct().select(F.col("doc_id").alias("name")).orderBy("name")


@query("SELECT c.id, coalesce(c.doc_id, m.doc_id) AS doc_id, coalesce(nullif(c.doc_type, ''), m.doc_type, 'generic') AS doc_type FROM chunks c LEFT JOIN (SELECT doc_id, max(doc_type) AS doc_type FROM doc_metadata GROUP BY 1) m ON c.doc_id = m.doc_id")
def metadata_fill(spark, d):
    """Rows that lack their document's id or type take them from its metadata."""
    rows = table(spark, d, "chunks").select("id", "doc_id", F.nullif("doc_type", F.lit("")).alias("doc_type"), F.col("doc_id").alias("folder"))
    meta = table(spark, d, "doc_metadata").select(F.col("doc_id").alias("folder"), "doc_id", "doc_type")
    return I.filled_from_metadata(rows, meta).select("id", "doc_id", "doc_type")


_TOLD = "len(list_filter(r, lambda c: regexp_matches(c, '[\\p{L}\\p{N}]')))"


@query(
    f"""WITH r AS (SELECT id, r, {_TOLD} AS score, row_number() OVER (PARTITION BY id ORDER BY k) AS i FROM (SELECT id, unnest(rows) AS r, unnest(range(len(rows))) AS k FROM {TABLES}) WHERE {_TOLD} > 0),
      h AS (SELECT id, arg_min(i, (-score, i)) AS head_at FROM r WHERE i <= 3 GROUP BY id)
      SELECT id, array_to_string(list_transform(any_value(r.r) FILTER (r.i = head_at), lambda c: coalesce({sql_strip('c')}, '')), '|') AS header, count(*) FILTER (r.i > head_at) AS n_rows FROM r JOIN h USING (id) GROUP BY id"""
)
def header_row(spark, d):
    return I.header_row(tables_of(spark, d)).select("id", F.array_join("header", "|").alias("header"), F.size("rows").cast("long").alias("n_rows"))


@query(f"SELECT id FROM {TABLES} WHERE coalesce(len(rows), 0) > 1 AND coalesce(len(columns), 0) >= 2")
def real_tables(spark, d):
    return tables_of(spark, d).where(I.is_table(F.col("columns"), F.col("rows"))).select("id")


@query(f"SELECT doc_id, arg_min(id, (CASE WHEN method = 'vision' THEN 0 WHEN method = 'lattice' THEN 1 ELSE 2 END, id)) AS id, count(*) AS found FROM (SELECT *, array_to_string(list_transform(rows, lambda r: array_to_string(list_transform(r, lambda c: coalesce({sql_strip('c')}, '')), chr(31))), chr(30)) AS h FROM {TABLES} WHERE rows IS NOT NULL) GROUP BY doc_id, h")
def first_tables(spark, d):
    rank = F.when(F.col("method") == "vision", 0).when(F.col("method") == "lattice", 1).otherwise(2)
    return I.first_tables(tables_of(spark, d), rank).select("doc_id", "id", "found")


@query(f"SELECT id, doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page NULLS FIRST, id) AS INT) AS place FROM {TABLES}")
def tables_in_order(spark, d):
    return tables_of(spark, d).withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "id"))).select("id", "doc_id", "place")


@query(
    f"""SELECT id, {sql_strip("coalesce(nullif(extra['summary'], ''), '')")} AS summary, lower({sql_strip("coalesce(nullif(extra['category'], ''), nullif(category, ''), 'general')")}) AS category, {sql_strip("coalesce(nullif(markdown, ''), '')")} AS markdown_content,
       {sql_strip("coalesce(nullif(html_content, ''), '')")} AS html_content, lower({sql_strip("coalesce(nullif(role, ''), '')")}) AS role, nullif(image_path, '') AS image_path, coalesce(is_complex, FALSE) AS is_complex FROM {TABLES}"""
)
def table_extra(spark, d):
    return I.table_extra(tables_of(spark, d))


_CAPTION = "trim(coalesce(caption, ''))"
_HIT = ", ".join(f"CASE WHEN regexp_matches(lower({_CAPTION} || ' Image'), '{p}') THEN '{n}' END" for n, (p, _s, _q) in sorted(C.INTENTS.items(), key=lambda x: -x[1][1]))
_IMAGE_CHUNKS = f"""SELECT doc_id || '::image::' || id AS id, doc_id, 'image' AS source, page, '🖼️ [Image Info]' || chr(10) || 'Path: ' || replace(coalesce(file_path, ''), '\\', '/') || chr(10) || 'Page: ' || coalesce(CAST(nullif(page, 0) AS VARCHAR), '?') || chr(10) || 'Description: ' || {_CAPTION} AS content,
       coalesce(nullif(array_to_string(list_filter([{_HIT}], lambda x: x IS NOT NULL)[:5], ','), ''), 'general') AS intents FROM {_IMAGES} WHERE regexp_matches({_CAPTION}, '[A-Za-z0-9_฀-๿]{{3,}}')"""


@query(_IMAGE_CHUNKS)
def image_chunks(spark, d):
    return I.image_chunks(images_of(spark, d))


_TABLE_TEXT = "coalesce(CASE WHEN {s} <> '' THEN markdown END, array_to_string(list_concat([array_to_string(columns, ' | ')], list_transform(rows[:5], lambda r: array_to_string(list_transform(r, lambda c: coalesce(c, '')), ' | '))), chr(10)))".format(s=sql_strip("markdown"))


@query(
    f"""SELECT id, doc_id, source, page, md5(content) AS digest FROM (SELECT doc_id || '::text::' || id AS id, doc_id, 'text' AS source, page, content FROM {CHUNKS}
       UNION ALL SELECT doc_id || '::table::' || id, doc_id, 'table', page, t FROM (SELECT *, {_TABLE_TEXT} AS t FROM {TABLES}) WHERE {sql_strip('t')} <> '' UNION ALL SELECT id, doc_id, source, page, content FROM ({_IMAGE_CHUNKS}))"""
)
def all_chunks(spark, d):
    """Text, table and image chunks as one collection, as they are indexed."""
    t = chunks_of(spark, d).select(F.concat("doc_id", F.lit("::text::"), "id").alias("id"), "doc_id", F.lit("text").alias("source"), "page", "content")
    text = T.chunk_text(F.col("markdown"), F.col("columns"), F.col("rows"))
    b = tables_of(spark, d).select(F.concat("doc_id", F.lit("::table::"), "id").alias("id"), "doc_id", F.lit("table").alias("source"), "page", text.alias("content")).where("content is not null")
    return I.all_chunks(t, b, I.image_chunks(images_of(spark, d))).select("id", "doc_id", "source", "page", F.md5("content").alias("digest"))


@query("SELECT id, digest, k FROM (SELECT doc_id || '_' || source || '_' || CAST(row_number() OVER (PARTITION BY doc_id, source ORDER BY id) AS VARCHAR) AS id, md5(content) AS digest, id AS k FROM (SELECT DISTINCT ON (id) * FROM chunks))")
def second_ids(spark, d):
    """The other id scheme: document, source and number."""
    w = Window.partitionBy("doc_id", "source").orderBy("id")
    return chunks_of(spark, d).select(F.concat_ws("_", "doc_id", "source", F.row_number().over(w).cast("string")).alias("id"), F.md5("content").alias("digest"), F.col("id").alias("k"))


_JOINED = f"(SELECT doc_id, string_agg(content, chr(10) ORDER BY coalesce(page, 1), id) AS t FROM {BLOCKS} WHERE content IS NOT NULL GROUP BY doc_id)"


@query(f"SELECT doc_id FROM {_JOINED} WHERE regexp_matches(t, '{I.QNA}')")
def qna_documents(spark, d):
    return I.qna_documents(blocks_of(spark, d))


_DT = {n: " + ".join(f"CAST(contains(lower(preview), '{w}') AS INT)" for w in ws) for n, ws in C.DOC_TYPES.items()}


@query(
    f"""SELECT doc_id, length(preview) AS n, CASE WHEN greatest({', '.join(f's_{n}' for n in _DT)}) = 0 THEN 'generic' {' '.join(f"WHEN s_{n} = greatest({', '.join(f's_{m}' for m in _DT)}) THEN '{n}'" for n in _DT)} END AS kind
       FROM (SELECT doc_id, preview, {', '.join(f'{e} AS s_{n}' for n, e in _DT.items())} FROM (
         SELECT doc_id, string_agg(t, chr(10) ORDER BY k) AS preview FROM (SELECT *, coalesce(sum(length(t)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
           SELECT doc_id, {sql_strip('content')} AS t, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(page, 1), id) AS k FROM {BLOCKS} WHERE content IS NOT NULL) WHERE k <= 20 AND t <> '') WHERE before <= 2000 GROUP BY doc_id))"""
)
def preview_types(spark, d):
    """Document types by the preview of their first blocks."""
    p = I.previews(blocks_of(spark, d))
    return p.select("doc_id", F.length("preview").alias("n"), C.document_type(F.col("preview")).alias("kind"))


@query(f"SELECT doc_id, page, len(boxes) AS n, boxes[1].id AS first_box FROM (SELECT p.doc_id, p.page, list_sort(list((b.id, b.bbox)) FILTER (b.id IS NOT NULL)) AS raw, list_sort(list({{'id': b.id}}) FILTER (b.id IS NOT NULL)) AS boxes FROM (SELECT DISTINCT doc_id, page FROM {CHUNKS} WHERE page IS NOT NULL) p LEFT JOIN (SELECT * FROM {BLOCKS} WHERE bbox IS NOT NULL) b USING (doc_id, page) GROUP BY p.doc_id, p.page)".replace("len(boxes)", "coalesce(len(boxes), 0)"))
def page_layout(spark, d):
    """Pages with their boxes, an empty list where there are none."""
    pages = chunks_of(spark, d).where("page is not null").select("doc_id", "page").distinct()
    boxes = blocks_of(spark, d).where("bbox is not null").select("doc_id", "page", "id", "bbox")
    sizes = pages.where("page % 2 = 0").select("doc_id", "page", F.lit(595.0).alias("width"), F.lit(842.0).alias("height"))
    return I.page_layout(pages, boxes, sizes).select("doc_id", "page", F.size("boxes").cast("long").alias("n"), F.try_element_at("boxes", F.lit(1))["id"].alias("first_box"))


_A = f"(SELECT doc_id, page, count(*) AS n, sum(length(content)) AS chars FROM {BLOCKS} WHERE page IS NOT NULL GROUP BY ALL)"
_B = f"(SELECT doc_id, page, sum(length(content)) AS chars FROM {CHUNKS} WHERE page IS NOT NULL GROUP BY ALL)"


@query(f"SELECT doc_id, page, a.chars AS a_chars, coalesce(b.chars, 0) AS b_chars FROM {_A} a LEFT JOIN {_B} b USING (doc_id, page)")
def page_comparison(spark, d):
    """Two readings of a page side by side."""
    sums = lambda t: t.where("page is not null").groupBy("doc_id", "page").agg(F.sum(F.length("content")).alias("chars"))
    a, b = sums(blocks_of(spark, d)).withColumnRenamed("chars", "a_chars"), sums(chunks_of(spark, d)).withColumnRenamed("chars", "b_chars")
    return a.join(b, ["doc_id", "page"], "left").select("doc_id", "page", "a_chars", F.coalesce("b_chars", F.lit(0)).alias("b_chars"))


@query(f"SELECT strategy, count(*) AS pages FROM (SELECT CASE WHEN a.n >= 3 AND coalesce(b.chars, 0) > 0 THEN 'B' WHEN a.chars > 0 THEN 'A' ELSE 'fail' END AS strategy FROM {_A} a LEFT JOIN {_B} b USING (doc_id, page)) GROUP BY strategy")
def page_strategies(spark, d):
    """How many pages each recognition strategy serves: regions from three boxes on, the whole page otherwise."""
    a = blocks_of(spark, d).where("page is not null").groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))
    b = chunks_of(spark, d).where("page is not null").groupBy("doc_id", "page").agg(F.sum(F.length("content")).alias("read"))
    text = lambda c: F.when(F.coalesce(c, F.lit(0)) > 0, "text")
    return a.join(b, ["doc_id", "page"], "left").groupBy(L.page_strategy(F.col("n"), text(F.col("read")), text(F.col("chars"))).alias("strategy")).agg(F.count("*").alias("pages"))


@query(f"SELECT id, nullif(lower({sql_strip('section')}), '') AS section, nullif(lower({sql_strip('role')}), '') AS role, CASE WHEN lower({sql_strip(chr(34) + 'bt' + chr(34))}) IN ('heading', 'step', 'note', 'warning') THEN lower({sql_strip('bt')}) ELSE 'normal' END AS block_type, coalesce(len(bbox) = 4, FALSE) AS has_box FROM (SELECT *, extra['block_type'] AS bt FROM {BLOCKS})")
def normal_blocks(spark, d):
    return I.normal_block(blocks_of(spark, d), ("heading", "step", "note", "warning"))


@query("SELECT m.doc_id, min(page) AS first_page, max(page) AS last_page FROM (SELECT DISTINCT doc_id FROM doc_metadata) m LEFT JOIN (SELECT doc_id, page FROM text_blocks UNION ALL SELECT doc_id, page FROM table_blocks) p USING (doc_id) GROUP BY m.doc_id")
def page_ranges(spark, d):
    return page_range(table(spark, d, "doc_metadata"), table(spark, d, "text_blocks"), table(spark, d, "table_blocks"), images_of(spark, d))


_MOVED = "CASE WHEN ends_with(id, '7') THEN 'elsewhere' ELSE doc_id END"


@query(
    f"""SELECT code, count(*) AS n FROM (SELECT 'TEXT_DOC_ID_MISMATCH' AS code FROM text_blocks WHERE doc_id <> '' AND doc_id <> {_MOVED} UNION ALL SELECT 'TABLE_DOC_ID_MISMATCH' FROM table_blocks WHERE doc_id <> '' AND doc_id <> {_MOVED}
       UNION ALL SELECT 'IMAGE_DOC_ID_MISMATCH' FROM {_IMAGES} WHERE doc_id <> '' AND doc_id <> {_MOVED} UNION ALL SELECT 'IMAGE_PAGE_OUT_OF_RANGE' FROM {_IMAGES} LEFT JOIN (SELECT doc_id, max(page_count) AS n FROM doc_metadata GROUP BY 1) USING (doc_id) WHERE page + 3 > n AND n > 0
       UNION ALL SELECT 'IMAGE_PAGE_INVALID' FROM {_IMAGES} WHERE page + 3 <= 0 UNION ALL SELECT 'IMAGE_NO_PATH' FROM {_IMAGES} WHERE ends_with(id, '3') UNION ALL SELECT 'DUPLICATE_IMAGE_ID' FROM {_IMAGES} WHERE ends_with(id, '5')) GROUP BY code"""
)
def validate_bundles(spark, d):
    """Rules on what lies in another document's bundle and on images, with such faults put into the tables."""
    moved = F.when(F.col("id").endswith("7"), "elsewhere").otherwise(F.col("doc_id"))
    images = images_of(spark, d).withColumn("page", F.col("page") + 3).withColumn("file_path", F.when(F.col("id").endswith("3"), "").otherwise(F.col("file_path")))
    images = images.unionByName(images.where(F.col("id").endswith("5")))
    parts = [t.withColumn("bundle", moved) for t in (table(spark, d, "text_blocks"), table(spark, d, "table_blocks"), images)]
    found = validate(table(spark, d, "doc_metadata"), *parts)
    images_once = F.when(F.col("code").startswith("IMAGE"), F.struct("doc_id", "item_id"))  # the copies put in count once
    kept = found.where(F.col("code").rlike("DOC_ID_MISMATCH|IMAGE")).groupBy("code")
    return kept.agg(F.when(F.col("code").startswith("IMAGE"), F.count_distinct(images_once)).otherwise(F.count("*")).alias("n"))


@query(
    f"""SELECT doc_id, section, min(page) AS page, CASE WHEN bool_or(k = 'warning') THEN 'warning' WHEN bool_or(k = 'step') THEN 'step' ELSE 'normal' END AS dominant, array_to_string(list_sort(list(DISTINCT k))[:5], ',') AS block_types
       FROM (SELECT doc_id, coalesce(section, '') AS section, page, lower(coalesce(extra['block_type'], 'normal')) AS k FROM {BLOCKS}) GROUP BY doc_id, section"""
)
def section_profile(spark, d):
    """Page, dominant type and types of a section's blocks."""
    kind = F.lower(F.coalesce(F.col("extra")["block_type"], F.lit("normal")))
    b = blocks_of(spark, d).select("doc_id", F.coalesce("section", F.lit("")).alias("section"), "page", kind.alias("k"))
    types = F.collect_set("k")  # a handful of types
    g = b.groupBy("doc_id", "section").agg(F.min("page").alias("page"), types.alias("t"))
    return g.select("doc_id", "section", "page", F.when(F.array_contains("t", "warning"), "warning").when(F.array_contains("t", "step"), "step").otherwise("normal").alias("dominant"), F.array_join(F.slice(F.array_sort("t"), 1, 5), ",").alias("block_types"))


_LI = ", ".join(f"CASE WHEN {any_of('t', w)} THEN '{n}' END" for n, w in C.LAYOUT_INTENTS.items())


@query(f"SELECT doc_id, page, array_to_string(list_sort(list(DISTINCT x)), ',') AS intents FROM (SELECT doc_id, coalesce(page, 1) AS page, unnest(list_filter([{_LI}], lambda x: x IS NOT NULL)) AS x FROM (SELECT *, lower(coalesce(content, '') || ' ' || coalesce(section, '')) AS t FROM {BLOCKS})) GROUP BY doc_id, page")
def page_intents(spark, d):
    """The union of the intents of what is merged: a page's blocks."""
    b = blocks_of(spark, d).select("doc_id", F.coalesce("page", F.lit(1)).alias("page"), F.explode(C.layout_intents(F.col("content"), F.col("section"))).alias("x"))
    return b.distinct().groupBy("doc_id", "page").agg(F.array_join(F.array_sort(F.collect_set("x")), ",").alias("intents"))


@query(
    f"""SELECT id, regexp_replace(t, '\\[SHOW_TABLE:CAT=(.*?)\\]', '', 'g') || coalesce(r, '') AS answer FROM (SELECT id, 'See ' || coalesce(category, '') || ' ' AS t, CASE WHEN image_path IS NOT NULL THEN '<img src=''/ingested/' || doc_id || '/' || image_path || '''>' WHEN html_content IS NOT NULL THEN html_content END AS r FROM {TABLES})"""
)
def shown_tables(spark, d):
    """Tags in an answer replaced by the picture or the HTML of the first table of their category; here each table is asked for
    by its own category."""
    t = tables_of(spark, d)
    answers = t.select("id", F.concat(F.lit("See "), F.coalesce("category", F.lit("")), F.lit(" [SHOW_TABLE:CAT="), F.coalesce("category", F.lit("")), F.lit("]")).alias("answer"))
    shown = t.select("id", F.coalesce("category", F.lit("")).alias("category"), F.lit(1).alias("rank"), "doc_id", "image_path", "html_content")
    return T.with_tables(answers, shown)


@query(f"SELECT id, len(regexp_extract_all(h, '(?is)<table.*?</table>')) AS n, coalesce(nullif(trim(regexp_replace(regexp_extract(h, '(?is)<caption[^>]*>(.*?)</caption>', 1), '<[^>]+>', '', 'g')), ''), 'Table 1') AS title FROM (SELECT id, html_content || CASE WHEN name IS NULL THEN '' ELSE '<table><caption>' || name || '</caption></table>' END AS h FROM {TABLES} WHERE html_content IS NOT NULL)")
def html_tables(spark, d):
    """Tables of an answer's HTML and the title of the first captioned one."""
    h = F.concat("html_content", F.when(F.col("name").isNull(), "").otherwise(F.concat(F.lit("<table><caption>"), "name", F.lit("</caption></table>"))))
    return tables_of(spark, d).where("html_content is not null").select("id", F.size(T.html_tables(h)).alias("n"), T.html_title(h, 1).alias("title"))


@query("SELECT id, count(*) AS n FROM chunks GROUP BY id HAVING count(*) > 1 ORDER BY n DESC, id LIMIT 20")
def store_peek(spark, d):
    """A look into a store: its ids held twice, at most twenty."""
    return table(spark, d, "chunks").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "id").limit(20)


@query(f"SELECT id, doc_id FROM {CHUNKS} WHERE doc_id NOT IN (SELECT doc_id FROM doc_metadata WHERE doc_id IS NOT NULL) AND doc_id IS NOT NULL")
def orphan_chunks(spark, d):
    """Chunks whose document is gone."""
    return S.without(chunks_of(spark, d).where("doc_id is not null"), table(spark, d, "doc_metadata").where("doc_id is not null")).select("id", "doc_id")


@query(f"SELECT id FROM {BLOCKS} WHERE NOT coalesce(bbox[4] < 0.07 * 842.0, FALSE) AND NOT coalesce(bbox[2] > 0.93 * 842.0, FALSE) AND len(regexp_extract_all(content, '[A-Za-z0-9฀-๿]')) >= 2")
def without_noise(spark, d):
    """Blocks outside the margins that say something."""
    return B.margins(blocks_of(spark, d)).where((F.col("margin") == "body") & X.meaningful_marks(F.col("content"))).select("id")


_CELL = sql_thai_spacing("replace(cell, chr(0), '')")


@query(f"SELECT DISTINCT cell, {_CELL} AS clean FROM (SELECT unnest(flatten(rows)) AS cell FROM table_blocks) WHERE cell IS NOT NULL")
def clean_cells(spark, d):
    """Cells without outer blanks and blanks between Thai letters."""
    rows = table(spark, d, "table_blocks").where("rows is not null").select(F.flatten(F.filter("rows", lambda r: r.isNotNull())).alias("r"))
    both = rows.select(F.explode(F.arrays_zip(F.col("r").alias("cell"), X.clean_cells(F.array("r"))[0].alias("clean"))).alias("x"))
    return both.select("x.cell", "x.clean").where("cell is not null").distinct()


_KIND = "CASE WHEN regexp_matches(upper(content), '^(WARNING|CAUTION|DANGER|คำเตือน|ข้อควรระวัง)[:\\s]') THEN 'warning' WHEN regexp_matches(upper(content), '^(NOTE|NOTICE|IMPORTANT|หมายเหตุ|สำคัญ|ข้อสังเกต)[:\\s]') THEN 'note' WHEN regexp_matches(content, '(?i)^(\\d+\\.|Step\\s+\\d+|ขั้นตอนที่\\s+\\d+|[A-Z]\\.)\\s') THEN 'procedure' ELSE 'general' END"


@query(f"SELECT id, coalesce({_KIND}, 'general') AS scope FROM {BLOCKS}")
def block_scopes(spark, d):
    """What a block answers, by its layout type."""
    return blocks_of(spark, d).select("id", C.scope_of_block(C.block_type(F.col("content"))).alias("scope"))


@query("SELECT DISTINCT category, regexp_replace(lower(category), '[^a-z_]', '', 'g') AS label FROM table_blocks WHERE category IS NOT NULL")
def category_labels(spark, d):
    """A model's category in its plain form."""
    return table(spark, d, "table_blocks").where("category is not null").select("category", X.label_cleanup(F.col("category")).alias("label")).distinct()


_W = "list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[\\p{{L}}\\p{{N}}_]+'))"


@query(f"SELECT DISTINCT query, answer, len(list_filter(list_intersect({_W.format('query')}, {_W.format('answer')}), lambda w: length(w) > 1 AND w NOT IN ('the', 'and'))) AS shared FROM qa_log WHERE query IS NOT NULL")
def keyword_overlaps(spark, d):
    """Words that a question and its answer share."""
    both = table(spark, d, "qa_log").where("query is not null").select("query", "answer").distinct()
    return both.select("query", "answer", X.keyword_overlap(F.col("query"), F.coalesce("answer", F.lit("")), ("the", "and")).cast("long").alias("shared"))


@query("SELECT DISTINCT query, CASE WHEN length(query) % 3 = 0 THEN 'Not in the documents.' ELSE answer END AS answer FROM qa_log WHERE query IS NOT NULL")
def refusals(spark, d):
    """Answers refused where the grader says no; it fails open where its reply makes no sense."""
    n = F.length("query") % 3
    reply = F.when(n == 0, 'Sure: {"verdict": "no", "reason": "x"}').when(n == 1, "Yes, mostly").otherwise("???")
    qa = table(spark, d, "qa_log").where("query is not null").select("query", "answer", L.verdict(reply).alias("verdict"))
    return L.refused(qa, "Not in the documents.").select("query", "answer").distinct()


@query("SELECT query, CAST(len(string_split(query, ' ')) AS INT) AS words, 'user' AS last_role, CAST(2 + CASE WHEN trim(answer) <> '' THEN 1 ELSE 0 END AS INT) AS messages FROM (SELECT DISTINCT query, coalesce(answer, '') AS answer FROM qa_log WHERE query IS NOT NULL)")
def prompt_messages(spark, d):
    """The messages of a prompt: system text, earlier turns that say something, the question."""
    qa = table(spark, d, "qa_log").where("query is not null").select("query", F.coalesce("answer", F.lit("")).alias("answer")).distinct()
    history = F.array(F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content")))
    m = qa.select("query", F.size(F.split("query", " ", -1)).alias("words"), L.messages(F.lit("Answer from the sources."), history, F.col("query")).alias("m"))
    return m.select("query", "words", F.element_at("m", -1)["role"].alias("last_role"), F.size("m").alias("messages"))


@query("SELECT id, CAST(json_extract(c, '$.a') AS INT) AS a, CAST(json_extract(c, '$.b.k') AS INT) AS k, CAST(json_extract(l, '$[1]') AS INT) AS second FROM (SELECT line_no AS id, '{\"a\": ' || line_no % 10 || ', \"b\": {\"k\": ' || line_no % 7 || '}}' AS c, '[1, ' || line_no % 5 || ']' AS l FROM cost_log)")
def json_nested(spark, d):
    """Objects with inner objects and lists out of prose."""
    n = F.col("line_no")
    text = F.concat(F.lit('Here: {"a": '), n % 10, F.lit(', "b": {"k": '), n % 7, F.lit("}} done [1, "), n % 5, F.lit("] end"))
    t = table(spark, d, "cost_log").select(n.alias("id"), text.alias("t"))
    o, items = X.greedy_json(F.col("t"), "a int, b struct<k:int>"), X.json_list(F.col("t"), "array<int>")
    return t.select("id", o["a"].alias("a"), o["b"]["k"].alias("k"), items[1].alias("second"))


@query("SELECT line_no, 'token' AS event, endpoint || chr(10) || coalesce(model, '-') AS data FROM cost_log")
def stream_frames(spark, d):
    """Frames of a server-sent stream."""
    raw = F.concat(F.lit("event: token\ndata: "), "endpoint", F.lit("\ndata: "), F.coalesce("model", F.lit("-")), F.lit("\n\n"))
    return table(spark, d, "cost_log").select("line_no", F.explode(X.sse_frames(raw)).alias("f")).select("line_no", "f.event", "f.data")

"""Text blocks in reading order: carried sections, merging, chunking, rendering.

Order-dependent steps never gather a document: values are carried inside a page (a small group) and then from page to page
over one row a page, so a document of a third of all rows is spread over its pages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import classify as C
from folioforge.functions.text import display_section, markdown_text, meaningful_words, normalize_whitespace, section_title, strip
from folioforge.session import Scratch, stage

MAX_CHARS, OVERLAP = 1200, 150


def carried(df: DataFrame, value: Column, name: str, inclusive: bool = False, doc: str = "doc_id", page: str = "page", order: str = "id") -> DataFrame:
    """``df`` with the last non-null ``value`` before the row (or at it) in the document, as column ``name``."""
    d = df.withColumn("__v", value).withColumn("__p", F.coalesce(page, F.lit(1)))
    inside = Window.partitionBy(doc, "__p").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    last = d.where(F.col("__v").isNotNull()).groupBy(doc, "__p").agg(F.max_by("__v", order).alias("__last"))
    pages = d.select(doc, "__p").distinct().join(last, [doc, "__p"], "left")
    before = Window.partitionBy(doc).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row a page
    pages = pages.select(doc, "__p", F.last("__last", ignorenulls=True).over(before).alias("__before"))
    out = d.withColumn("__in", F.last("__v", ignorenulls=True).over(inside)).join(pages, [doc, "__p"], "left")
    return out.withColumn(name, F.coalesce("__in", "__before")).drop("__v", "__p", "__in", "__before")


def positions(df: DataFrame, doc: str = "doc_id", page: str = "page", order: str = "id") -> DataFrame:
    """``df`` with ``pos``, the row's place in its document from 0: ranks inside pages plus the counts of pages before."""
    d = df.withColumn("__p", F.coalesce(page, F.lit(1)))
    counts = d.groupBy(doc, "__p").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(doc).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(doc, "__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    at = F.row_number().over(Window.partitionBy(doc, "__p").orderBy(order)) - 1
    return d.withColumn("__at", at).join(counts, [doc, "__p"]).withColumn("pos", (F.col("__at") + F.col("__before")).cast("int")).drop("__p", "__at", "__before")


def filled_sections(blocks: DataFrame) -> DataFrame:
    """Section of the last heading whose normalised title is not blank, across pages."""
    heading = F.coalesce(F.col("extra")["is_heading"], F.lit("false")) == "true"
    return carried(blocks, F.when(heading, F.nullif(section_title(F.col("content")), F.lit(""))), "filled_section", inclusive=True)


def folded(rows: DataFrame, keys: list[str], order: list[str], fold: Callable[[list[dict]], list[tuple]], schema: str) -> DataFrame:
    """``fold`` over the rows of each group in order. Groups share a shuffle and a sort and are cut from the sorted stream
    of Arrow batches, so that small groups cost no pandas frame each; one group at a time is held."""

    def work(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split()[0] for c in schema.split(", ")]
        held: list[dict] = []
        last = None
        for pdf in it:
            out: list[tuple] = []
            columns = list(pdf.columns)
            for values in zip(*(pdf[c].to_list() for c in columns)):
                r = dict(zip(columns, values))
                key = tuple(r[k] for k in keys)
                if key != last and held:
                    out += fold(held)
                    held = []
                last = key
                held.append(r)
            yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame(fold(held), columns=names)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(work, schema)


def _merge(rows: list[dict]) -> list[tuple]:
    out: list[dict] = []
    current: dict | None = None
    for r in rows:
        r |= {"kind": r["kind"] or "normal", "blocks": 1}
        if current is not None and current["section"] == r["section"]:
            step = current["kind"] in ("step", "step_sequence") and r["kind"] == "step"
            gap = r["y0"] - current["y1"]
            para = current["kind"] == r["kind"] == "normal" and abs(current["font"] - r["font"]) < 1.5 and -5 < gap < 15
            if step or para:
                current["content"] += ("\n" if step else " ") + r["content"]
                current |= {"x0": min(current["x0"], r["x0"]), "y0": min(current["y0"], r["y0"]), "x1": max(current["x1"], r["x1"]), "y1": max(current["y1"], r["y1"]), "blocks": current["blocks"] + 1}
                if step:
                    current["kind"] = "step_sequence"
                continue
        current = r
        out.append(current)
    return [tuple(b[c] for c in ("doc_id", "page", "id", "section", "kind", "content", "x0", "y0", "x1", "y1", "blocks")) for b in out]


def merged(blocks: DataFrame) -> DataFrame:
    """Adjacent paragraphs or steps of a page and section as one block. Each test looks at the block merged so far, so this
    is a fold over a page's blocks."""
    box = [F.coalesce(F.try_element_at("bbox", F.lit(k + 1)), F.lit(0.0)).alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))]
    rows = blocks.where("content is not null and id is not null").select(
        "doc_id", F.coalesce("page", F.lit(1)).alias("page"), "id", F.coalesce("section", F.lit("")).alias("section"), F.col("extra")["block_type"].alias("kind"),
        F.coalesce(F.col("extra")["font_size"].try_cast("double"), F.lit(0.0)).alias("font"), "content", *box,
    )
    return folded(rows, ["doc_id", "page"], ["id"], _merge, "doc_id string, page int, id string, section string, kind string, content string, x0 double, y0 double, x1 double, y1 double, blocks int")


def _chunk(rows: list[dict]) -> list[tuple]:
    """Fold the blocks of one segment into chunks."""
    out: list[tuple] = []
    held: list[dict] = []
    length = 0

    def close() -> None:
        out.append((held[0]["doc_id"], held[0]["id"], [b["id"] for b in held], held[-1]["section"]))

    for b in rows:
        if held:
            now = {i for x in held for i in x["intents"]}
            drop = held[-1]["primary"] in ("troubleshooting", "safety") and b["primary"] not in ("troubleshooting", "safety")
            apart = bool(now) and len(b["intents"]) > 0 and now.isdisjoint(b["intents"])
            if b["section"] != held[-1]["section"] or length + b["size"] > MAX_CHARS or b["h1"] or b["qna"] or apart or drop:
                close()
                tail, length = [], 0
                for x in reversed(held):
                    if length + x["raw"] > OVERLAP:
                        break
                    tail.insert(0, x)
                    length += x["raw"]
                held = tail
        held.append(b)
        length += b["size"]
    if held:
        close()
    return out


def chunk_groups(blocks: DataFrame) -> DataFrame:
    """doc_id, first_id, block_ids, section of the chunks of ``blocks``.

    A chunk ends before a new section, a first-level heading, a question, a change of intent or MAX_CHARS; the next one
    starts with the trailing blocks of up to OVERLAP characters. The fold's state is empty where a break is certain and the
    block before is longer than OVERLAP, so documents are cut there and the segments are folded independently."""
    text = normalize_whitespace(F.col("content"))
    rows = blocks.where("content is not null and id is not null").select("doc_id", F.coalesce("page", F.lit(1)).alias("page"), "id", "section", "content", (F.col("extra")["heading_level"] == "H1").alias("h1"), text.alias("text"))
    rows = rows.where((F.col("text") != "") & meaningful_words(F.col("text"))).dropDuplicates(["doc_id", "id"])
    names = C.intents(F.col("text"), F.col("section"))
    rows = rows.select(
        "doc_id", "page", "id", F.coalesce("section", F.lit("\u0000")).alias("section"), F.length("text").alias("size"), F.length("content").alias("raw"), F.coalesce("h1", F.lit(False)).alias("h1"),
        F.col("text").rlike(C.QNA_BREAK).alias("qna"), names.alias("intents"), C.primary_intent(names).alias("primary"),
    )
    with Scratch() as tmp:
        rows = segments(tmp(rows))  # a few short columns, read once inside pages and once for the pages
        out = stage(folded(rows, ["doc_id", "segment"], ["page", "id"], _chunk, "doc_id string, first_id string, block_ids array<string>, section string"))
    return out.withColumn("section", F.nullif("section", F.lit("\u0000")))


def segments(rows: DataFrame) -> DataFrame:
    """``rows`` with ``segment``, the id of the last block at or before each at which the fold starts afresh. Inside a page by
    the block before; a page's first block by the last one of the page before, over one row a page."""
    inside = Window.partitionBy("doc_id", "page").orderBy("id")
    fresh = lambda b, r: (b["raw"] > OVERLAP) & (r["h1"] | r["qna"] | (b["section"] != r["section"]))
    own = {c: F.col(c) for c in ("h1", "qna", "section")}
    d = rows.withColumn("__before", F.lag(F.struct("section", "raw")).over(inside))
    d = d.withColumn("__start", F.when(F.col("__before").isNotNull() & F.coalesce(fresh(F.col("__before"), own), F.lit(False)), F.col("id")))
    p = d.groupBy("doc_id", "page").agg(F.min_by(F.struct("id", "h1", "qna", "section"), "id").alias("first"), F.max_by(F.struct("section", "raw"), "id").alias("last"), F.max("__start").alias("start"))
    pages = Window.partitionBy("doc_id").orderBy("page")  # one row a page
    p = p.withColumn("__prev", F.lag("last").over(pages))
    p = p.withColumn("__head", F.when(F.col("__prev").isNull() | fresh(F.col("__prev"), F.col("first")), F.col("first.id")))
    carried_ = F.last(F.coalesce("start", "__head"), ignorenulls=True).over(pages.rowsBetween(Window.unboundedPreceding, -1))
    p = p.select("doc_id", "page", F.coalesce("__head", carried_).alias("__carried"))
    last = F.last("__start", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("__own", last).join(p, ["doc_id", "page"]).withColumn("segment", F.coalesce("__own", "__carried")).drop("__before", "__start", "__own", "__carried")


def chunks(blocks: DataFrame) -> DataFrame:
    """The chunks' texts: a tag line by intent, each block behind its sign, cut at MAX_CHARS; with their metadata."""
    groups = chunk_groups(blocks).select("doc_id", "first_id", F.posexplode("block_ids").alias("k", "id"), F.col("section").alias("chunk_section"))
    kind = F.lower(F.coalesce(F.col("extra")["block_type"], F.lit("normal")))
    body = blocks.dropDuplicates(["doc_id", "id"]).select("doc_id", "id", "content", "page", kind.alias("kind"))
    parts = groups.join(body, ["doc_id", "id"]).groupBy("doc_id", "first_id", "chunk_section").agg(F.array_sort(F.collect_list(F.struct("k", "content", "kind", "page"))).alias("b"))
    raw = F.array_join(F.transform("b", lambda x: x["content"]), "\n")
    sign = lambda x: F.when(x["kind"] == "warning", F.array(F.lit("⚠️"), x["content"])).when(x["kind"] == "note", F.array(F.lit("ℹ️"), x["content"])).otherwise(F.array(x["content"]))
    section = display_section(F.col("chunk_section"))
    p = stage(parts.select("*", raw.alias("raw"))).withColumn("intent", C.intents(F.col("raw"), section))
    tag = F.when(F.array_contains("intent", "safety"), F.array(F.lit("⚠️ [ข้อควรระวัง]"))).when(F.array_contains("intent", "troubleshooting"), F.array(F.lit("🔧 [การแก้ปัญหา]"))).otherwise(F.array().cast("array<string>"))
    full = F.array_join(F.concat(tag, F.flatten(F.transform("b", sign))), "\n")
    cut = F.when(F.length("full") > MAX_CHARS, F.concat(F.substring("full", 1, MAX_CHARS - 50), F.lit("\n...[ตัดทอนเนื้อหา]..."))).otherwise(F.col("full"))
    pages = F.array_sort(F.array_distinct(F.array_compact(F.transform("b", lambda x: x["page"]))))
    return p.withColumn("full", full).select(
        "doc_id", F.col("first_id").alias("chunk_id"), cut.alias("content"), section.alias("section"), "intent", C.primary_intent(F.col("intent")).alias("primary_intent"),
        C.answer_scope(F.col("raw"), section).alias("answer_scope"), C.entities(F.col("raw"), section).alias("entities"), F.slice(pages, 1, 10).alias("pages"), F.length(cut).alias("char_count"),
    )


def overlap_tail(blocks: DataFrame, most: int = OVERLAP) -> DataFrame:
    """The last blocks of each page whose lengths add up to at most ``most``, stopping at the first that does not fit."""
    w = Window.partitionBy("doc_id", "page").orderBy(F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("tail_chars", F.sum(F.length("content")).over(w)).where(F.col("tail_chars") <= most).select("doc_id", "page", "id", "tail_chars")


def leading(rows: DataFrame, doc: str, order: str, size: Column, most: int, salts: int = 64) -> DataFrame:
    """The rows of a document before which less than ``most`` (by ``size``) stands, in order. First inside ``salts`` parts of a
    document, so that one with a third of all rows is sorted by as many tasks: what stands before a row in its part is no
    more than what stands before it in the document, so no row is lost that way."""
    sized = rows.withColumn("__size", size).withColumn("__salt", F.pmod(F.xxhash64(order), F.lit(salts)))

    def cut(df: DataFrame, *by: str) -> DataFrame:
        before = F.sum("__size").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
        return df.withColumn("__before", F.coalesce(before, F.lit(0))).where(F.col("__before") < most)

    return cut(cut(sized, doc, "__salt"), doc).drop("__size", "__salt", "__before")


def first_copies(rows: DataFrame, *by: str, text: str = "content", order: str = "id") -> DataFrame:
    """The first row of each text in each ``by`` group; copies fall together in a hash aggregation, not a sort."""
    keep = rows.groupBy(*by, F.md5(text).alias("fingerprint")).agg(F.min(order).alias(order), F.count("*").alias("copies"))
    return keep


def reading_order(blocks: DataFrame) -> DataFrame:
    """Place on the page by rows of 12 points, then from the left."""
    y, x = F.coalesce(F.try_element_at("bbox", F.lit(2)), F.lit(0.0)), F.coalesce(F.try_element_at("bbox", F.lit(1)), F.lit(0.0))
    w = Window.partitionBy("doc_id", "page").orderBy((y / 12).cast("int"), x, "id")
    return blocks.withColumn("place", F.row_number().over(w))


def margins(blocks: DataFrame, height: float = 842.0) -> DataFrame:
    """Whether a block lies in the page's header or footer margin."""
    y0, y1 = F.try_element_at("bbox", F.lit(2)), F.try_element_at("bbox", F.lit(4))
    return blocks.withColumn("margin", F.when(y1 < 0.07 * height, "header").when(y0 > 0.93 * height, "footer").otherwise("body"))


def font_headings(blocks: DataFrame) -> DataFrame:
    """Blocks set larger than their page's median: H1 above 1.5 times, H2 above 1.2."""
    size = F.coalesce(F.col("extra")["font_size"].try_cast("double"), F.lit(10.0))
    b = blocks.withColumn("size", size).withColumn("page", F.coalesce("page", F.lit(1)))
    med = b.groupBy("doc_id", "page").agg(F.median("size").alias("median_size"))
    t = strip(F.col("content"))
    big = (F.length(t) < 200) & ~t.rlike(r"^[\d\p{P}\p{S}\s]*$")
    level = F.when(big & (F.col("size") > 1.5 * F.col("median_size")), "H1").when(big & (F.col("size") > 1.2 * F.col("median_size")), "H2")
    return b.join(med, ["doc_id", "page"]).withColumn("level", level)


# What a page's parts look like in Markdown (fixed values), {} being the text.
TEXT_FORMS = {
    "title": "\n# {}\n", "section_header": "\n## {}\n", "legal_clause": "\n> ⚖️ **{}**\n", "warning_note": "\n> ⚠️ **คำเตือน:** {}\n", "instruction_step": "1. {}",
    "list_item": "- {}", "page_meta": "\n*(Page {})*\n", "qna_question": "\n**Q: {}**", "qna_answer": "\n**A: {}**\n",
}
TABLE_NAME, TABLE_SUMMARY, TABLE_EMPTY = "\n### 📊 ตาราง: {}", "> *AI Summary: {}*", "*(ตารางไม่มีข้อมูล)*"
IMAGE_LINK, IMAGE_CAPTION, IMAGE_FILE = "\n[![{}](images/{})](images/{})", "\n*รูปที่: {}*", "> 📂 File: [`{}`](images/{})\n"
PAGE_HEAD = "\n\n--- \n## 📑 Page {}\n\n"


def filled(form: str, *values: Column) -> Column:
    parts = form.split("{}")
    return F.concat(F.lit(parts[0]), *(x for v, p in zip(values, parts[1:]) for x in (v, F.lit(p))))


def _at(k: int) -> Column:
    return F.coalesce(F.try_element_at("bbox", F.lit(k)), F.lit(0.0))


def text_lines(texts: DataFrame) -> DataFrame:
    t = markdown_text(F.col("content"))
    form = F.coalesce(F.col("extra")["role"], F.col("role"), F.lit("normal_text"))
    line = F.coalesce(*(F.when(form == r, filled(f, t)) for r, f in TEXT_FORMS.items()))
    return texts.where("content is not null").select("doc_id", "page", F.lit(0).alias("kind"), "id", _at(2).alias("y0"), _at(1).alias("x0"), F.when(t == "", "").otherwise(F.coalesce(line, t)).alias("line"))


def table_lines(tables: DataFrame) -> DataFrame:
    name, summary, body = (blank for blank in (F.nullif("name", F.lit("")), F.nullif(F.col("extra")["summary"], F.lit("")), F.nullif("markdown", F.lit(""))))
    line = F.concat_ws("\n", filled(TABLE_NAME, name), filled(TABLE_SUMMARY, summary), F.coalesce(body, F.lit(TABLE_EMPTY)), F.lit("\n"))
    return tables.select("doc_id", "page", F.lit(1).alias("kind"), "id", _at(2).alias("y0"), _at(1).alias("x0"), line.alias("line"))


def image_lines(images: DataFrame) -> DataFrame:
    name, caption = F.regexp_extract("file_path", r"([^/]+)$", 1), F.nullif("caption", F.lit(""))
    line = F.concat_ws("\n", filled(IMAGE_LINK, F.coalesce(caption, F.lit("Image")), name, name), filled(IMAGE_CAPTION, caption), filled(IMAGE_FILE, name, name))
    return images.select("doc_id", "page", F.lit(2).alias("kind"), "id", _at(2).alias("y0"), _at(1).alias("x0"), line.alias("line"))


def markdown(texts: DataFrame, *others: DataFrame) -> DataFrame:
    """One Markdown text a document page: text blocks and what ``table_lines`` and ``image_lines`` give, by their place on the
    page from the top and the left; among equals texts, tables, images. Rows without a page go to page 1."""
    rows = reduce(DataFrame.unionByName, [text_lines(texts), *others]).select("doc_id", F.coalesce("page", F.lit(1)).alias("page"), F.struct("y0", "x0", "kind", "id", "line").alias("x")).distinct()
    pages = rows.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list("x")).alias("x"))
    head = filled(PAGE_HEAD, F.col("page").cast("string"))
    return pages.select("doc_id", "page", F.concat(head, F.lit("\n"), F.array_join(F.transform("x", lambda e: e["line"]), "\n")).alias("markdown"))


def document_heads(meta: DataFrame) -> DataFrame:
    """The head of each document's Markdown: name, type, date (fixed values)."""
    text = filled("# 📄 เอกสาร: {}\n- **ประเภท:** {}\n- **วันที่ประมวลผล:** {}\n---\n", *(F.coalesce(c, F.lit("Unknown")) for c in ("file_name", "doc_type", "ingested_at")))
    return meta.groupBy("doc_id").agg(F.max(F.struct(*(F.coalesce(c, F.lit("Unknown")).alias(c) for c in ("ingested_at", "file_name", "doc_type")))).alias("m")).select("doc_id", "m.*").select("doc_id", text.alias("head"))


def best_region(boxes: DataFrame, regions: DataFrame) -> DataFrame:
    """Each region's box with the largest share of the region's area covered; the first box among equals. Both belong to a
    page, so the join is on the page."""
    w = F.greatest(F.lit(0.0), F.least("bx1", "rx1") - F.greatest("bx0", "rx0"))
    h = F.greatest(F.lit(0.0), F.least("by1", "ry1") - F.greatest("by0", "ry0"))
    pairs = boxes.join(regions, ["doc_id", "page"]).withColumn("share", F.round(w * h / ((F.col("rx1") - F.col("rx0")) * (F.col("ry1") - F.col("ry0"))), 6)).where("share > 0")
    best = pairs.groupBy("doc_id", "page", "region_id").agg(F.max("share").alias("share"))
    return pairs.join(best, ["doc_id", "page", "region_id", "share"]).groupBy("doc_id", "page", "region_id", "share").agg(F.min("box_id").alias("box_id"))


def size_chunks(blocks: DataFrame, most: int = MAX_CHARS) -> DataFrame:
    """Chunk number of a page's blocks by size alone: a block that would overrun ``most`` starts a chunk."""
    items = F.array_sort(F.collect_list(F.struct("id", F.coalesce(F.length("content"), F.lit(0)).alias("n"))))
    pages = blocks.withColumn("page", F.coalesce("page", F.lit(1))).groupBy("doc_id", "page").agg(items.alias("b"))
    start = F.struct(F.lit(0).alias("c"), F.lit(0).alias("n"), F.array().cast("array<struct<id:string,chunk:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        over = (s["n"] > 0) & (s["n"] + x["n"] > most)
        c = F.when(over, s["c"] + 1).otherwise(s["c"])
        return F.struct(c.alias("c"), F.when(over, x["n"]).otherwise(s["n"] + x["n"]).alias("n"), F.concat(s["out"], F.array(F.struct(x["id"].alias("id"), c.alias("chunk")))).alias("out"))

    return pages.select("doc_id", "page", F.explode(F.aggregate("b", start, step, lambda s: s["out"])).alias("x")).select("doc_id", "page", "x.id", "x.chunk")

"""Extracted tables: rendering, header inference, roles, transactions, HTML parsing."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.classify import header_name
from folioforge.functions.text import amount, blank_to_null, normalize_whitespace

TRANSACTION = ("date", "description", "amount_in", "amount_out", "amount", "balance", "quantity", "unit_price")


def _cell(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def fitted(row: Column, n: Column) -> Column:
    """The row padded with empty cells or cut to ``n`` cells."""
    pad = F.array_repeat(F.lit(""), F.greatest(F.lit(0), n - F.size(row)))
    return F.slice(F.concat(F.transform(row, _cell), pad), F.lit(1), n)


def to_markdown(columns: Column, rows: Column) -> Column:
    n = F.size(columns)
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), n), " | "), F.lit(" |"))
    body = F.transform(rows, lambda r: line(fitted(r, n)))
    return F.when(n > 0, F.array_join(F.concat(F.array(line(F.transform(columns, _cell)), rule), body), "\n")).otherwise("")


def to_html(columns: Column, rows: Column) -> Column:
    n = F.size(columns)
    cells = lambda r, tag: F.array_join(F.transform(r, lambda c: F.concat(F.lit(f"<{tag}>"), _cell(c), F.lit(f"</{tag}>"))), "")
    body = F.array_join(F.transform(rows, lambda r: F.concat(F.lit("<tr>"), cells(fitted(r, n), "td"), F.lit("</tr>"))), "")
    return F.concat(F.lit("<table><tr>"), cells(columns, "th"), F.lit("</tr>"), body, F.lit("</table>"))


def semantic_rows(columns: Column, rows: Column, most_rows: int = 15, most_cells: int = 5, most_chars: int = 100) -> Column:
    """``column=value`` pairs of each row, with a line for the rows left out."""

    def one(r: Column) -> Column:
        pairs = F.transform(F.slice(r, 1, most_cells), lambda c, i: F.when(blank_to_null(c).isNotNull(), F.concat(_cell(F.try_element_at(columns, i + 1)), F.lit("="), F.substring(c, 1, most_chars))))
        return F.array_join(F.array_compact(pairs), " | ")

    lines = F.filter(F.transform(F.slice(rows, 1, most_rows), one), lambda x: x != "")
    rest = F.size(rows) - most_rows
    return F.concat(F.array_join(lines, "\n"), F.when(rest > 0, F.concat(F.lit("\n... "), rest.cast("string"), F.lit(" more rows"))).otherwise(""))


def embed_text(name: Column, summary: Column, markdown: Column, columns: Column, rows: Column) -> Column:
    """Text of a table for the index: name, summary, then its Markdown or its first ten rows."""
    table = F.coalesce(blank_to_null(markdown), to_markdown(columns, F.slice(rows, 1, 10)))
    return F.concat_ws("\n", F.concat(F.lit("Table: "), blank_to_null(name)), F.concat(F.lit("Summary: "), blank_to_null(summary)), table)


def chunk_text(markdown: Column, columns: Column, rows: Column) -> Column:
    """Text of a table's chunk: its Markdown, else the header and five rows; null if blank."""
    flat = F.array_join(F.concat(F.array(F.array_join(columns, " | ")), F.transform(F.slice(rows, 1, 5), lambda r: F.array_join(F.transform(r, _cell), " | "))), "\n")
    return blank_to_null(F.coalesce(blank_to_null(markdown), flat))


def unified_text(name: Column, category: Column, summary: Column, columns: Column, markdown: Column, rows: Column) -> Column:
    """Name, category, a summary of 300 characters, ten columns, 1000 characters of Markdown or the semantic rows."""
    md = normalize_whitespace(markdown)
    cut = F.when(F.length(md) > 1000, F.concat(F.substring(md, 1, 1000), F.lit("\n...[ตัดทอนตาราง]..."))).otherwise(md)
    cols = F.array_join(F.slice(columns, 1, 10), ", ")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Table: "), blank_to_null(name)),
        F.concat(F.lit("Category: "), blank_to_null(category)),
        F.concat(F.lit("Summary: "), F.substring(blank_to_null(summary), 1, 300)),
        F.concat(F.lit("Columns: "), blank_to_null(cols)),
        F.coalesce(blank_to_null(cut), semantic_rows(columns, rows)),
    )


def inferred_header(columns: Column, rows: Column) -> Column:
    """Struct of columns and rows: where columns are missing, the first row becomes the header if at least half of its
    cells (and one) hold letters."""
    first = F.try_element_at(rows, F.lit(1))
    alphabetic = F.size(F.filter(first, lambda c: c.rlike("[A-Za-z\u0e00-\u0e7f]")))
    use = (F.coalesce(F.size(columns), F.lit(0)) <= 0) & (F.size(rows) > 0) & (alphabetic >= F.greatest(F.lit(1), F.floor(F.size(first) / 2)))
    return F.struct(F.when(use, first).otherwise(columns).alias("columns"), F.when(use, F.slice(rows, 2, 100_000_000)).otherwise(rows).alias("rows"))


def transactions(tables: DataFrame) -> DataFrame:
    """``tables`` (id, columns, rows) -> a row per table row: raw fields by canonical header (the last of equal headers
    wins), parsed amounts, quantity x unit price where no amount is given. Rows without any field are dropped."""
    names = F.transform("columns", header_name)
    last = lambda n: F.size("names") + 1 - F.nullif(F.array_position(F.reverse("names"), n), F.lit(0).cast("long"))
    # The places of the fields are found once a table, below the generator of its rows.
    placed = tables.where("size(columns) > 0 and size(rows) > 0").select("id", "rows", names.alias("names"))
    placed = placed.select("id", "rows", F.array(*(last(n).cast("int") for n in TRANSACTION)).alias("at"))
    rows = placed.select("id", "at", F.posexplode("rows").alias("row_no", "row"))
    at = lambda k: F.element_at("at", k + 1)
    raw = {n: F.when(at(k) <= F.size("row"), F.try_element_at("row", at(k))) for k, n in enumerate(TRANSACTION)}
    out = rows.select("id", "row_no", *(F.nullif(F.trim(c), F.lit("")).alias(n) for n, c in raw.items()))
    out = out.where(F.coalesce(*(F.col(n) for n in TRANSACTION)).isNotNull())
    q, u, a = amount(F.col("quantity")), amount(F.col("unit_price")), amount(F.col("amount"))
    given = F.when(a != 0, a)
    product = F.when((q != 0) & (u != 0), q * u)
    return out.select(
        "id", "row_no", F.col("date").alias("date_raw"), "description", F.col("amount_in").alias("amount_in_raw"), F.col("amount_out").alias("amount_out_raw"), F.col("balance").alias("balance_raw"),
        F.round(amount(F.col("amount_in")), 6).alias("amount_in"), F.round(amount(F.col("amount_out")), 6).alias("amount_out"), F.round(F.coalesce(given, product, a), 6).alias("amount"), F.round(amount(F.col("balance")), 6).alias("balance"),
    )


def column_aggregates(tables: DataFrame, trusted: str = "high") -> DataFrame:
    """Sum, mean and maximum of the first numeric column of tables of the given trust."""
    cells = tables.where((F.col("numeric_trust") == trusted) & (F.size("rows") > 0)).select("id", F.posexplode("rows").alias("r", "row")).select("id", "r", F.posexplode("row").alias("c", "cell"))
    parsed = cells.withColumn("v", amount(F.col("cell"))).where("v is not null")
    per_column = parsed.groupBy("id", "c").agg(F.sum("v").alias("total"), F.avg("v").alias("mean"), F.max("v").alias("largest"), F.count("*").alias("n"))
    first = per_column.groupBy("id").agg(F.min(F.struct("c", "total", "mean", "largest", "n")).alias("x"))
    return first.select("id", F.col("x.c").alias("column_no"), F.round("x.total", 4).alias("total"), F.round("x.mean", 4).alias("mean"), F.round("x.largest", 4).alias("largest"), F.col("x.n").alias("n"))


def split_by_headers(rows: DataFrame, pattern: str, default: str = "Generic Section") -> DataFrame:
    """``rows`` (table_id, i, text): rows that match start a part and are consumed; part number and head of the others."""
    w = Window.partitionBy("table_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    head = F.col("text").rlike(pattern)
    out = rows.withColumn("part", F.sum(head.cast("int")).over(w)).withColumn("head", F.coalesce(F.last(F.when(head, F.col("text")), ignorenulls=True).over(w), F.lit(default)))
    return out.where(~head).select("table_id", "i", "text", "part", "head")


# What stands for a table in an answer (fixed values).
TAG = r"\[SHOW_TABLE:CAT=(.*?)\]"


def with_tables(answers: DataFrame, tables: DataFrame) -> DataFrame:
    """``answers`` (id, answer) with their tags replaced by the picture or HTML of the first of their ``tables`` (id, category,
    rank, doc_id, image_path, html_content) of the tag's category, any for an empty one; tags without a table go."""
    parts = F.split("answer", r"\[SHOW_TABLE:CAT=.*?\]", -1)
    tags = F.regexp_extract_all("answer", F.lit(TAG), F.lit(1))
    each = answers.select("id", parts.alias("parts"), tags.alias("tags"))
    asked = each.select("id", F.posexplode("tags").alias("k", "tag")).withColumn("tag", F.trim("tag"))
    picture = F.concat(F.lit("<img src='/ingested/"), "doc_id", F.lit("/"), "image_path", F.lit("'>"))
    shown = tables.select("id", "category", "rank", F.coalesce(F.when(F.col("image_path") != "", picture), F.nullif("html_content", F.lit(""))).alias("html")).where("html is not null")
    found = asked.join(shown, "id").where((F.col("tag") == "") | (F.col("tag") == F.col("category"))).groupBy("id", "k").agg(F.min(F.struct("rank", "html")).alias("x"))
    html = found.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "x.html"))).alias("html"))
    text = F.array_join(F.transform("parts", lambda p, i: F.concat(p, F.coalesce(F.try_element_at("html", i), F.lit("")))), "")
    return each.join(html, "id", "left").select("id", text.alias("answer"))


def html_tables(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit("(?is)<table.*?</table>"), F.lit(0))


def html_title(html: Column, number: int) -> Column:
    """The first caption's text, else ``Table`` and the number."""
    caption = F.trim(F.regexp_replace(F.regexp_extract(html, "(?is)<caption[^>]*>(.*?)</caption>", 1), "<[^>]+>", ""))
    return F.coalesce(F.nullif(caption, F.lit("")), F.lit(f"Table {number}"))


class _Parser(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self.row: list[str] | None = None
        self.cell: list[str] | None = None
        self.spans: list[bool] = []
        self.spanned = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "tr":
            self.handle_endtag("tr")
            self.row, self.spanned = [], False
        elif tag in ("td", "th") and self.row is not None:
            self.handle_endtag("td")
            self.cell = []
            self.spanned |= any(k in ("rowspan", "colspan") and (v or "1").strip().isdigit() and int(v or 1) > 1 for k, v in attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr", "table") and self.cell is not None:
            self.row.append(" ".join("".join(self.cell).split()))
            self.cell = None
        if tag in ("tr", "table") and self.row is not None:
            if self.row:
                self.rows.append(self.row)
                self.spans.append(self.spanned)
            self.row = None

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)


def parse_html(html: str) -> tuple[list[str], list[list[str]], bool, bool]:
    """Columns, rows, whether the body and the header use spanning cells. A spanning body or a lone header gives no table."""
    p = _Parser()
    p.feed(html)
    p.close()
    p.handle_endtag("table")
    if not p.rows:
        return [], [], False, False
    header, body = p.rows[0], p.rows[1:]
    complex_body, complex_header = any(p.spans[1:]), p.spans[0]
    if complex_body or not body:
        return [], [], complex_body, complex_header
    n = len(header)
    return header, [(r + [""] * n)[:n] for r in body], False, complex_header


def parsed_html(tables: DataFrame, html: str = "html_content") -> DataFrame:
    """``tables`` (id, html) with the columns and rows parsed from their HTML, in Arrow batches."""

    def work(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            parsed = [parse_html(h) for h in pdf[html]]
            yield pd.DataFrame({"id": pdf["id"], "columns": [p[0] for p in parsed], "rows": [p[1] for p in parsed], "complex_body": [p[2] for p in parsed], "complex_header": [p[3] for p in parsed]})

    return tables.where(F.col(html).isNotNull()).select("id", html).mapInPandas(work, "id string, columns array<string>, rows array<array<string>>, complex_body boolean, complex_header boolean")

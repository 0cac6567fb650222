"""Registered queries of the core and, where SQL can say the same, their twins in ANSI SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import classify as C
from folioforge.functions import text as X
from folioforge.operators import blocks as B
from folioforge.operators import evaluation as E
from folioforge.operators import retrieval as R
from folioforge.operators import store as S
from folioforge.operators import tables as T
from folioforge.operators import telemetry as M
from folioforge.operators.validation import validate
from folioforge.plans.registry import BLOCKS as _BLOCKS
from folioforge.plans.registry import CHUNKS as _CHUNKS
from folioforge.plans.registry import ORACLES, QUERIES, blocks_of, chunks_of, images_of, query, sql_between_thai, sql_printable, sql_shift_years, sql_strip, sql_thai_spacing, tables_of
from folioforge.plans.registry import TABLES as _TABLES
from folioforge.plans.registry import any_of as _any
from folioforge.session import table

__all__ = ["ORACLES", "QUERIES"]

# --- text -----------------------------------------------------------------------------------------------------------
@query(
    """SELECT file_name, regexp_replace(regexp_replace(lower(trim(file_name)), '\\s+', '_', 'g'), '[^a-z0-9_฀-๿-]', '', 'g') AS doc_key,
       translate(regexp_replace(file_name, '\\.[^.]*$', ''), ' -', '__') AS stem FROM doc_metadata"""
)
def sanitize_doc_id(spark, d):
    return table(spark, d, "doc_metadata").select("file_name", X.sanitize_id(F.col("file_name")).alias("doc_key"), X.file_stem_id(F.col("file_name")).alias("stem"))


@query(
    """SELECT doc_id, md5(trim(regexp_replace(regexp_replace(replace(regexp_replace(t, '[\\x{200B}-\\x{200D}\\x{FEFF}]', '', 'g'), chr(160), ' '), '\\n{3,}', chr(10) || chr(10), 'g'), ' {2,}', ' ', 'g'), ' ' || chr(10) || chr(9))) AS digest
       FROM (SELECT doc_id, text || chr(10) || chr(10) || chr(10) || '  end ' AS t FROM documents)"""
)
def normalize_ws(spark, d):
    t = F.concat("text", F.lit("\n\n\n  end "))
    return table(spark, d, "documents").select("doc_id", F.md5(X.normalize_whitespace(t)).alias("digest"))


@query(
    f"""SELECT id, printable, spaced, line, md FROM (SELECT id, {sql_printable('content')} AS printable, {sql_thai_spacing('content')} AS spaced,
       {sql_strip(sql_between_thai("regexp_replace(" + sql_between_thai('content', '[\\n]+') + ", '\\s+', ' ', 'g')", ' +'))} AS line,
       {sql_thai_spacing("regexp_replace(content, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g')")} AS md FROM {_BLOCKS}) WHERE spaced <> ''"""
)
def clean_blocks(spark, d):
    b = blocks_of(spark, d).select("id", X.printable(F.col("content")).alias("printable"), X.thai_spacing(F.col("content")).alias("spaced"), X.thai_one_line(F.col("content")).alias("line"), X.markdown_text(F.col("content")).alias("md"))
    return b.where("spaced <> ''")


@query(
    f"""SELECT id, regexp_replace(regexp_replace(regexp_replace(h, '<script.*?>.*?</script>', '', 'gis'), ' on\\w+=', ' data-blocked-event=', 'gi'), 'javascript:', 'blocked:', 'gi') AS safe,
       trim(regexp_replace(regexp_replace(h, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS bare,
       array_to_string(list_transform(regexp_extract_all(h, '(?is)<th[^>]*>(.*?)</th>', 1), lambda x: trim(regexp_replace(x, '<[^>]+>', ' ', 'g'))), ' ') AS headers
       FROM (SELECT id, coalesce(html_content, '') || '<script>alert(1)</script><th class="a"><b>Total</b></th><a onclick="x" onLoad = "w" href="JavaScript:y">z</a>' AS h FROM {_TABLES})"""
)
def html_sanitize(spark, d):
    h = F.concat(F.coalesce("html_content", F.lit("")), F.lit('<script>alert(1)</script><th class="a"><b>Total</b></th><a onclick="x" onLoad = "w" href="JavaScript:y">z</a>'))
    return tables_of(spark, d).select("id", X.sanitize_html(h).alias("safe"), X.strip_tags(h).alias("bare"), X.html_headers(h).alias("headers"))


@query(
    f"""SELECT id, CASE WHEN length(html_content) <= 300 THEN html_content WHEN len(regexp_extract_all(c, '<table')) > len(regexp_extract_all(c, '</table>')) THEN c || '</table>' ELSE c END AS cut
       FROM (SELECT *, CASE WHEN contains(left(html_content, 300), '</tr>') THEN left(html_content, 300 - strpos(reverse(left(html_content, 300)), '>rt/<') + 1) ELSE left(html_content, 300) END AS c
       FROM {_TABLES} WHERE html_content IS NOT NULL)"""
)
def html_truncate(spark, d):
    return tables_of(spark, d).where("html_content is not null").select("id", X.truncate_html(F.col("html_content"), 300).alias("cut"))


@query(
    f"""SELECT id, left(regexp_replace(regexp_replace({sql_strip('content')}, '^(?:[0-9]+(?:[.][0-9]+)*|[A-Z])[.)]\\s*', ''), '[\\s\\x0b\\p{{Z}}\\x1c-\\x1f\\x85]+', ' ', 'g'), 150) AS title,
       CASE WHEN trim(coalesce(section, '')) = '' THEN 'General' WHEN length(trim(section)) > 50 THEN left(trim(section), 47) || '...' ELSE trim(section) END AS shown FROM {_BLOCKS}"""
)
def section_titles(spark, d):
    return blocks_of(spark, d).select("id", X.section_title(F.col("content")).alias("title"), X.display_section(F.col("section")).alias("shown"))


@query("""SELECT t AS token, count(*) AS tf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS t FROM documents) GROUP BY t""")
def tokenize_counts(spark, d):
    per = R.postings(table(spark, d, "documents"))
    return per.groupBy("token").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


@query(
    f"""SELECT id, regexp_matches(content, '[A-Za-z0-9_฀-๿]{{3,}}') AS words, len(regexp_extract_all(content, '[A-Za-z0-9฀-๿]')) >= 2 AS marks, regexp_matches(content, '[\\p{{L}}\\p{{N}}]') AS any_sign FROM {_BLOCKS}"""
)
def meaningful(spark, d):
    c = F.col("content")
    return blocks_of(spark, d).select("id", X.meaningful_words(c).alias("words"), X.meaningful_marks(c).alias("marks"), X.meaningful_any(c).alias("any_sign"))


@query(
    f"""SELECT id, translate(content, '๐๑๒๓๔๕๖๗๘๙', '0123456789') AS arabic, translate(content, '0123456789', '๐๑๒๓๔๕๖๗๘๙') AS thai FROM {_BLOCKS}"""
)
def digit_scripts(spark, d):
    c = F.col("content")
    return blocks_of(spark, d).select("id", X.to_arabic_digits(c).alias("arabic"), X.to_thai_digits(c).alias("thai"))


_PROBE = "query || ' ปี ๒๕๖๙ งวดที่ห้า 2026'"
_ARABIC = "translate(q, '๐๑๒๓๔๕๖๗๘๙', '0123456789')"
_SPELLED = "q"
for _w, _v in sorted(X.NUMBER_WORDS, key=lambda x: -len(x[0])):
    _SPELLED = f"replace({_SPELLED}, '{_w}', '{_v}')"


@query(
    f"""SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY k) - 1 AS INT) AS place, variant FROM (SELECT query, variant, min(k) AS k FROM (
       SELECT query, unnest(forms) AS variant, unnest(range(len(forms))) AS k FROM (SELECT query, [q, {_ARABIC}, translate(q, '0123456789', '๐๑๒๓๔๕๖๗๘๙'), w, translate(w, '0123456789', '๐๑๒๓๔๕๖๗๘๙'),
       {sql_shift_years(_ARABIC, -543)}, {sql_shift_years(_ARABIC, 543)}] AS forms FROM (SELECT query, q, {_SPELLED} AS w FROM (SELECT DISTINCT query, {_PROBE} AS q FROM qa_log)))) GROUP BY query, variant)"""
)
def query_variants(spark, d):
    q = table(spark, d, "qa_log").select("query").distinct()
    probe = F.concat("query", F.lit(" ปี ๒๕๖๙ งวดที่ห้า 2026"))
    return q.select("query", F.posexplode(X.query_variants(probe)).alias("place", "variant"))


@query(f"SELECT DISTINCT query, length(trim(query)) >= 15 AND regexp_matches(lower(query), '{C.PLANNER}') AS plans FROM qa_log")
def planner_gate(spark, d):
    return table(spark, d, "qa_log").select("query", C.needs_planning(F.col("query")).alias("plans")).distinct()


@query(
    """SELECT line_no, CAST(json_extract(o, '$.k') AS INTEGER) AS k, CAST(json_extract(o, '$.retry') AS BOOLEAN) AS retry
       FROM (SELECT line_no, nullif(regexp_extract('The call said: ' || coalesce(ctx, 'nothing') || ' - end.', '\\{[^{}]*\\}'), '') AS o FROM cost_log)"""
)
def json_lenient(spark, d):
    prose = F.concat(F.lit("The call said: "), F.coalesce("ctx", F.lit("nothing")), F.lit(" - end."))
    return table(spark, d, "cost_log").select("line_no", X.lenient_json(prose, "k int, retry boolean").alias("o")).select("line_no", "o.k", "o.retry")


@query(
    f"""SELECT c.id, CASE WHEN s.summary IS NULL THEN c.content ELSE '[Doc: ' || c.doc_id || coalesce(' | Section: ' || c.metadata.section, '') || ']' || chr(10) || s.summary || chr(10) || chr(10) || c.content END AS prefixed, c.content AS stripped
       FROM {_CHUNKS} c LEFT JOIN (SELECT doc_id, max(file_name) AS summary FROM doc_metadata GROUP BY doc_id) s USING (doc_id)"""
)
def contextual_prefix(spark, d):
    names = table(spark, d, "doc_metadata").groupBy("doc_id").agg(F.max("file_name").alias("summary"))
    c = chunks_of(spark, d).join(names, "doc_id", "left")
    full = X.with_context(F.col("content"), F.col("doc_id"), F.col("summary"), F.col("metadata.section"))
    return c.select("id", full.alias("prefixed")).withColumn("stripped", X.strip_context(F.col("prefixed")))


@query(
    f"""SELECT doc_id, left(string_agg(part, chr(10) ORDER BY id), 3000) AS sample FROM (
         SELECT doc_id, id, part, coalesce(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
           SELECT doc_id, id, left(trim(content), 600) AS part FROM {_CHUNKS})) WHERE before < 3000 GROUP BY doc_id"""
)
def summary_sample(spark, d):
    part = chunks_of(spark, d).select("doc_id", "id", F.substring(F.trim("content"), 1, 600).alias("part"))
    first = B.leading(part, "doc_id", "id", F.length("part"), 3000)
    joined = first.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("id", "part"))).alias("p"))
    return joined.select("doc_id", F.substring(F.array_join(F.transform("p", lambda x: x["part"]), "\n"), 1, 3000).alias("sample"))


# --- rules ----------------------------------------------------------------------------------------------------------
_T = "lower(coalesce(content, '') || ' ' || coalesce(section, ''))"
_HITS = ", ".join(f"CASE WHEN regexp_matches({_T}, '{p}') THEN '{n}' END" for n, (p, _s, _q) in sorted(C.INTENTS.items(), key=lambda x: -x[1][1]))
_PRIO = " ".join(f"WHEN x = '{n}' THEN {q}" for n, (_p, _s, q) in C.INTENTS.items())


@query(
    f"""SELECT id, array_to_string(names, ',') AS intents, list_aggregate(list_transform(names, lambda x: (CASE {_PRIO} ELSE 1 END)::VARCHAR || x), 'max')[2:] AS primary_intent,
       CASE {' '.join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p in C.SCOPES)} ELSE 'general' END AS scope
       FROM (SELECT id, {_T} AS t, CASE WHEN len(list_filter([{_HITS}], lambda x: x IS NOT NULL)) = 0 THEN ['general'] ELSE list_filter([{_HITS}], lambda x: x IS NOT NULL)[:5] END AS names FROM {_BLOCKS})"""
)
def intent_tags(spark, d):
    c, s = F.col("content"), F.col("section")
    b = blocks_of(spark, d).select("id", C.intents(c, s).alias("names"), C.answer_scope(c, s).alias("scope"))
    return b.select("id", F.array_join("names", ",").alias("intents"), C.primary_intent(F.col("names")).alias("primary_intent"), "scope")


def _wide(pattern: str) -> str:
    return pattern.replace(r"\s", r"[\s\p{Z}]").replace(r"\d", "[0-9]")


@query(
    f"""SELECT id, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(t, '{_wide(C.MONEY)}'), regexp_extract_all(t, '{_wide(C.YEAR)}', 1), regexp_extract_all(t, '{_wide(C.THAI_NAME)}'))))[:10], '|') AS entities
       FROM (SELECT id, left(replace(lower(coalesce(content, '') || ' 12,500.50 baht ' || coalesce(section, '')), chr(160), ' '), 5000) AS t FROM {_BLOCKS})"""
)
def entity_lists(spark, d):
    b = blocks_of(spark, d)
    names = C.entities(F.concat(F.coalesce("content", F.lit("")), F.lit(" 12,500.50 baht")), F.col("section"))
    return b.select("id", F.array_join(names, "|").alias("entities"))


@query(
    f"""SELECT id, CASE WHEN regexp_matches(upper(content), '^(WARNING|CAUTION|DANGER|คำเตือน|ข้อควรระวัง)[:\\s]') THEN 'warning'
       WHEN regexp_matches(upper(content), '^(NOTE|NOTICE|IMPORTANT|หมายเหตุ|สำคัญ|ข้อสังเกต)[:\\s]') THEN 'note'
       WHEN regexp_matches(content, '(?i)^(\\d+\\.|Step\\s+\\d+|ขั้นตอนที่\\s+\\d+|[A-Z]\\.)\\s') THEN 'step' ELSE 'normal' END AS kind,
       array_to_string(list_filter([{', '.join(f"CASE WHEN {_any(_T, w)} THEN '{n}' END" for n, w in C.LAYOUT_INTENTS.items())}], lambda x: x IS NOT NULL), ',') AS intents,
       array_to_string(list_filter([{', '.join(f"CASE WHEN contains(lower(content), '{w}') THEN '{w}' END" for w in C.LAYOUT_ENTITIES)}], lambda x: x IS NOT NULL), ',') AS parts FROM {_BLOCKS}"""
)
def layout_tags(spark, d):
    c = F.col("content")
    return blocks_of(spark, d).select("id", C.block_type(c).alias("kind"), F.array_join(C.layout_intents(c, F.col("section")), ",").alias("intents"), F.array_join(C.layout_entities(c), ",").alias("parts"))


_QI = " ".join(
    f"WHEN regexp_matches(lower(query), '(?:{p}{'|' + C.QUERY_MORE[n] if n in C.QUERY_MORE else ''})') THEN '{n}'" for n, (p, _s, _q) in sorted(C.INTENTS.items(), key=lambda x: -x[1][1])
)


@query(f"SELECT DISTINCT query, CASE {_QI} END AS intent FROM qa_log")
def query_intent(spark, d):
    return table(spark, d, "qa_log").select("query", C.query_intent(F.col("query")).alias("intent")).distinct()


_DT = {n: " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in ws) for n, ws in C.DOC_TYPES.items()}


@query(
    f"""SELECT doc_id, CASE WHEN greatest({', '.join(f's_{n}' for n in _DT)}) = 0 THEN 'generic' {' '.join(f"WHEN s_{n} = greatest({', '.join(f's_{m}' for m in _DT)}) THEN '{n}'" for n in _DT)} END AS kind
       FROM (SELECT doc_id, {', '.join(f'{e} AS s_{n}' for n, e in _DT.items())} FROM documents)"""
)
def doc_classify(spark, d):
    return table(spark, d, "documents").select("doc_id", C.document_type(F.col("text")).alias("kind"))


_BARE = "replace(content, ' ', '')"


@query(
    f"""SELECT id, pos, CASE WHEN {_any(_BARE, C.QNA_HINTS)} OR {_any('lower(content)', C.EXAM)} THEN 'qna'
       WHEN (h AND (pos < 10 OR coalesce(page, 0) <= 2)) OR (pos = 0 AND length(content) <= 120) THEN 'header'
       {' '.join(f"WHEN {_any('lower(content)', w)} THEN '{n}'" for n, w in C.SECTIONS)} ELSE 'other' END AS section_rule
       FROM (SELECT * REPLACE ({sql_strip('content')} AS content), coalesce(extra['is_heading'] = 'true', false) AS h, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(page, 1), id) - 1 AS INT) AS pos FROM {_BLOCKS})"""
)
def section_rules(spark, d):
    heading = F.coalesce(F.col("extra")["is_heading"] == "true", F.lit(False))
    b = B.positions(blocks_of(spark, d).select("id", "doc_id", "page", "content", heading.alias("h")))
    return b.select("id", "pos", C.section_rule(F.col("content"), F.col("h"), F.col("pos"), F.col("page")).alias("section_rule"))


_ROLE = {"text": "c", "lower": "lower(c)"}
_ROLE_RULES = {
    "short question": "(contains(c, '?') AND length(c) < 200)", "title": "(s = 'header' AND (h OR length(c) < 120))", "row": "(s = 'transactions' AND length(c) BETWEEN 10 AND 200)",
    "numbered clause": "(s = 'legal_section' AND regexp_matches(c, '^[0-9]+[.]'))",
}


def _role_sql(rule: tuple) -> str:
    return " OR ".join(_ROLE_RULES[w] if at == "rule" else f"starts_with(replace(c, ' ', ''), '{w[0]}')" if at == "bare" else _any(_ROLE[at], w) for at, w in rule)


@query(
    f"""SELECT id, CASE {' '.join(f"WHEN {_role_sql(rule)} THEN '{role}'" for role, rule in C.TEXT_ROLES)} ELSE 'other' END AS text_role
       FROM (SELECT id, {sql_strip('content')} AS c, coalesce(extra['section'], lower(section), '') AS s, coalesce(extra['is_heading'] = 'true', false) AS h FROM {_BLOCKS})"""
)
def role_rules(spark, d):
    """The tag in extra decides; files that lack it keep their section in the column."""
    heading = F.coalesce(F.col("extra")["is_heading"] == "true", F.lit(False))
    return blocks_of(spark, d).select("id", C.text_role(F.col("content"), F.coalesce(F.col("extra")["section"], F.lower("section")), heading).alias("text_role"))


# --- tables ---------------------------------------------------------------------------------------------------------
_HC = "CASE " + " ".join(f"WHEN contains(h, '{k}') THEN '{n}'" for ks, n in C.HEADERS for k in ks) + " ELSE h END"


@query(
    f"""SELECT id, string_agg({_HC}, '|' ORDER BY k) AS names,
       any_value(CASE WHEN {_any('j', ('date', 'วันที่'))} AND {_any('j', ('amount', 'ยอด', 'debit', 'credit', 'balance', 'price'))} THEN 'transaction_table' WHEN {_any('j', ('summary', 'สรุป', 'total', 'รวม'))} THEN 'summary_table' ELSE 'other_table' END) AS table_role
       FROM (SELECT id, unnest(range(len(columns))) AS k, trim(lower(unnest(columns))) AS h, lower(array_to_string(columns, ' ')) AS j FROM {_TABLES} WHERE len(columns) > 0) GROUP BY id"""
)
def header_canon(spark, d):
    t = tables_of(spark, d).where("size(columns) > 0")
    return t.select("id", F.array_join(F.transform("columns", C.header_name), "|").alias("names"), C.table_role(F.col("columns")).alias("table_role"))


_AMOUNT = """CASE WHEN regexp_matches(a, '^[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?$') THEN TRY_CAST(a AS DOUBLE) END"""


@query(
    f"""SELECT DISTINCT cell, {_AMOUNT} AS amount FROM (SELECT cell, CASE WHEN regexp_matches(s, '^\\(.*\\)$') THEN '-' || s[2:-2] ELSE s END AS a FROM (
       SELECT cell, regexp_replace(cell, '[,฿\\s]', '', 'g') AS s FROM (SELECT unnest(flatten(rows)) AS cell FROM table_blocks) WHERE cell IS NOT NULL))"""
)
def amounts(spark, d):
    cells = table(spark, d, "table_blocks").select(F.explode(F.flatten("rows")).alias("cell")).where("cell is not null").distinct()
    return cells.select("cell", X.amount(F.col("cell")).alias("amount"))


_CANON = "CASE " + " ".join(f"WHEN contains(trim(lower(c)), '{k}') THEN '{n}'" for ks, n in C.HEADERS for k in ks) + " ELSE trim(lower(c)) END"
_NAMES = f"list_transform(columns, lambda c: {_CANON})"


def _field(n: str) -> str:
    at = f"(len(names) + 1 - list_position(list_reverse(names), '{n}'))"
    return f"nullif(trim(CASE WHEN list_contains(names, '{n}') AND {at} <= len(r) THEN r[{at}] END), '')"


def _amount_of(x: str) -> str:
    bare = f"regexp_replace({x}, '[,฿\\s]', '', 'g')"
    signed = f"(CASE WHEN regexp_matches({bare}, '^\\(.*\\)$') THEN '-' || {bare}[2:-2] ELSE {bare} END)"
    return f"(CASE WHEN regexp_matches({signed}, '^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$') THEN TRY_CAST({signed} AS DOUBLE) END)"


@query(
    f"""WITH t AS (SELECT id, rows, {_NAMES} AS names FROM {_TABLES} WHERE len(columns) > 0 AND len(rows) > 0),
      r AS (SELECT id, names, unnest(rows) AS r, CAST(unnest(range(len(rows))) AS INT) AS row_no FROM t),
      f AS (SELECT id, row_no, {', '.join(f'{_field(n)} AS {n}' for n in T.TRANSACTION)} FROM r),
      a AS (SELECT *, {_amount_of('amount')} AS a, {_amount_of('quantity')} AS q, {_amount_of('unit_price')} AS u FROM f WHERE coalesce({', '.join(T.TRANSACTION)}) IS NOT NULL)
      SELECT id, row_no, date AS date_raw, description, amount_in AS amount_in_raw, amount_out AS amount_out_raw, balance AS balance_raw, round({_amount_of('amount_in')}, 6) AS amount_in, round({_amount_of('amount_out')}, 6) AS amount_out,
        round(coalesce(CASE WHEN a <> 0 THEN a END, CASE WHEN q <> 0 AND u <> 0 THEN q * u END, a), 6) AS amount, round({_amount_of('balance')}, 6) AS balance FROM a"""
)
def table_transactions(spark, d):
    return T.transactions(tables_of(spark, d).select("id", "columns", "rows"))


@query(
    f"""WITH c AS (SELECT id, k, {_amount_of('cell')} AS v FROM (SELECT id, unnest(r) AS cell, CAST(unnest(range(len(r))) AS INT) AS k FROM (SELECT id, unnest(rows) AS r FROM {_TABLES} WHERE numeric_trust = 'high' AND len(rows) > 0))),
      g AS (SELECT id, k, sum(v) AS total, avg(v) AS mean, max(v) AS largest, count(*) AS n FROM c WHERE v IS NOT NULL GROUP BY id, k)
      SELECT id, k AS column_no, round(total, 4) AS total, round(mean, 4) AS mean, round(largest, 4) AS largest, n FROM g QUALIFY row_number() OVER (PARTITION BY id ORDER BY k) = 1"""
)
def table_column_aggregates(spark, d):
    return T.column_aggregates(tables_of(spark, d))


def _row(r: str) -> str:
    return f"list_transform(range(1, len(columns) + 1), lambda i: coalesce({r}[i], ''))"


def _md(rows: str) -> str:
    line = lambda x: f"'| ' || array_to_string({x}, ' | ') || ' |'"
    rule = "list_transform(columns, lambda c: '---')"
    return f"CASE WHEN len(columns) > 0 THEN array_to_string(list_concat([{line(_row('columns'))}, {line(rule)}], list_transform({rows}, lambda r: {line(_row('r'))})), chr(10)) ELSE '' END"


_HTML = f"""'<table><tr>' || coalesce(array_to_string(list_transform(columns, lambda c: '<th>' || coalesce(c, '') || '</th>'), ''), '') || '</tr>' ||
       coalesce(array_to_string(list_transform(rows, lambda r: '<tr>' || array_to_string(list_transform({_row('r')}, lambda c: '<td>' || c || '</td>'), '') || '</tr>'), ''), '') || '</table>'"""


def _filled(x: str) -> str:
    return f"(CASE WHEN {sql_strip(x)} <> '' THEN {x} END)"


@query(f"SELECT id, {_md('rows')} AS md, {_HTML} AS html, {_filled('markdown')} AS markdown FROM {_TABLES} WHERE columns IS NOT NULL AND rows IS NOT NULL")
def table_renderings(spark, d):
    t = tables_of(spark, d).where("columns is not null and rows is not null")
    return t.select("id", T.to_markdown(F.col("columns"), F.col("rows")).alias("md"), T.to_html(F.col("columns"), F.col("rows")).alias("html"), X.blank_to_null(F.col("markdown")).alias("markdown"))


@query()
def table_texts(spark, d):
    t = tables_of(spark, d)
    c, r, m = F.col("columns"), F.col("rows"), F.col("markdown")
    summary = F.col("extra")["summary"]
    return t.select(
        "id", T.to_markdown(c, r).alias("md"), T.to_html(c, r).alias("html"), T.semantic_rows(c, r).alias("semantic"), T.embed_text(F.col("name"), summary, m, c, r).alias("embed_text"),
        T.chunk_text(m, c, r).alias("chunk_text"), T.unified_text(F.col("name"), F.col("category"), summary, c, m, r).alias("unified"),
    )


_TOP = "len(list_filter(rows[1], lambda c: regexp_matches(c, '[A-Za-z\u0e00-\u0e7f]'))) >= greatest(1, len(rows[1]) // 2) AND len(rows) > 0"


@query(f"SELECT id, CASE WHEN {_TOP} THEN array_to_string(rows[1], '|') ELSE '' END AS header, CAST(CASE WHEN {_TOP} THEN len(rows) - 1 ELSE len(rows) END AS INT) AS n_rows FROM {_TABLES}")
def table_headers(spark, d):
    bare = tables_of(spark, d).select("id", T.inferred_header(F.array().cast("array<string>"), F.col("rows")).alias("x"))
    return bare.select("id", F.array_join("x.columns", "|").alias("header"), F.size("x.rows").alias("n_rows"))


@query()
def table_html(spark, d):
    p = T.parsed_html(tables_of(spark, d))
    return p.select("id", F.array_join("columns", "|").alias("header"), F.size("rows").alias("n_rows"), "complex_body", "complex_header")


@query(
    f"""SELECT table_id, i, text, CAST(part AS BIGINT) AS part, coalesce(head, 'Generic Section') AS head FROM (SELECT *, sum(CAST(regexp_matches(text, 'รายการ|total|Total') AS INT)) OVER w AS part,
       last_value(CASE WHEN regexp_matches(text, 'รายการ|total|Total') THEN text END IGNORE NULLS) OVER w AS head
       FROM (SELECT id AS table_id, CAST(unnest(range(len(rows))) AS INT) AS i, array_to_string(unnest(rows), ' ') AS text FROM {_TABLES})
       WINDOW w AS (PARTITION BY table_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE NOT regexp_matches(text, 'รายการ|total|Total')"""
)
def split_tables(spark, d):
    rows = tables_of(spark, d).select(F.col("id").alias("table_id"), F.posexplode("rows").alias("i", "row")).select("table_id", "i", F.array_join("row", " ").alias("text"))
    return T.split_by_headers(rows, "รายการ|total|Total")


# --- context --------------------------------------------------------------------------------------------------------
_MATCHED = f"(SELECT id AS chunk_id, doc_id, page, left(content, 700) AS content, hash_rank AS rank FROM (SELECT *, CAST(row_number() OVER (ORDER BY length(content) DESC, id) AS INT) AS hash_rank FROM {_CHUNKS}) WHERE hash_rank <= 40)"


@query(
    f"""WITH m AS (SELECT * FROM {_MATCHED} QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY rank) = 1),
      p AS (SELECT m.*, c.id AS near_id, left(c.content, 700) AS near FROM m LEFT JOIN {_CHUNKS} c ON c.doc_id = m.doc_id AND c.page IS NOT DISTINCT FROM m.page AND left(c.content, 700) <> m.content),
      r AS (SELECT *, sum(length(near)) OVER (PARTITION BY chunk_id ORDER BY near_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM p)
      SELECT doc_id, page, chunk_id, rank, content || coalesce(string_agg(chr(10) || chr(10) || near, '' ORDER BY near_id) FILTER (length(content) + running <= 3000), '') AS "window" FROM r GROUP BY doc_id, page, chunk_id, rank, content"""
)
def page_window(spark, d):
    c = chunks_of(spark, d).select("doc_id", "page", F.col("id").alias("chunk_id"), F.substring("content", 1, 700).alias("content"), F.length("content").alias("n"))
    top = c.orderBy(F.desc("n"), "chunk_id").limit(40)  # the matches of a search stand in as the longest chunks
    matched = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "chunk_id"))).drop("n")
    return R.page_window(matched, c.drop("n"))


@query(
    f"""SELECT string_agg('[Source ' || rank || '] doc=' || doc_id || ' page=' || coalesce(CAST(page AS VARCHAR), '?') || chr(10) || left(content, 800), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context
       FROM (SELECT *, row_number() OVER (ORDER BY length(content) DESC, id) AS rank FROM {_CHUNKS} QUALIFY rank <= 5)"""
)
def context_build(spark, d):
    top = chunks_of(spark, d).orderBy(F.desc(F.length("content")), "id").limit(5)
    return R.context(top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.length("content")), "id"))), 800)


@query(f"SELECT id, doc_id, lower(trim(source)) AS source FROM {_CHUNKS} WHERE source IN ('table') AND doc_type IN ('invoice', 'contract') AND coalesce(CAST(page AS VARCHAR), '') <> ''")
def filtered_chunks(spark, d):
    c = R.post_filter(chunks_of(spark, d), sources=["table"], doc_types=["invoice", "contract"]).where(F.coalesce(F.col("page").cast("string"), F.lit("")) != "")
    return c.select("id", "doc_id", F.lower(F.trim("source")).alias("source"))


@query("SELECT DISTINCT doc_id, file_name FROM doc_metadata WHERE contains(lower(file_name), 'invoice') OR contains(lower(doc_id), '0042')")
def doc_search(spark, d):
    m = table(spark, d, "doc_metadata")
    return m.where(F.lower("file_name").contains("invoice") | F.lower("doc_id").contains("0042")).select("doc_id", "file_name").distinct()


# --- telemetry ------------------------------------------------------------------------------------------------------
_K = "coalesce(nullif(lower(trim({c})), ''), 'unknown')"
_LOG = f"(SELECT {_K.format(c='endpoint')} AS endpoint, {_K.format(c='provider')} AS provider, {_K.format(c='model')} AS model, coalesce(cost_usd, 0) AS cost FROM cost_log)"


@query(
    f"""SELECT CASE WHEN grouping(endpoint, provider, model) = 7 THEN 'total' WHEN grouping(endpoint) = 0 THEN 'endpoint' WHEN grouping(provider) = 0 THEN 'provider' ELSE 'model' END AS dimension,
       coalesce(endpoint, provider, model, 'all') AS key, count(*) AS calls, round(sum(cost), 6) AS cost FROM {_LOG} GROUP BY GROUPING SETS ((), (endpoint), (provider), (model))"""
)
def cost_grouping_sets(spark, d):
    return M.grouping_sets(table(spark, d, "cost_log"))


@query("SELECT coalesce(user_id, '0') AS user_id, count(*) AS calls, round(sum(coalesce(cost_usd, 0)), 6) AS cost FROM cost_log GROUP BY 1")
def cost_per_user(spark, d):
    return M.per_user(table(spark, d, "cost_log"))


@query("SELECT count(*) AS calls, round(sum(coalesce(cost_usd, 0)), 6) AS cost FROM cost_log WHERE ts >= TIMESTAMPTZ '2024-09-01 12:00:00+00'")
def cost_session(spark, d):
    log = table(spark, d, "cost_log").where(F.col("ts") >= F.expr("timestamp '2024-09-01 12:00:00 UTC'"))
    return log.agg(F.count("*").alias("calls"), F.round(F.sum(F.coalesce("cost_usd", F.lit(0.0))), 6).alias("cost"))


@query("SELECT line_no FROM cost_log WHERE CAST(ts AT TIME ZONE 'UTC' AS DATE) > (SELECT max(CAST(ts AT TIME ZONE 'UTC' AS DATE)) - 1 FROM cost_log)")
def cost_last_days(spark, d):
    return M.last_days(table(spark, d, "cost_log"), 1).select("line_no")


@query("SELECT line_no, endpoint, user_id FROM cost_log ORDER BY ts DESC, line_no DESC LIMIT 50")
def recent_calls(spark, d):
    return M.recent(table(spark, d, "cost_log"), 50).select("line_no", "endpoint", "user_id")


@query(
    """SELECT line_no, round(coalesce(prompt_tokens, 0) * coalesce(a.rate_input_per_m, b.rate_input_per_m, c.rate_input_per_m, 0) / 1e6 + coalesce(completion_tokens, 0) * coalesce(a.rate_output_per_m, b.rate_output_per_m, c.rate_output_per_m, 0) / 1e6, 8) AS unit_cost
       FROM (SELECT line_no, prompt_tokens, completion_tokens, CASE line_no % 5 WHEN 0 THEN model WHEN 1 THEN ' openai/' || model || ' ' WHEN 2 THEN upper(model) WHEN 3 THEN 'x/' || model ELSE 'other' END AS m FROM cost_log) l
       LEFT JOIN model_prices a ON trim(l.m) = a.model LEFT JOIN model_prices b ON starts_with(trim(l.m), 'openai/') AND trim(l.m)[8:] = b.model LEFT JOIN (SELECT DISTINCT ON (lower(model)) * FROM model_prices) c ON lower(trim(l.m)) = lower(c.model)"""
)
def price_lookup(spark, d):
    k = F.col("line_no") % 5
    asked = F.when(k == 0, F.col("model")).when(k == 1, F.concat(F.lit(" openai/"), "model", F.lit(" "))).when(k == 2, F.upper("model")).when(k == 3, F.concat(F.lit("x/"), "model")).otherwise("other")
    return M.priced(table(spark, d, "cost_log").withColumn("model", asked), table(spark, d, "model_prices")).select("line_no", "unit_cost")


@query(
    """SELECT day, cost, CASE WHEN cost / 5.0 >= 0.9 THEN 'high' WHEN cost / 5.0 >= 0.5 THEN 'warn' ELSE 'ok' END AS level
       FROM (SELECT CAST(ts AT TIME ZONE 'UTC' AS DATE) AS day, round(sum(coalesce(cost_usd, 0)), 6) AS cost FROM cost_log GROUP BY 1)"""
)
def cost_level(spark, d):
    return M.daily_level(table(spark, d, "cost_log"), 5.0)


@query(
    """SELECT day, CAST(hour AS INT) AS hour, calls, round(sum(cost) OVER (PARTITION BY day ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS running_cost
       FROM (SELECT CAST(ts AT TIME ZONE 'UTC' AS DATE) AS day, hour(ts AT TIME ZONE 'UTC') AS hour, count(*) AS calls, sum(coalesce(cost_usd, 0)) AS cost FROM cost_log GROUP BY ALL)"""
)
def cost_running(spark, d):
    return M.running_by_day(table(spark, d, "cost_log"))


@query("SELECT min(line_no) AS line_no, count(*) AS copies FROM cost_log GROUP BY ts, endpoint, provider, model, prompt_tokens, completion_tokens, rate_input_per_m, rate_output_per_m, cost_usd, user_id, ctx")
def cost_deduplicated(spark, d):
    log = table(spark, d, "cost_log")
    return log.groupBy(*[c for c in log.columns if c != "line_no"]).agg(F.min("line_no").alias("line_no"), F.count("*").alias("copies")).select("line_no", "copies")


@query("SELECT c_custkey, coalesce(o.n, 0) AS orders, coalesce(o.total, 0) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def users_left_totals(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    c = table(spark, d, "customer").select("c_custkey")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("total", F.lit(0.0)).alias("total"))


@query("SELECT event_type, quantile_disc_x AS p95 FROM (SELECT event_type, list_sort(list(value))[greatest(1, CAST(floor(count(value) * 0.95) AS INT))] AS quantile_disc_x FROM events WHERE value IS NOT NULL GROUP BY 1)")
def latency_p95(spark, d):
    return M.p95_distributed(table(spark, d, "events"), "event_type", "value")


@query(
    """SELECT coalesce(lower(intent), 'none') AS intent, count(*) AS n, round(avg(CASE WHEN contains(lower(coalesce(answer, '')), 'the') THEN 0.5 ELSE 0 END + CASE WHEN contains(lower(coalesce(answer, '')), 'ตาม') THEN 0.5 ELSE 0 END), 3) AS keyword_recall,
       round(avg(CAST(list_has_any(doc_ids, ['doc_00000001', 'doc_00000002', 'doc_00000003']) AS DOUBLE)), 3) AS doc_match FROM qa_log GROUP BY 1"""
)
def eval_summary(spark, d):
    qa = table(spark, d, "qa_log")
    r = qa.select(
        F.coalesce(F.lower("intent"), F.lit("none")).alias("intent"), E.keyword_recall(F.col("answer"), F.array(F.lit("The"), F.lit("ตาม"))).alias("recall"),
        E.doc_match(F.col("doc_ids"), F.array(F.lit("doc_00000001"), F.lit("doc_00000002"), F.lit("doc_00000003"))).alias("match"), F.lit(None).cast("double").alias("judge"), F.lit(None).cast("double").alias("latency"),
    )
    return E.summary(r, "intent").select("intent", "n", "keyword_recall", "doc_match")


@query("SELECT mktsegment, pct, CASE WHEN pct >= 80 THEN 'excellent' WHEN pct >= 70 THEN 'good' WHEN pct >= 50 THEN 'fair' ELSE 'poor' END AS grade FROM (SELECT c_mktsegment AS mktsegment, round(avg(c_custkey % 6) * 20, 4) AS pct FROM customer GROUP BY 1)")
def grade_bucket(spark, d):
    g = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("mktsegment")).agg(F.round(F.avg(F.col("c_custkey") % 6) * 20, 4).alias("pct"))
    return g.withColumn("grade", C.grade(F.col("pct")))


@query("""SELECT event_id, CASE WHEN regexp_matches(lower(event_type), 'error|exception|traceback|fail') THEN 'error' WHEN contains(lower(event_type), 'warn') THEN 'warning' WHEN contains(lower(event_type), 'debug') THEN 'debug' ELSE 'info' END AS level,
       CASE WHEN value IS NULL OR value = 0 THEN '$0.00' WHEN value < 0.01 THEN '$' || printf('%.5f', value) WHEN value < 1 THEN '$' || printf('%.4f', value) ELSE '$' || printf('%.2f', value) END AS usd FROM events""")
def log_levels(spark, d):
    return table(spark, d, "events").select("event_id", C.log_level(F.col("event_type")).alias("level"), X.usd(F.col("value")).alias("usd"))


# --- windows and stores ---------------------------------------------------------------------------------------------
@query(
    f"""SELECT id, last_value(CASE WHEN coalesce(extra['is_heading'], 'false') = 'true' THEN nullif(content, '') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY coalesce(page, 1), id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM {_BLOCKS}"""
)
def section_ffill(spark, d):
    heading = F.when(F.coalesce(F.col("extra")["is_heading"], F.lit("false")) == "true", F.nullif("content", F.lit("")))
    return B.carried(blocks_of(spark, d).select("id", "doc_id", "page", heading.alias("h")), F.col("h"), "carried", inclusive=True).select("id", "carried")


_TITLE = f"left(regexp_replace(regexp_replace({sql_strip('content')}, '^(?:[0-9]+(?:[.][0-9]+)*|[A-Z])[.)]\\s*', ''), '[\\s\\x0b\\p{{Z}}\\x1c-\\x1f\\x85]+', ' ', 'g'), 150)"


@query(f"SELECT id, last_value(CASE WHEN coalesce(extra['is_heading'], 'false') = 'true' THEN nullif({_TITLE}, '') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY coalesce(page, 1), id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled_section FROM {_BLOCKS}")
def filled_sections(spark, d):
    return B.filled_sections(blocks_of(spark, d).select("id", "doc_id", "page", "content", "extra")).select("id", "filled_section")


@query()
def merged_blocks(spark, d):
    return B.merged(blocks_of(spark, d)).select("doc_id", "page", "id", "kind", "blocks", F.md5("content").alias("digest"))


@query()
def semantic_chunks(spark, d):
    return B.chunks(blocks_of(spark, d))


@query(
    f"""WITH RECURSIVE b AS (SELECT doc_id, page, id, length(content) AS n, row_number() OVER (PARTITION BY doc_id, page ORDER BY id) AS k FROM (SELECT * REPLACE (coalesce(page, 1) AS page, coalesce(content, '') AS content) FROM {_BLOCKS})),
      r AS (SELECT doc_id, page, id, k, n, 0 AS chunk FROM b WHERE k = 1 UNION ALL
            SELECT b.doc_id, b.page, b.id, b.k, CASE WHEN r.n + b.n > 1200 THEN b.n ELSE r.n + b.n END, CASE WHEN r.n + b.n > 1200 THEN chunk + 1 ELSE chunk END FROM r JOIN b ON b.doc_id = r.doc_id AND b.page = r.page AND b.k = r.k + 1)
      SELECT doc_id, page, id, chunk FROM r"""
)
def size_chunker(spark, d):
    return B.size_chunks(blocks_of(spark, d))


@query(f"SELECT doc_id, page, id, tail_chars FROM (SELECT doc_id, page, id, CAST(sum(length(content)) OVER (PARTITION BY doc_id, page ORDER BY id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS tail_chars FROM {_BLOCKS}) WHERE tail_chars <= 150")
def overlap_tail(spark, d):
    return B.overlap_tail(blocks_of(spark, d))


@query(f"SELECT min(id) AS id, md5(content) AS fingerprint, doc_id, count(*) AS copies FROM {_BLOCKS} GROUP BY doc_id, md5(content)")
def dedupe_md5(spark, d):
    return B.first_copies(blocks_of(spark, d), "doc_id")


@query(f"SELECT id, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY CAST(trunc(coalesce(bbox[2], 0) / 12) AS INT), coalesce(bbox[1], 0), id) AS INT) AS place FROM {_BLOCKS}")
def reading_order(spark, d):
    return B.reading_order(blocks_of(spark, d)).select("id", "place")


@query(
    f"""SELECT id, med AS median_size, CASE WHEN length(t) < 200 AND regexp_matches(t, '[\\p{{L}}\\p{{M}}]') AND size > 1.5 * med THEN 'H1' WHEN length(t) < 200 AND regexp_matches(t, '[\\p{{L}}\\p{{M}}]') AND size > 1.2 * med THEN 'H2' END AS level
       FROM (SELECT b.id, trim(content) AS t, coalesce(TRY_CAST(extra['font_size'] AS DOUBLE), 10) AS size, median(coalesce(TRY_CAST(extra['font_size'] AS DOUBLE), 10)) OVER (PARTITION BY doc_id, coalesce(page, 1)) AS med FROM {_BLOCKS} b)"""
)
def median_heading(spark, d):
    return B.font_headings(blocks_of(spark, d)).select("id", "median_size", "level")


@query(f"SELECT id, CASE WHEN bbox[4] < 0.07 * 842.0 THEN 'header' WHEN bbox[2] > 0.93 * 842.0 THEN 'footer' ELSE 'body' END AS margin FROM {_BLOCKS}")
def margin_flags(spark, d):
    return B.margins(blocks_of(spark, d)).select("id", "margin")


def _sql_form(form: str, *values: str) -> str:
    parts, out = form.split("{}"), []
    for k, p in enumerate(parts):
        out.append("'" + p.replace("\n", "' || chr(10) || '") + "'")
        if k < len(values):
            out.append(values[k])
    return "(" + " || ".join(out) + ")"


_PAGE_TEXT = " ".join(f"WHEN '{r}' THEN {_sql_form(f, 't')}" for r, f in B.TEXT_FORMS.items())
_MARKDOWN_SQL = f"""SELECT doc_id, CAST(page AS INT) AS page, {_sql_form(B.PAGE_HEAD, 'page')} || chr(10) || string_agg(line, chr(10) ORDER BY y0, x0, kind, id) AS markdown FROM (
       SELECT doc_id, coalesce(page, 1) AS page, coalesce(bbox[2], 0) AS y0, coalesce(bbox[1], 0) AS x0, 0 AS kind, id, CASE WHEN t = '' THEN '' ELSE CASE coalesce(extra['role'], role, 'normal_text') {_PAGE_TEXT} ELSE t END END AS line
         FROM (SELECT *, {sql_thai_spacing("regexp_replace(content, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g')")} AS t FROM {_BLOCKS} WHERE content IS NOT NULL)
       UNION ALL SELECT doc_id, coalesce(page, 1), coalesce(bbox[2], 0), coalesce(bbox[1], 0), 1, id, concat_ws(chr(10), {_sql_form(B.TABLE_NAME, "nullif(name, '')")}, {_sql_form(B.TABLE_SUMMARY, "nullif(extra['summary'], '')")}, coalesce(nullif(markdown, ''), '{B.TABLE_EMPTY}'), chr(10)) FROM {_TABLES}
       UNION ALL SELECT doc_id, coalesce(page, 1), coalesce(bbox[2], 0), coalesce(bbox[1], 0), 2, id, concat_ws(chr(10), {_sql_form(B.IMAGE_LINK, "coalesce(nullif(name, ''), 'Image')", 'f', 'f')}, {_sql_form(B.IMAGE_CAPTION, "nullif(name, '')")}, {_sql_form(B.IMAGE_FILE, 'f', 'f')})
         FROM (SELECT *, regexp_extract(image_path, '([^/]+)$', 1) AS f FROM {_TABLES} WHERE image_path IS NOT NULL)) GROUP BY doc_id, page"""


@query(_MARKDOWN_SQL)
def page_markdown(spark, d):
    return B.markdown(blocks_of(spark, d), B.table_lines(tables_of(spark, d)), B.image_lines(images_of(spark, d)))


@query(
    f"""WITH b AS (SELECT id, doc_id, page, bbox FROM {_BLOCKS} WHERE bbox IS NOT NULL AND page IS NOT NULL), t AS (SELECT id, doc_id, page, bbox FROM {_TABLES} WHERE bbox IS NOT NULL AND page IS NOT NULL),
      p AS (SELECT doc_id, page, t.id AS region_id, b.id AS box_id, round(greatest(0, least(b.bbox[3], t.bbox[3]) - greatest(b.bbox[1], t.bbox[1])) * greatest(0, least(b.bbox[4], t.bbox[4]) - greatest(b.bbox[2], t.bbox[2])) / ((t.bbox[3] - t.bbox[1]) * (t.bbox[4] - t.bbox[2])), 6) AS share FROM b JOIN t USING (doc_id, page))
      SELECT doc_id, page, region_id, max(share) AS share, arg_min(box_id, (-share, box_id)) AS box_id FROM p WHERE share > 0 GROUP BY doc_id, page, region_id"""
)
def best_region(spark, d):
    def boxes(t: DataFrame, p: str, name: str) -> DataFrame:
        return t.where("bbox is not null and page is not null").select("doc_id", "page", F.col("id").alias(name), *(F.try_element_at("bbox", F.lit(k + 1)).alias(f"{p}{c}") for k, c in enumerate(("x0", "y0", "x1", "y1"))))

    return B.best_region(boxes(blocks_of(spark, d), "b", "box_id"), boxes(tables_of(spark, d), "r", "region_id"))


def _dup(t: str, code: str) -> str:
    return f"SELECT min(doc_id) AS doc_id, id AS item_id, 'warning' AS level, '{code}' AS code FROM {t} WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1"


_E = "coalesce(trim({c}), '') = ''"
_TXT = [("warning", "TEXT_PAGE_INVALID", "page <= 0"), ("warning", "TEXT_PAGE_OUT_OF_RANGE", "page > n AND n > 0"), ("info", "TEXT_BLOCK_VERY_LONG", "length(content) > 8000"), ("info", "TEXT_BLOCK_VERY_SHORT", f"length({sql_strip('content')}) < 2"), ("warning", "TEXT_BBOX_INVALID", "len(bbox) <> 4"), ("info", "TEXT_NO_SECTION", "NOT coalesce(list_contains(map_keys(extra), 'section'), FALSE)"), ("info", "TEXT_NO_ROLE", "NOT coalesce(list_contains(map_keys(extra), 'role'), FALSE)")]
_TBL = [("warning", "TABLE_PAGE_INVALID", "page <= 0"), ("warning", "TABLE_PAGE_OUT_OF_RANGE", "page > n AND n > 0"), ("warning", "TABLE_NO_HEADER", "coalesce(len(columns), 0) = 0 AND coalesce(len(rows), 0) > 0"), ("warning", "TABLE_NO_ROWS", "coalesce(len(rows), 0) = 0 AND coalesce(len(columns), 0) > 0"), ("warning", "TABLE_BBOX_INVALID", "len(bbox) <> 4"), ("info", "TABLE_NO_CATEGORY", "coalesce(category, '') = ''"), ("info", "TABLE_NO_ROLE", "NOT coalesce(list_contains(map_keys(extra), 'role'), FALSE)")]
_DOC = [("warning", "MISSING_FILE_NAME", _E.format(c="file_name")), ("error", "MISSING_DOC_ID", _E.format(c="doc_id")), ("warning", "MISSING_PAGE_COUNT", "page_count IS NULL AND max_page IS NOT NULL"), ("warning", "INVALID_PAGE_COUNT", "page_count <= 0"), ("warning", "PAGE_COUNT_MISMATCH", "page_count > 0 AND max_page > page_count"), ("error", "NO_TEXT_BLOCKS", "NOT has_text")]


@query(
    f"""WITH m AS (SELECT doc_id, max(page_count) AS n FROM doc_metadata GROUP BY 1), top AS (SELECT doc_id, max(page) AS max_page FROM (SELECT doc_id, page FROM text_blocks UNION ALL SELECT doc_id, page FROM table_blocks) GROUP BY 1),
      d AS (SELECT doc_metadata.*, max_page, doc_id IN (SELECT doc_id FROM text_blocks) AS has_text FROM doc_metadata LEFT JOIN top USING (doc_id)), x AS (SELECT * FROM text_blocks LEFT JOIN m USING (doc_id)), b AS (SELECT * FROM table_blocks LEFT JOIN m USING (doc_id)) """
    + " UNION ALL ".join(
        [f"SELECT doc_id, CAST(NULL AS VARCHAR) AS item_id, '{lv}' AS level, '{c}' AS code FROM d WHERE {w}" for lv, c, w in _DOC]
        + [f"SELECT doc_id, id, '{lv}', '{c}' FROM x WHERE {w}" for lv, c, w in _TXT]
        + [f"SELECT doc_id, id, '{lv}', '{c}' FROM b WHERE {w}" for lv, c, w in _TBL]
        + [_dup("text_blocks", "DUPLICATE_TEXT_ID"), _dup("table_blocks", "DUPLICATE_TABLE_ID")]
        + ["SELECT doc_id, id, 'warning', 'ROW_LEN_MISMATCH' FROM (SELECT doc_id, id, len(columns) AS n, unnest(rows) AS r FROM table_blocks WHERE len(columns) > 0) WHERE len(r) <> n"]
    )
)
def validate_docs(spark, d):
    return validate(table(spark, d, "doc_metadata"), table(spark, d, "text_blocks"), table(spark, d, "table_blocks"))


@query("SELECT coalesce(source, 'total') AS source, count(*) AS n FROM chunks GROUP BY ROLLUP (source)")
def chunks_by_source(spark, d):
    return S.counts_with_total(table(spark, d, "chunks"), "source")


@query("SELECT doc_id, text FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, upper(text) FROM documents WHERE doc_id % 3 = 0")
def upsert_chunks(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return S.upsert(docs, docs.where("doc_id % 3 = 0").select("doc_id", F.upper("text").alias("text")), "doc_id")


@query("SELECT DISTINCT doc_id, page, 'text' AS kind FROM text_blocks WHERE page IS NOT NULL UNION ALL SELECT DISTINCT doc_id, page, 'table' FROM table_blocks t WHERE page IS NOT NULL AND NOT EXISTS (SELECT 1 FROM text_blocks b WHERE b.doc_id = t.doc_id AND b.page = t.page)")
def anti_page_merge(spark, d):
    pages = lambda name, kind: table(spark, d, name).where("page is not null").select("doc_id", "page").distinct().withColumn("kind", F.lit(kind))
    return S.merge_missing(pages("text_blocks", "text"), pages("table_blocks", "table"), "doc_id", "page")


@query("SELECT doc_id, count(*) AS n FROM text_blocks WHERE doc_id IN (SELECT doc_id FROM doc_metadata WHERE lower(trim(source)) = 'scanner') GROUP BY doc_id")
def semi_filter_docs(spark, d):
    keep = table(spark, d, "doc_metadata").where(F.lower(F.trim("source")) == "scanner").select("doc_id").distinct()
    return table(spark, d, "text_blocks").join(keep, "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT doc_id, file_name, source FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY left(ingested_at, 19) DESC, file_name DESC, source DESC) AS k FROM doc_metadata) WHERE k = 1")
def latest_metadata(spark, d):
    m = table(spark, d, "doc_metadata").select("doc_id", F.struct(F.substring("ingested_at", 1, 19).alias("at"), "file_name", "source").alias("x"))
    return m.groupBy("doc_id").agg(F.max("x").alias("x")).select("doc_id", "x.file_name", "x.source")


@query("SELECT doc_id, source FROM (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY CASE source WHEN 'table' THEN 0 ELSE 1 END) AS k FROM chunks) WHERE k = 1")
def preferred_variant(spark, d):
    c = table(spark, d, "chunks").select("doc_id", "source")
    return S.preferred(c, "doc_id", F.when(F.col("source") == "table", 0).otherwise(1))


@query("SELECT intent, query, answer, CAST(back AS INT) AS back FROM (SELECT coalesce(intent, 'none') AS intent, query, answer, row_number() OVER (PARTITION BY coalesce(intent, 'none') ORDER BY ts DESC, query DESC) AS back FROM (SELECT DISTINCT ts, query, answer, intent FROM qa_log)) WHERE back <= 5")
def history_tail(spark, d):
    qa = table(spark, d, "qa_log").select("ts", "query", "answer", F.coalesce("intent", F.lit("none")).alias("intent")).distinct()
    return S.history_tail(qa.withColumn("at", F.struct("ts", "query")), "intent", "at", 5).select("intent", "query", "answer", "back")


@query("SELECT id, doc_type, source, page, array_to_string(metadata.entities, ',') AS entities, array_to_string(metadata.intent, ',') AS intents FROM chunks")
def flat_metadata(spark, d):
    return table(spark, d, "chunks").select("id", "doc_type", "source", "page", X.flatten_list(F.col("metadata.entities")).alias("entities"), X.flatten_list(F.col("metadata.intent")).alias("intents"))


# The other modules register their queries when they are imported.
from folioforge.plans import accounts, answer, intake  # noqa: E402, F401

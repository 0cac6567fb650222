"""Scores of retrieved answers against golden questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.classify import grade
from folioforge.functions.text import escape_html
from folioforge.operators.telemetry import p95_distributed


def keyword_recall(answer: Column, keywords: Column) -> Column:
    """Share of the keywords that the answer contains, without case; 1 without keywords."""
    hits = F.size(F.filter(keywords, lambda k: F.contains(F.lower(F.coalesce(answer, F.lit(""))), F.lower(k))))
    return F.when(F.coalesce(F.size(keywords), F.lit(0)) <= 0, 1.0).otherwise(hits / F.size(keywords))


def doc_match(found: Column, expected: Column) -> Column:
    return F.coalesce(F.arrays_overlap(found, expected), F.lit(False)).cast("double")


def summary(results: DataFrame, by: str | None = None) -> DataFrame:
    """``results`` (recall, match, judge, latency) -> means over all questions, of judge and latency over the judged and
    timed ones, the latency at position floor(0.95 n), and the grade of the recall. No group is gathered."""
    key = by or "__all"
    rows = results if by else results.withColumn(key, F.lit(0))
    m = rows.groupBy(key).agg(
        F.count("*").alias("n"), F.round(F.avg("recall"), 3).alias("keyword_recall"), F.round(F.avg("match"), 3).alias("doc_match"),
        F.round(F.avg("judge"), 3).alias("judge"), F.round(F.avg("latency"), 2).alias("latency_avg"),
    )
    late = p95_distributed(rows, key, "latency").select(F.col(key).alias("__key"), F.round("p95", 2).alias("latency_p95"))
    out = m.join(late, F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key").withColumn("grade", grade(F.col("keyword_recall") * 100))
    return out if by else out.drop(key)


def report_html(results: DataFrame, head: str) -> DataFrame:
    """A line of HTML per question and, first, the report's head: ``line`` and ``html``, to be written as text in order."""
    cell = lambda c: F.concat(F.lit("<td>"), escape_html(F.coalesce(F.col(c).cast("string"), F.lit("-"))), F.lit("</td>"))
    rows = results.select(F.col("question").alias("line"), F.concat(F.lit("<tr>"), cell("question"), cell("recall"), cell("match"), F.lit("</tr>")).alias("html"))
    top = results.sparkSession.createDataFrame([("", f"<h1>{head}</h1>")], "line string, html string")
    return top.unionByName(rows).orderBy("line")

"""Keyed stores over Parquet: upsert, priority selection, semi and anti merges, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``old`` without the keys of ``new``, and one row of ``new`` for each of its keys (full copies are common, so which one
    does not matter; rows that differ are told apart by the caller)."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new.dropDuplicates([key]), allowMissingColumns=True)


def without(old: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    return old.join(gone.select(key).distinct(), key, "left_anti")


def preferred(candidates: DataFrame, key: str, priority: Column) -> DataFrame:
    """The candidates of the best priority of each key: a small aggregate joined back, no sort of the rows."""
    ranked = candidates.withColumn("__p", priority)
    best = ranked.groupBy(key).agg(F.min("__p").alias("__p"))
    return ranked.join(best, [key, "__p"], "left_semi").drop("__p")


def merge_missing(first: DataFrame, second: DataFrame, *keys: str) -> DataFrame:
    """``first`` and the rows of ``second`` whose keys it lacks."""
    return first.unionByName(second.join(first.select(*keys).distinct(), list(keys), "left_anti"))


def completeness(files: DataFrame) -> DataFrame:
    """``files`` (doc_id, name) -> whether a document's folder holds metadata and any text, table and image file."""
    has = lambda p: F.max(F.col("name").rlike(p).cast("int")) == 1
    flags = files.groupBy("doc_id").agg(has(r"^metadata\.json$").alias("m"), has(r"^text(_clean|_enriched)?\.json$").alias("t"), has(r"^table(_clean|_normalized)?\.json$").alias("b"), has(r"^image\.json$").alias("i"))
    return flags.select("doc_id", (F.col("m") & F.col("t") & F.col("b") & F.col("i")).alias("complete"))


def live_sessions(sessions: DataFrame, now: Column) -> DataFrame:
    return sessions.where(F.col("revoked_at").isNull() & (F.col("expires_at") >= now))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key by aggregation."""
    cols = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max(F.struct(order, *[c for c in cols if c != order])).alias("x")).select(key, *(F.col(f"x.{c}").alias(c) for c in cols))


def counts_with_total(rows: DataFrame, by: str) -> DataFrame:
    return rows.rollup(by).agg(F.count("*").alias("n")).select(F.coalesce(by, F.lit("total")).alias(by), "n")


def history_tail(turns: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The last ``n`` rows of each group, in order."""
    w = Window.partitionBy(by).orderBy(F.desc(order))
    return turns.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)

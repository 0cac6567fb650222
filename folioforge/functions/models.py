"""Boundaries to external models: pluggable callables with deterministic defaults.

A model is any function of a batch; it is loaded once a worker. Where it fails, the rows get the default."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import greedy_json, json_list

VERDICTS = ("yes", "partial", "no")


def scored(text: Column, load: Callable[[], Callable[[list[str]], list[float]]], default: float | None = None) -> Column:
    """A number per text by the model that ``load`` returns; ``default`` where it fails."""

    @F.pandas_udf("double")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = None
        for s in it:
            try:
                model = model or load()
                yield pd.Series(model([x or "" for x in s]), dtype="float64")
            except Exception:
                yield pd.Series([default] * len(s), dtype="float64")

    return run(text)


def embedded(text: Column, load: Callable[[], Callable[[list[str]], list[list[float]]]]) -> Column:
    """A unit vector per text; null where the model fails."""

    @F.pandas_udf("array<float>")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = None
        for s in it:
            try:
                model = model or load()
                out = []
                for v in model([x or "" for x in s]):
                    n = sum(x * x for x in v) ** 0.5
                    out.append([x / n for x in v] if n else v)
                yield pd.Series(out)
            except Exception:
                yield pd.Series([None] * len(s))

    return run(text)


def replied(prompt: Column, load: Callable[[], Callable[[list[str]], list[str]]], default: str | None = "") -> Column:
    """A text per prompt by the model that ``load`` returns (summary, caption, correction, paraphrase, plan, tag, judgement);
    ``default`` where it fails."""

    @F.pandas_udf("string")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = None
        for s in it:
            try:
                model = model or load()
                yield pd.Series(model([x or "" for x in s]), dtype=object)
            except Exception:
                yield pd.Series([default] * len(s), dtype=object)

    return run(prompt)


def paraphrases(reply: Column, most: int = 3) -> Column:
    """The list of strings in a reply, blank ones dropped, at most ``most``; none where it does not parse."""
    return F.slice(F.coalesce(F.filter(json_list(reply, "array<string>"), lambda x: F.trim(x) != ""), F.array().cast("array<string>")), 1, most)


def plan(reply: Column, most: int = 3) -> Column:
    """needs_planning and at most ``most`` subqueries of a planner's reply; no planning where it does not parse."""
    p = greedy_json(reply, "needs_planning boolean, subqueries array<string>")
    none = F.array().cast("array<string>")
    needed = F.coalesce(p["needs_planning"], F.lit(False)) & (F.size(F.coalesce(p["subqueries"], none)) > 0)
    return F.struct(needed.alias("needs_planning"), F.when(needed, F.slice(p["subqueries"], 1, most)).otherwise(none).alias("subqueries"))


def judged(reply: Column) -> Column:
    """A judge's score between 0 and 1; null where the reply holds none."""
    s = F.regexp_extract(reply, r'(?is)"?score"?\s*:\s*"?([0-9]+(?:\.[0-9]+)?)', 1).try_cast("double")
    return F.when(s.between(0, 1), s)


def tagged(first: Column, second: Column, rule: Column, allowed: tuple[str, ...]) -> Column:
    """The tag of the first model that gave an allowed one, else the rule's."""
    return F.coalesce(F.when(first.isin(*allowed), first), F.when(second.isin(*allowed), second), rule)


def reranked(docs: DataFrame, scored: Column, top: int) -> DataFrame:
    """The best ``top`` of each query by the model's score; a query without scores keeps its order (prev_rank)."""
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), "prev_rank")
    return docs.withColumn("rerank_score", scored).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def recognition(mode: str, key: bool) -> tuple[bool, bool]:
    """Whether a mode uses local recognition and the remote one: off, local, api, auto. ``api`` needs a key."""
    if mode == "api" and not key:
        raise ValueError("mode api needs a key")
    remote = mode == "api" or mode == "auto" and key
    return mode != "off" and not remote, remote


def messages(system: Column, history: Column, question: Column, last: int = 6) -> Column:
    """The messages of a prompt: the system's text, the last turns of the history (role, content), the question."""
    one = lambda role, c: F.array(F.struct(F.lit(role).alias("role"), c.alias("content")))
    kept = F.filter(F.coalesce(history, F.array().cast("array<struct<role:string,content:string>>")), lambda t: F.trim(F.coalesce(t["content"], F.lit(""))) != "")
    return F.concat(one("system", system), F.slice(kept, F.greatest(F.lit(1), F.size(kept) - last + 1), last), one("user", question))


def verdict(reply: Column) -> Column:
    """yes, partial or no from a grader's reply in prose or JSON; yes (fail open) for anything else."""
    word = F.lower(F.regexp_extract(reply, r'(?is)"?verdict"?\s*:\s*"?(yes|partial|no)\b', 1))
    bare = F.lower(F.regexp_extract(reply, r"(?is)^\s*(yes|partial|no)\b", 1))
    return F.coalesce(F.nullif(word, F.lit("")), F.nullif(bare, F.lit("")), F.lit("yes"))


def refused(answers: DataFrame, text: str) -> DataFrame:
    """``answers`` (verdict, answer): the refusal where the grader said no."""
    return answers.withColumn("answer", F.when(F.col("verdict") == "no", text).otherwise(F.col("answer")))


def labels(reply: Column, allowed: list[str]) -> Column:
    """Map of index to label from lines ``index: label``; other lines and labels are dropped."""
    lines = F.transform(F.split(reply, "\n"), lambda x: F.struct(F.regexp_extract(x, r"^\s*(\d+)\s*:", 1).try_cast("int").alias("i"), F.lower(F.trim(F.regexp_extract(x, r"^\s*\d+\s*:\s*(.*)$", 1))).alias("l")))
    good = F.filter(lines, lambda x: x["i"].isNotNull() & x["l"].isin(allowed))
    return F.map_from_entries(F.array_distinct(good))


def route(mode: Column, has_key: Column) -> Column:
    """Which engine serves a request: ``auto`` and a key-less ``api`` go to the local one."""
    return F.when((mode == "api") & has_key, "api").otherwise("local")


def page_strategy(boxes: Column, text_b: Column, text_a: Column, least: int = 3) -> Column:
    """Recognition strategy of a page: B by regions from ``least`` boxes on, A otherwise or where B read nothing."""
    b = (boxes >= least) & (F.trim(F.coalesce(text_b, F.lit(""))) != "")
    return F.when(b, "B").when(F.trim(F.coalesce(text_a, F.lit(""))) != "", "A").otherwise("fail")

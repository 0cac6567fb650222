"""Problem 8: mix sources to target shares of the tokens, by weighted fair queueing.

Every source's documents are shuffled (by a hash of id and copy number) and queued copy after copy; a document's virtual
finish time is the tokens of its source queued so far, itself included, divided by the source's share. Sorting all
sources by that time serves them in proportion to their shares; the mix is cut at a total budget. The default budget is
the largest one that no source exhausts: the least of max_repeats x tokens / share. A larger one that is asked for is cut to it,
with a warning, and the report names the budget kept.

The document with which a source would overrun its share is passed over for later ones that fit, of the same slice of the same
copy, so that no document is served before its turn by more than a slice.

Running sums are taken in two levels: the hash range is cut into slices of about SLICE documents; sums of slices are
accumulated over a table of one row a slice, then inside each slice. No source is ever gathered in one task.

Sources are compared without case and outer blanks. Sources without a target, or targets without documents, take no part;
the other shares are scaled to add up to one, and the report names all of them.

Defined results: documents of null or no tokens or of null source are not mixed; repeated rows are queued each; ties of
virtual time go by source, id and copy; an empty table gives an empty mix.
"""

from __future__ import annotations

import warnings

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.session import stage

SLICE = 20_000
HASHES = 2**62


def source_key(col: Column) -> Column:
    return F.lower(F.trim(col))


def _slices(rows: int) -> int:
    return max(1, -(-rows // SLICE))


def shares(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of ``docs`` (source, tokens) or of ``targets`` (source, target_share, max_repeats): its tokens, target,
    and share, null for sources that take no part."""
    have = docs.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"))
    want = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats")
    both = have.join(want, "source", "full").withColumn("in_mix", F.coalesce((F.col("tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0), F.lit(False)))
    total = F.sum(F.when(F.col("in_mix"), F.col("target_share"))).over(Window.partitionBy())  # one row a source
    return both.withColumn("share", F.when(F.col("in_mix"), F.col("target_share") / total))


def mix(docs: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """``docs`` (doc_id, source, tokens) -> (the mix: doc_id, source, copy, tokens, virtual_finish, in order of virtual
    time; the shares table with the budget)."""
    docs = stage(docs.where("tokens > 0 and doc_id is not null").select("doc_id", source_key(F.col("source")).alias("source"), F.col("tokens").cast("long").alias("tokens")).where("source is not null"))
    plan = stage(shares(docs, targets).withColumn("room", F.when(F.col("in_mix"), F.col("max_repeats") * F.col("tokens") / F.col("share"))))
    most = F.ceil(F.min("room").over(Window.partitionBy()))  # one row a source
    plan = plan.withColumn("budget", F.least(most, F.lit(budget)) if budget is not None else most)
    if budget is not None and (kept := plan.agg(F.max("budget")).first()[0]) is not None and kept < budget:
        warnings.warn(f"the budget of {budget} tokens is cut to {kept}: a source would be used more often than max_repeats", stacklevel=2)
    n = _slices(docs.count())
    # Only the copies that the budget can reach are queued.
    used = plan.where("in_mix").select("source", "share", "budget", F.least("max_repeats", F.ceil(F.col("budget") * F.col("share") / F.col("tokens"))).cast("int").alias("copies"))
    queued = docs.join(F.broadcast(used), "source").select("doc_id", "source", "tokens", "share", "budget", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    h = F.pmod(F.xxhash64("doc_id", "copy", F.lit(seed)), F.lit(HASHES))
    queued = queued.withColumn("h", h).withColumn("slice", F.floor(F.col("h") / F.lit(HASHES / n)).cast("int"))
    sums = queued.groupBy("source", "copy", "slice").agg(F.sum("tokens").alias("sum"))
    before = Window.partitionBy("source").orderBy("copy", "slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "copy", "slice", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "copy", "slice").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    served = queued.withColumn("inside", F.sum("tokens").over(inside)).join(sums, ["source", "copy", "slice"])
    finish = (F.col("before") + F.col("inside")) / F.col("share")
    # The tokens served by the time t are share x t a source, t in all: cutting at the budget is cutting at that time.
    served = stage(served.withColumn("virtual_finish", finish).select("doc_id", "source", "copy", "slice", "h", "tokens", "share", "budget", "virtual_finish"))
    cut = served.where("virtual_finish > budget").groupBy("source").agg(F.min(F.struct("copy", "slice")).alias("cut"))
    done = served.where("virtual_finish <= budget").groupBy("source").agg(F.sum("tokens").alias("served"))
    last = served.where("virtual_finish > budget").join(F.broadcast(cut), "source").where((F.col("copy") == F.col("cut.copy")) & (F.col("slice") == F.col("cut.slice"))).join(F.broadcast(done), "source", "left")
    out = ["doc_id", "source", "copy", "tokens", "virtual_finish"]
    filled = last.select(*out[:-1], "h", "share", "budget", F.coalesce("served", F.lit(0)).alias("served")).groupBy("source").applyInPandas(_fill, "doc_id bigint, source string, copy int, tokens bigint, virtual_finish double")
    mixed = served.where("virtual_finish <= budget").select(*out).unionByName(filled)
    return mixed.orderBy("virtual_finish", "source", "doc_id", "copy"), plan


def _fill(pdf: pd.DataFrame) -> pd.DataFrame:
    """The rest of a source's share from the slice of its queue in which the budget ends: documents that overrun it are
    passed over, later ones that still fit are served."""
    pdf = pdf.sort_values(["copy", "h", "doc_id"], kind="stable")
    share = float(pdf["share"].iloc[0])
    used, most = int(pdf["served"].iloc[0]), share * float(pdf["budget"].iloc[0])
    keep, time = [], []
    for i, t in enumerate(pdf["tokens"]):
        if used + t <= most:
            used += t
            keep.append(i)
            time.append(used / share)
    out = pdf.iloc[keep][["doc_id", "source", "copy", "tokens"]]
    return out.assign(virtual_finish=time)


def report(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source: target, tokens in the mix, the share reached, the most copies of one document."""
    got = mixed.groupBy("source").agg(F.sum("tokens").alias("mixed_tokens"), F.count("*").alias("mixed_documents"), F.max("copy").alias("most_copies"))
    rows = plan.select("source", "documents", "tokens", "target_share", "share", "max_repeats", "budget").join(got, "source", "left").fillna(0, ["mixed_tokens", "mixed_documents", "most_copies"])
    return rows.withColumn("actual_share", F.round(F.col("mixed_tokens") / F.sum("mixed_tokens").over(Window.partitionBy()), 6))

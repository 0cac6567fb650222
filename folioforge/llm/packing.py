"""Problem 7: fill containers of fixed capacity with items, by best-two-fit.

A bin is filled greedily, always with the largest item that fits; then its smallest item is taken out and replaced by the
two unpacked items that together fill the widened gap best, if they leave less unused space. Items larger than the
capacity, and only these, are divided: full containers and a remainder that is packed like an item.

Items are spread over packing groups of about GROUP items by a hash of their id, so a group's size does not grow with the
data and any source or bundle is spread over all groups. Unused space is lost once a group, in its last containers.

Defined results: items of null or no size are not packed; repeated rows are packed each on its own (``copy`` tells them
apart); ties go to the smaller id; an empty table packs into nothing.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP = 20_000
SCHEMA = "spec_id int, container_id string, capacity_tokens int, item_id bigint, copy int, piece_no int, piece_start int, tokens int"


def best_two_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices into ``sizes``, each size between 1 and ``capacity``."""
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in range(len(sizes) - 1, -1, -1):
        stacks[sizes[i]].append(i)
    left = np.array([len(s) for s in stacks])
    have = np.flatnonzero(left).tolist()  # sizes still unpacked, ascending

    def take(size: int) -> int:
        i = stacks[size].pop()
        left[size] -= 1
        if not stacks[size]:
            del have[bisect.bisect_left(have, size)]
        return i

    def give(i: int) -> None:
        size = sizes[i]
        if not stacks[size]:
            bisect.insort(have, size)
        stacks[size].append(i)
        left[size] += 1

    bins = []
    while have:
        gap, bin_ = capacity, []
        while gap and (k := bisect.bisect_right(have, gap)):
            size = have[k - 1]
            bin_.append(take(size))
            gap -= size
        if gap and len(have):
            smallest = bin_[-1]  # greedy filling takes sizes in descending order
            room, least = gap + sizes[smallest], sizes[smallest]
            arr = np.array(have[: bisect.bisect_right(have, room - 1)])
            if len(arr):
                # The best partner y <= room - x of each x; the same size needs two items.
                k = np.searchsorted(arr, room - arr, side="right") - 1
                k = np.where((k >= 0) & (arr[np.maximum(k, 0)] == arr) & (left[arr] < 2), k - 1, k)
                total = np.where(k >= 0, arr + arr[np.maximum(k, 0)], 0)
                j = int(total.argmax())
                if total[j] > least:
                    x, y = int(arr[j]), int(arr[k[j]])
                    bin_.pop()
                    bin_ += [take(x), take(y)]
                    give(smallest)
        bins.append(bin_)
    return bins


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["item_id", "copy"], kind="stable")
    spec, group, capacity = int(pdf["spec_id"].iloc[0]), int(pdf["group"].iloc[0]), int(pdf["capacity_tokens"].iloc[0])
    rows, parts = [], []  # parts: what is left to pack
    n = 0
    for item, copy, size in zip(pdf["item_id"], pdf["copy"], pdf["tokens"]):
        for piece in range(size // capacity if size > capacity else 0):
            rows.append((n, item, copy, piece + 1, piece * capacity, capacity))
            n += 1
        rest = size % capacity if size > capacity else size
        if rest:
            parts.append((item, copy, size // capacity + 1 if size > capacity else 1, size - rest, rest))
    for bin_ in best_two_fit([p[4] for p in parts], capacity):
        rows += [(n, *parts[i]) for i in bin_]
        n += 1
    out = pd.DataFrame(rows, columns=["n", "item_id", "copy", "piece_no", "piece_start", "tokens"])
    out["container_id"] = [f"{spec}-{group}-{k}" for k in out.pop("n")]
    return out.assign(spec_id=spec, capacity_tokens=capacity)[["spec_id", "container_id", "capacity_tokens", "item_id", "copy", "piece_no", "piece_start", "tokens"]]


def pack(items: DataFrame, specs: DataFrame, group: int = GROUP) -> DataFrame:
    """``items`` (item_id, tokens) and ``specs`` (spec_id, capacity_tokens; a parameter table of a few rows) -> one row per
    item (or piece of a divided one) and spec with its container."""
    items = items.where("tokens > 0 and item_id is not null").select("item_id", "tokens")
    groups = max(1, -(-items.count() // group))
    spread = items.select("item_id", "tokens", F.pmod(F.xxhash64("item_id"), F.lit(groups)).cast("int").alias("group"))
    numbered = (
        spread.groupBy("item_id", "tokens", "group").agg(F.count("*").alias("n"))
        .select("item_id", "tokens", "group", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    )
    # A text's repeated rows share a hash: further copies go on to the next groups.
    numbered = numbered.withColumn("group", F.pmod(F.col("group") + F.col("copy") - 1, F.lit(groups)).cast("int"))
    each = [F.struct(F.lit(s).cast("int").alias("spec_id"), F.lit(c).cast("int").alias("capacity_tokens")) for s, c in specs.select("spec_id", "capacity_tokens").where("capacity_tokens > 0").distinct().collect()]
    if not each:
        return items.sparkSession.createDataFrame([], SCHEMA)
    return numbered.withColumn("spec", F.explode(F.array(*each))).select("item_id", "tokens", "group", "copy", "spec.*").groupBy("spec_id", "group").applyInPandas(_pack, SCHEMA)


def unused(packed: DataFrame) -> DataFrame:
    """Per spec: containers, tokens, share of the space unused."""
    return packed.groupBy("spec_id", "capacity_tokens").agg(F.count_distinct("container_id").alias("containers"), F.sum("tokens").alias("tokens")).withColumn(
        "unused_share", F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6)
    )

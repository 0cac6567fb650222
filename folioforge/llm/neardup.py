"""Problem 1: groups of slightly altered copies, by tensored minhash banding.

Every record becomes a multiset of grams: runs of WORDS consecutive words of a text, or the non-empty cells of a table;
a gram's n-th occurrence is its own element, so multisets are compared as sets. Exact copies share a class and go on as
one node. A node has a collection U of BANDS bands of two minhashes and a collection V of SINGLES single minhashes; the
table keys are all pairs (U_i, V_j), so BANDS x SINGLES tables of three hashes cost 2 x BANDS + SINGLES of them. The keys
are formed where they divide something: a band U_i with one member has no copies, one with at most DIRECT members is
compared as a whole (more pairs than its keys would give, never fewer), only larger ones are divided by V: sixteen keys a
member move more bytes than the member's size and bits, and comparing two bit maps costs less than moving a pair.

The measure that decides is c = common elements / elements of the larger record. Two texts of equal size with c = t = 0.55
have the Jaccard value J = t / (2 - t) = 0.379; unequal sizes have a larger J. The keys miss such pairs with probability of
at most (1 - J^2)^BANDS + (1 - J)^SINGLES: 0.6 % of texts that just reach the threshold, less beyond.

Tables share status words and row numbers with any other table, and a copy may keep only these, so they have no minhashes:
their keys are their rarest elements (a prefix filter). Two records that reach the threshold share one of the size -
ceil(threshold x size) + 1 elements of each that come first in order of rarity, so no pair is lost.

Members of a key with at most DIRECT of them carry their sizes and bit maps (a bit an element) to it and are compared there:
pairs that these rule out are never moved, and none that reaches the threshold is ruled out. The others are verified on whole records, first
one link a node, then what these leave in different components: common / larger >= threshold, elements being 32-bit
fingerprints (two different elements of a pair of records of a hundred agree by chance in two of a million pairs, which
matters only where that one element decides). To link a hot bucket of more than DIRECT members without all its pairs, first
every member is compared with the bucket's smallest node; after the components of these links are known, only pairs of nodes
that are still in different components are compared. The nodes of such buckets of more than WIDE components are compared
where their rarest elements meet, and where many nodes share such an element, by the next common element too: the k-th rarest
that two such records have in common is among the first size - ceil(threshold x size) + k of both.

Defined results: records without any word or cell (null, empty) belong to no group; texts of fewer than WORDS words are
one run; repeated rows of an id count once; ids of different kinds are never compared; extra columns are ignored.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.components import components
from folioforge.llm.textnorm import canonical, needs
from folioforge.session import Scratch, stage

WORDS, BANDS, SINGLES, DIRECT, WIDE, LONGS = 3, 34, 16, 256, 32, 8
ASKED = 200_000  # candidates that are broadcast to pick their grams
SKETCH_SCHEMA = "kind string, id string, c1 bigint, c2 bigint, grams array<int>, bits array<bigint>, u array<int>, v array<int>"
_MARKS = re.compile(f"[{''.join(re.escape(chr(c)) for c in range(sys.maxunicode + 1) if c < 0x3400 and unicodedata.category(chr(c))[0] in 'PS')}‼️]+")
_HASHES = 2 * BANDS + SINGLES
_ODD = np.random.default_rng(20240901).integers(1, 2**63, _HASHES, dtype=np.uint64) | np.uint64(1)
_SALT = np.random.default_rng(20240902).integers(1, 2**63, _HASHES, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: str) -> list[str]:
    """Blank-separated words without case, marks and the differences of problem 4."""
    if needs(text):
        text = canonical(text)[0]
    return _MARKS.sub("", text.lower()).split()


def cells(text: str) -> list[str]:
    """The non-empty cells of a table whose cells are joined by U+001F."""
    if needs(text):
        text = canonical(text)[0]
    return [c for c in (" ".join(_MARKS.sub("", c).split()) for c in text.lower().split("\x1f")) if c]


def occurrences(h: np.ndarray, rec: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The elements of records: hashes ``h`` of records ``rec`` (ascending), numbered among equal ones of a record. With the
    hashes they come from and their records."""
    order = np.lexsort((h, rec))
    h, rec = h[order], rec[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (rec[1:] != rec[:-1])
    first = np.flatnonzero(new)
    nth = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    return _mix(h + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), h, rec


def runs(parts: list[list[str]], run: int) -> tuple[np.ndarray, np.ndarray]:
    """Elements (runs of words) of all texts one after another, and each text's number of elements."""
    n = np.array([len(p) for p in parts])
    if not n.sum():
        return np.empty(0, np.uint64), np.zeros(len(parts), np.int64)
    h = pd.util.hash_array(np.array([w for p in parts for w in p], dtype=object))
    starts = np.cumsum(n) - n
    m = np.where(n > 0, np.maximum(n - run + 1, 1), 0)
    rec = np.repeat(np.arange(len(n)), m)
    at = starts[rec] + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
    g = np.zeros(len(at), np.uint64)
    end = (starts + n)[rec]
    for k in range(run):
        ok = at + k < end
        g = _mix(g * np.uint64(31) + np.where(ok, h[np.minimum(at + k, len(h) - 1)], np.uint64(k + 1)) + np.uint64(k))
    return occurrences(g, rec)[0], m


def _minhashes(g: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """_HASHES samples a record, each the smallest hash of its elements."""
    out = np.empty((len(starts), _HASHES), np.uint64)
    for k, (salt, odd) in enumerate(zip(_SALT, _ODD)):
        x = (g ^ salt) * odd
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        out[:, k] = np.minimum.reduceat(x, starts)
    return out


def _int32(x: np.ndarray) -> np.ndarray:
    return (_mix(x) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _bits(g: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A bit per element of a record, LONGS words of 64."""
    at = ((g >> np.uint64(8)) % np.uint64(64 * LONGS)).astype(np.int64)
    out = np.zeros((len(m), LONGS), np.uint64)
    np.bitwise_or.at(out, (np.repeat(np.arange(len(m)), m), at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    return out.view(np.int64)


def _sketched(kind: str, ids: np.ndarray, g: np.ndarray, m: np.ndarray, banded: bool) -> pd.DataFrame:
    """Sketch rows of records with ``m`` elements each, all in ``g``; without minhashes unless ``banded``."""
    starts = np.cumsum(m) - m
    if banded:
        sig = _minhashes(g, starts)
        bands = sig[:, : 2 * BANDS].reshape(len(sig), BANDS, 2)
        u, v = list(_int32(_mix(bands[:, :, 0]) + bands[:, :, 1] * np.uint64(3))), list(_int32(sig[:, 2 * BANDS :]))
    else:
        u = v = [np.empty(0, np.int32)] * len(m)
    # Two independent sums of 64 bits, one with the size, identify the whole multiset.
    a, b = np.add.reduceat(_mix(g ^ np.uint64(11)), starts), _mix(np.add.reduceat(_mix(g ^ np.uint64(13)), starts) + m.astype(np.uint64))
    return pd.DataFrame(
        {
            "kind": kind,
            "id": ids,
            "c1": a.view(np.int64),
            "c2": b.view(np.int64),
            "grams": np.split((g >> np.uint64(32)).astype(np.uint32).view(np.int32), starts[1:]),
            "bits": list(_bits(g, m)),
            "u": u,
            "v": v,
        }
    )


def text_sketches(items: DataFrame, kind: str, run: int = WORDS) -> DataFrame:
    """Sketches of ``items`` (id, content)."""

    def work(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for i in range(0, len(pdf), 1000):
                part = pdf.iloc[i : i + 1000]
                g, m = runs([words(x) for x in part["content"]], run)
                if (m > 0).any():
                    yield _sketched(kind, part["id"].to_numpy()[m > 0], g, m[m > 0], True)

    return items.where(F.col("id").isNotNull() & F.col("content").isNotNull()).select("id", "content").mapInPandas(work, SKETCH_SCHEMA)


def table_sketches(items: DataFrame, kind: str) -> DataFrame:
    """Sketches of ``items`` (id, rows); tables have no minhashes."""
    flat = F.array_join(F.flatten(F.filter("rows", lambda r: r.isNotNull())), "\x1f")

    def work(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            parts = [cells(x) for x in pdf["value"]]
            m = np.array([len(p) for p in parts], np.int64)
            if m.sum():
                h = pd.util.hash_array(np.array([c for p in parts for c in p], dtype=object))
                yield _sketched(kind, pdf["id"].to_numpy()[m > 0], occurrences(h, np.repeat(np.arange(len(m)), m))[0], m[m > 0], False)

    return items.where(F.col("id").isNotNull() & F.col("rows").isNotNull()).select("id", flat.alias("value")).mapInPandas(work, SKETCH_SCHEMA)


def _least(kind: str, thresholds: dict[str, float]) -> Column:
    return F.coalesce(*(F.when(F.col(kind) == k, F.lit(t)) for k, t in thresholds.items()))


def _needed(thresholds: dict[str, float]) -> Column:
    """How many elements a record (kind, grams) has in common with a copy that is not larger."""
    return F.ceil(_least("kind", thresholds) * F.size("grams") - 1e-9).cast("int")


def _possible(pairs: DataFrame, nodes: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """The pairs (a, b) that their sizes and bits do not rule out: every bit that one record has and the other lacks stands
    for an element of the one that the other lacks."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("kind").alias(f"kind_{c}"), F.size("grams").alias(f"m_{c}"), F.col("bits").alias(f"bits_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.col("kind_a") == F.col("kind_b"))
    lacks = lambda x, y: sum((F.bit_count(F.col(f"bits_{x}")[k].bitwiseAND(F.bitwise_not(F.col(f"bits_{y}")[k]))) for k in range(LONGS)), F.lit(0))
    most = F.least(F.col("m_a") - lacks("a", "b"), F.col("m_b") - lacks("b", "a"))
    return both.where(most >= _least("kind_a", thresholds) * F.greatest("m_a", "m_b") - 1e-9).select("a", "b")


def _close(keys: DataFrame, nodes: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """The pairs (a, b), a < b, of nodes that meet under a key of ``keys`` (key, node) and that their sizes and bits do not
    rule out. Members carry these to the key, so no pair is moved that they rule out."""
    words = [F.col("bits")[k].alias(f"w{k}") for k in range(LONGS)]
    marks = nodes.select("node", F.size("grams").alias("m"), _needed(thresholds).alias("least"), *words)
    members = keys.select("key", "node").join(marks, "node")
    x = lambda c: F.col(f"x.{c}")
    y = lambda c: F.col(f"y.{c}")
    lacks = lambda p, q: sum((F.bit_count(p(f"w{k}").bitwiseAND(F.bitwise_not(q(f"w{k}")))) for k in range(LONGS)), F.lit(0))
    most = F.least(x("m") - lacks(x, y), y("m") - lacks(y, x))
    met = (x("key") == y("key")) & (x("node") < y("node")) & (most >= F.greatest(x("least"), y("least")))
    return members.alias("x").join(members.alias("y"), met).select(x("node").alias("a"), y("node").alias("b")).distinct()


def _verified(pairs: DataFrame, nodes: DataFrame, thresholds: dict[str, float], tmp: Scratch) -> DataFrame:
    """The pairs (a, b) whose common elements reach the threshold of their kind. Their grams are moved, so ``pairs`` (a stage)
    should hold only such that may reach it."""
    asked = tmp(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())
    few = asked.count() <= ASKED  # eight bytes a row; beyond, both sides are shuffled
    known = tmp(nodes.select("node", "kind", "grams").join(F.broadcast(asked) if few else asked, "node", "left_semi"))
    side = lambda c: known.select(F.col("node").alias(c), F.col("kind").alias(f"kind_{c}"), F.col("grams").alias(f"grams_{c}"))
    least = _least("kind_a", thresholds)
    larger = F.greatest(F.size("grams_a"), F.size("grams_b"))
    common = F.size(F.array_intersect("grams_a", "grams_b"))
    return tmp(pairs.join(side("a"), "a").join(side("b"), "b").where((F.col("kind_a") == F.col("kind_b")) & (common >= least * larger - 1e-9)).select("a", "b"))


def _shared(members: DataFrame) -> DataFrame:
    """``members`` with a key that a second member has, and how many have it (n). Keys are counted, combined before the
    shuffle, and the counts joined back, so that a key that a third of all nodes share is split over tasks."""
    counts = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")  # few of the keys: hashed, so the many need no sort
    return members.join(counts.hint("shuffle_hash"), "key")


def _buckets(nodes: DataFrame, thresholds: dict[str, float], tmp: Scratch) -> DataFrame:
    """key, node, n of the buckets with a second member."""
    band = nodes.select("node", F.posexplode("u").alias("i", "h"), "kind").select("node", F.xxhash64("kind", "i", "h").alias("key"))
    shared = tmp(_shared(band).select("key", "node", "n"))
    large = shared.where(F.col("n") > DIRECT).select("node", F.col("key").alias("band"))
    full = large.join(nodes.select("node", "v"), "node").select("node", "band", F.posexplode("v").alias("j", "h"))
    tables = _shared(full.select("node", F.xxhash64("band", "j", "h").alias("key")))
    rare = _shared(_first_keys(_ranked(nodes.where(F.size("u") == 0), thresholds)))
    kept = shared.where(F.col("n") <= DIRECT)
    for more in (tables, rare):
        kept = kept.unionByName(more.select("key", "node", "n"))
    return kept


def _ranked(nodes: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """node, kind, least, s: the elements (n, gram) of ``nodes`` (node, kind, grams) that other nodes have too, rarest first,
    and how many a copy must have in common. A node's own elements come before these in the order of rarity, so of any two
    copies the k-th rarest common element is among the first size(s) - least + k of both."""
    each = nodes.select("node", "kind", _needed(thresholds).alias("least"), F.explode(F.array_distinct("grams")).alias("gram"))
    counted = each.groupBy("kind", "gram").agg(F.count("*").alias("n")).where("n > 1").hint("shuffle_hash")
    return each.join(counted, ["kind", "gram"]).groupBy("node", "kind", "least").agg(F.sort_array(F.collect_list(F.struct(F.col("n").cast("int").alias("n"), "gram"))).alias("s"))


def _first_keys(ranked: DataFrame) -> DataFrame:
    """key, node, pos: one key for each element of a node that may be the rarest it has in common with a copy."""
    first = F.slice("s", F.lit(1), F.greatest(F.lit(0), F.size("s") - F.col("least") + 1))
    return ranked.select("node", "kind", F.posexplode(first).alias("pos", "x")).select(F.xxhash64("kind", "x.gram").alias("key"), "node", "pos")


def rare_cells(nodes: DataFrame, thresholds: dict[str, float], tmp: Scratch) -> DataFrame:
    """key, node, component: keys of the rarest elements of ``nodes`` (node, component, kind, grams), so many that any two
    nodes of a kind and of different components that reach its threshold have a key in common. The members of a key are
    divided by the next rarer common element, and so on, as long as that makes fewer rows than comparing them and leaves less
    than half of the pairs: elements that come together, as those of a stock sentence, divide nothing."""
    ranked = tmp(_ranked(nodes.select("node", "kind", "grams"), thresholds))
    known = tmp(nodes.select("node", "component"))
    level, keys, out = 1, tmp(_first_keys(ranked).join(known, "node")), None
    while True:
        several = keys.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"), F.min("pos").alias("pos")).where("lo <> hi")
        open_ = tmp(keys.join(several.select("key", "n", F.col("pos").alias("low")), "key"))
        tmp.drop(keys)
        parts = open_.where((F.col("n") > WIDE) & (F.col("low") >= 0)).select("key", "component").distinct().groupBy("key").agg(F.count("*").alias("parts")).where(F.col("parts") > WIDE)
        sized = ranked.select("node", "least", F.least(F.size("s"), F.size("s") - F.col("least") + level + 1).alias("end"))
        wide = open_.join(parts, "key").select("key", "node", "pos", "parts").join(sized, "node")
        divided = tmp(wide.groupBy("key").agg(F.max(F.col("end") - F.col("pos")).alias("fan"), F.max("parts").alias("parts")).where("parts > 2 * fan").select("key"))
        whole = open_.join(divided, "key", "left_anti").select("key", "node", "component")
        out = whole if out is None else out.unionByName(whole)
        if divided.isEmpty():
            return out
        # Where two nodes have all of their common elements in the key already, they meet under its end (pos -1).
        later = open_.join(divided, "key", "left_semi").join(ranked, "node")
        level += 1
        rest = F.transform(F.slice("s", F.col("pos") + 2, F.greatest(F.lit(0), F.size("s") - F.col("least") + level - F.col("pos") - 1)), lambda x, i: F.struct(F.xxhash64("key", x["gram"]).alias("key"), (F.col("pos") + 1 + i).alias("pos")))
        end = F.when(F.col("least") < level, F.array(F.struct(F.xxhash64("key", F.lit("end")).alias("key"), F.lit(-1).alias("pos"))))
        each = later.select(F.col("key").alias("parent"), "node", "component", F.explode(F.concat(rest, F.coalesce(end, F.array().cast("array<struct<key:bigint,pos:int>>")))).alias("x"))
        finer = tmp(each.select("parent", "x.key", "node", "x.pos", "component"))
        met = finer.select("parent", "key", "component").distinct().groupBy("parent", "key").agg(F.count("*").alias("n")).groupBy("parent").agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("met"))
        vain = tmp(met.join(parts.withColumnRenamed("key", "parent"), "parent").where("2 * met >= parts * (parts - 1)").select("parent"))
        out = out.unionByName(open_.join(vain.withColumnRenamed("parent", "key"), "key", "left_semi").select("key", "node", "component"))
        keys = tmp(finer.join(vain, "parent", "left_anti").drop("parent"))
        tmp.drop(finer)


def _met(hot: DataFrame, rows: DataFrame, comp: DataFrame, thresholds: dict[str, float], tmp: Scratch) -> DataFrame:
    """The pairs (a, b) of nodes in different components that the buckets ``hot`` (key, node) leave to be compared."""
    open_ = hot.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = open_.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    open_ = tmp(open_.join(several.select("key", "n"), "key"))
    wide = tmp(open_.where(F.col("n") > WIDE).select("key", "component").distinct().groupBy("key").agg(F.count("*").alias("parts")).where(F.col("parts") > WIDE).select("key"))
    narrow = open_.join(wide, "key", "left_anti").select("key", "node", "component")
    crowd = tmp(open_.join(wide, "key", "left_semi").select("node", "component").distinct().join(rows.select("node", "kind", "grams"), "node"))
    cell = tmp(narrow if wide.isEmpty() else narrow.unionByName(rare_cells(crowd, thresholds, tmp)))
    # Pairs of components first, then their members: members of one component never meet.
    parts = cell.select("key", "component").distinct()
    side = lambda t, c: t.select("key", F.col("component").alias(f"c{c}"), *([F.col("node").alias(c)] if "node" in t.columns else []))
    apart = side(parts, "a").join(side(parts, "b"), "key").where("ca < cb")
    met = apart.join(side(cell, "a"), ["key", "ca"]).join(side(cell, "b"), ["key", "cb"])
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def copy_groups(sketches: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """kind, id, group (smallest id of the group) and size for every record that has a copy under another id."""
    one = ["kind", "c1", "c2"]
    with Scratch() as tmp:
        rows = tmp(sketches.withColumn("node", F.monotonically_increasing_id()))  # the written numbers stay
        first = tmp(rows.groupBy(*one).agg(F.min(F.struct("id", "node")).alias("x"), F.max("id").alias("last"), F.count("*").alias("n")).select(*one, "x.*", "last", "n"))
        # Few rows are exact copies: these are taken out, so that all others stay where they are.
        again = tmp(rows.select(*one, "node").join(first.where("n > 1").select(*one, F.col("node").alias("kept")), one).where("node <> kept").select("node"))
        nodes = rows.join(again, "node", "left_anti")

        buckets = tmp(_buckets(nodes.select("node", "kind", "grams", "u", "v"), thresholds, tmp))
        close = tmp(_close(buckets.where(F.col("n") <= DIRECT), nodes, thresholds))
        hot = buckets.where(F.col("n") > DIRECT).select("key", "node")
        crowded = not hot.isEmpty()
        # One link a node first, so that the pairs of large groups need not be verified.
        links = close.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        if crowded:
            stars = hot.join(hot.groupBy("key").agg(F.min("node").alias("a")), "key").select("a", F.col("node").alias("b")).where("a <> b").distinct()
            links = links.unionByName(_possible(stars, rows, thresholds)).distinct()
        tried = tmp(links)
        links = _verified(tried, rows, thresholds, tmp)
        comp = components(links)

        # What is left: pairs of nodes in different components.
        part = lambda c: comp.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
        apart = close.join(part("a"), "a", "left").join(part("b"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
        more = tmp(apart.join(tried, ["a", "b"], "left_anti"))
        if crowded:
            met = _met(hot, rows, comp, thresholds, tmp).join(tried, ["a", "b"], "left_anti")
            more = tmp(more.unionByName(_possible(met, rows, thresholds)).distinct())
        links2 = _verified(more, rows, thresholds, tmp)
        if not links2.isEmpty():
            stars = comp.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
            comp = components(stars.unionByName(links2))

        rep = first.join(comp, "node", "left").where("component is not null or id <> last").select(*one, F.coalesce("component", "node").alias("component"))
        grouped = tmp(rows.select("id", *one).join(rep, one).select("kind", "id", "component").distinct())
        sizes = grouped.groupBy("component").agg(F.min("id").alias("group"), F.count("*").alias("size")).where("size > 1")
        return stage(grouped.join(sizes, "component").select("kind", "id", "group", "size"))


def copy_pairs(groups: DataFrame) -> DataFrame:
    """item_kind, id_a, id_b: every pair of a group. For small groups only: the rows are quadratic in a group's size."""
    a = groups.select("kind", "group", F.col("kind").alias("item_kind"), F.col("id").alias("id_a"))
    b = groups.select("kind", "group", F.col("id").alias("id_b"))
    return a.join(b, ["kind", "group"]).where("id_a < id_b").select("item_kind", "id_a", "id_b")

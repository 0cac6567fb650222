"""Problem 9: reading level by harmonic propagation over a document-word graph.

Nodes on one side are the English documents, on the other their words and, as further words, how long a sentence and its
words are. An edge weighs the word's share of the document. Graded documents are clamped to the mean of their raters
(plain 0, standard 1, demanding 2); word scores and document scores take turns as weighted means of their neighbours until
no word moves by more than TOLERANCE. The rounds are accelerated by Anderson's extrapolation over the last MEMORY of them,
which changes the way there, not the harmonic solution. A graph that does not settle in MOST_ROUNDS is an error.

Words are hashed to NODES nodes, so the vector of word scores that every task needs has a proven size (4 MB); an edge weighs
what its word weighs in the document, so rare words that share a node with another count for little. Document scores and
edges stay in the staged table and never reach the driver. Each task adds up its partition's sums before the shuffle.

The level thresholds are fitted to the scores of at most FIT graded documents (a bounded, documented sample) that were held
out: a second propagation, in the same passes over the graph, clamps only one half of the graded documents (by a hash of the
id), and the thresholds are those of the other half's scores in it.

Defined results: null, empty and non-English texts get no level; a document rated several times takes the mean; without
any rating no document gets a level; repeated rows get equal levels; a text is used whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.session import Scratch, stage

LEVELS = ("plain", "standard", "demanding")
NODES, MOST_ROUNDS, TOLERANCE, FIT = 2**20, 200, 1e-4, 20_000
SMOOTH, MEMORY, LEAST_HELD = 1e-3, 5, 30  # weight of the mean grade in every word; rounds to extrapolate from; held-out grades that thresholds need
#: Words that any English text uses (fixed values), against other languages in Latin letters.
COMMON = frozenset("the of and to a in is it that for on with as was be by this are or at from an have not will can each no you we if".split())
#: Endings of long English words (fixed values): texts in a heavy nominal style have few of the words above, but such words
#: throughout, which no other language's running text has.
_ENDING = re.compile(r"(?:[tsc]ion|ment|ness|[ai]lity|ity|ance|ence|ency|ship|ure|ous|[ai]ble|ive|ary|ory|al|ate|ated|i[sz]e|i[sz]ed|ing|ly|ies)s?$")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_WORD = re.compile(r"[a-z]+(?:[-'’][a-z]+)*")
GRAPH = "doc_id bigint, grade double, nodes array<int>, weights array<float>"


def features(text: str) -> Counter:
    """Words of the text and the structure of its sentences, by how many words each covers."""
    out: Counter = Counter()
    for sentence in _SENTENCE.split(text.lower()):
        w = _WORD.findall(sentence)
        if not w:
            continue
        out.update(w)
        n, size = len(w), sum(map(len, w))
        out[f"#length {min(n // 4, 12)}"] += n
        out[f"#letters {min(int(size / n * 1.5), 14)}"] += n
        out[f"#long {min(int(sum(len(x) >= 12 for x in w) / n * 8), 8)}"] += n
    return out


def is_english(text: str, counts: Counter) -> bool:
    latin = sum(len(w) * n for w, n in counts.items() if w[0] != "#")
    letters = sum(map(str.isalpha, text)) if not text.isascii() else latin
    total = sum(n for w, n in counts.items() if w[0] != "#")
    if total == 0 or 2 * latin < letters:
        return False
    return 50 * sum(counts[w] for w in COMMON) >= total or 2 * sum(n for w, n in counts.items() if len(w) >= 7 and w[0] != "#" and _ENDING.search(w)) >= total


def _graph(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    ids: dict[str, int] = {}
    for pdf in it:
        rows = []
        for doc, text, grade in zip(pdf["doc_id"], pdf["text"], pdf["grade"]):
            c = features(text)
            if not is_english(text, c):
                continue
            merged: dict[int, int] = {}
            for w, n in c.items():
                if (k := ids.get(w)) is None:
                    if len(ids) > 500_000:
                        ids.clear()
                    k = ids[w] = crc32(w.encode()) % NODES
                merged[k] = merged.get(k, 0) + n
            total = sum(merged.values())
            rows.append((doc, grade, np.fromiter(merged, np.int32), np.fromiter(merged.values(), np.float32) / total))
        yield pd.DataFrame(rows, columns=["doc_id", "grade", "nodes", "weights"])


def graph(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The graph: a row per English document with its grade (null if ungraded), nodes and edge weights."""
    value = F.coalesce(*(F.when(F.lower(F.trim("level")) == x, F.lit(float(k))) for k, x in enumerate(LEVELS)))
    graded = labels.select("doc_id", value.alias("grade")).groupBy("doc_id").agg(F.avg("grade").alias("grade"))
    rows = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text").join(graded, "doc_id", "left")
    return rows.mapInPandas(_graph, GRAPH)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    nodes, weights = batch.column("nodes"), batch.column("weights")
    at = nodes.offsets.to_numpy()
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    return nodes.flatten().to_numpy(), weights.flatten().to_numpy().astype(float), row, batch.column("grade").to_numpy(zero_copy_only=False).astype(float)


def _document_scores(batch: pa.RecordBatch, scores: np.ndarray) -> tuple[np.ndarray, ...]:
    """Edges (node, weight, row), grades, and each document's score under each row of ``scores``."""
    k, w, row, grade = _flat(batch)
    n = len(grade)
    total = np.maximum(np.bincount(row, w, n), 1e-12)
    return k, w, row, grade, [np.bincount(row, w * s[k], n) / total for s in scores]


def _held_out(ids: np.ndarray) -> np.ndarray:
    """The half of the documents whose grades the second propagation does not see."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(40)) % np.uint64(2) == 1


def _half_step(g: DataFrame, scores: np.ndarray, prior: float) -> np.ndarray:
    """New word scores of both propagations from the documents' scores under ``scores``, graded documents clamped."""

    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, bottom = np.zeros((2, NODES)), np.zeros(NODES)
        for b in it:
            if b.num_rows:
                k, w, row, grade, s = _document_scores(b, scores)
                known = ~np.isnan(grade)
                held = _held_out(b.column("doc_id").to_numpy())
                for i, seen in enumerate((known, known & ~held)):
                    top[i] += np.bincount(k, w * np.where(seen, grade, s[i])[row], NODES)
                bottom += np.bincount(k, w, NODES)
        some = np.flatnonzero(bottom)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(top[0][some]), pa.array(top[1][some]), pa.array(bottom[some])], ["node", "top", "half", "bottom"])

    sum_ = [F.sum(c).alias(c) for c in ("top", "half", "bottom")]
    table = g.select("doc_id", "grade", "nodes", "weights").mapInArrow(sums, "node int, top double, half double, bottom double").groupBy("node").agg(*sum_).toArrow()
    new = np.full((2, NODES), prior, np.float32)
    k, bottom = table["node"].to_numpy(), table["bottom"].to_numpy()
    for i, c in enumerate(("top", "half")):
        new[i, k] = (table[c].to_numpy() + SMOOTH * prior) / (bottom + SMOOTH)
    return new


def extrapolated(past: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Anderson's next point from the last points and steps (kept in ``past``), the present point and where its step leads."""
    past.append((x.astype(float), new.astype(float) - x))
    del past[: -MEMORY - 1]
    if len(past) == 1:
        return new
    dx = np.stack([b[0] - a[0] for a, b in zip(past, past[1:])], 1)
    df = np.stack([b[1] - a[1] for a, b in zip(past, past[1:])], 1)
    gamma = np.linalg.lstsq(df.T @ df + 1e-12 * np.eye(df.shape[1]), df.T @ past[-1][1], rcond=None)[0]
    return (past[-1][0] + past[-1][1] - (dx + df) @ gamma).astype(np.float32)


def thresholds(scores: np.ndarray, grades: np.ndarray) -> list[float]:
    """Per upper level the score from which it holds: the best F1 on the graded documents, in the middle of the widest
    stretch of scores that gives it."""
    out = []
    order = np.argsort(scores, kind="stable")
    s, g = scores[order], grades[order]
    for level in range(1, len(LEVELS)):
        true = g > level - 0.5
        if not true.any() or true.all():
            out.append(float("inf") if not true.any() else float("-inf"))
            continue
        hits = np.cumsum(true[::-1])[::-1]  # threshold just below s[i]
        f1 = 2 * hits / (np.arange(len(s), 0, -1) + true.sum())
        best = np.flatnonzero(f1 >= f1.max() - 1e-12)
        below = np.where(best > 0, s[np.maximum(best - 1, 0)], s[best])
        i = int((s[best] - below).argmax())
        out.append(float((s[best][i] + below[i]) / 2))
    return out


def reading_levels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, difficulty (the propagated score), level of every English document of ``docs`` (doc_id, text)."""
    with Scratch() as tmp:
        return _levels(tmp(graph(docs, labels)))


def _levels(g: DataFrame) -> DataFrame:
    prior = g.agg(F.avg("grade")).first()[0]
    if prior is None:
        return stage(g.select("doc_id", F.lit(None).cast("double").alias("difficulty"), F.lit(None).cast("string").alias("level")))
    scores = np.full((2, NODES), prior, np.float32)
    past: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
    for _ in range(MOST_ROUNDS):
        new = _half_step(g, scores, prior)
        moved = float(np.abs(new - scores).max())
        if moved < TOLERANCE:
            scores = new
            break
        scores = np.stack([extrapolated(p, x, y) for p, x, y in zip(past, scores, new)])
    else:
        raise RuntimeError(f"reading levels did not settle: a word still moved by {moved:.5f}")

    def final(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                s = _document_scores(b, scores)[-1]
                apart = _held_out(b.column("doc_id").to_numpy())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("grade"), pa.array(s[0]), pa.array(s[1]), pa.array(apart)], ["doc_id", "grade", "difficulty", "half", "apart"])

    scored = stage(g.mapInArrow(final, "doc_id bigint, grade double, difficulty double, half double, apart boolean"))
    graded = scored.where("grade is not null")
    fit = graded.where("apart").orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT).toPandas()
    if len(fit) < LEAST_HELD:  # a handful of grades: their own scores are all there is
        fit = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT).toPandas().assign(half=lambda x: x["difficulty"])
    else:
        # Half the grades pull less: the scores of both propagations are brought to one scale by all documents' moments.
        m = scored.agg(*(f(c).alias(f"{c}_{f.__name__}") for c in ("difficulty", "half") for f in (F.avg, F.stddev_pop))).first()
        fit["half"] = (fit["half"] - m["half_avg"]) * (m["difficulty_stddev_pop"] / max(m["half_stddev_pop"], 1e-12)) + m["difficulty_avg"]
    cuts = thresholds(fit["half"].to_numpy(), fit["grade"].to_numpy())
    level = F.when(F.col("difficulty") >= cuts[1], LEVELS[2]).when(F.col("difficulty") >= cuts[0], LEVELS[1]).otherwise(LEVELS[0])
    return scored.select("doc_id", "difficulty", level.alias("level"))

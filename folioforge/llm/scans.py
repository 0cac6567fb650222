"""Problem 5: noise of scanned pages, repaired into continuous paragraphs.

1. One pass over the blocks (Python, Arrow batches) takes from each block its outer lines as layout observations (a
   fingerprint that misread characters do not change, and a printed number if there is one), the words cut at line ends,
   and the partition's word counts.
2. The outer lines of each page, read inwards, are labelled header, numbered header, page number or body by a hidden
   Markov model. A line's observation is whether its fingerprint, with or without its number, stands at that edge on at
   least MIN_PAGES of the document's pages and whether its number keeps the document's distance to the page. The model is trained by expectation maximisation over the
   counts of all observation sequences (a table of at most 2 x 64 rows), started from documented probabilities; a
   sequence's best labelling (Viterbi) is looked up in that table. Running lines stand at the edges, so lines further in
   are never headers; nor are lines of more than 200 characters.
3. Misread words are words that clean files do not have and that fall together with a known word once the confusions of
   recognition are merged. A cut word is told from a word with its own hyphen by which of the two the corpus knows.

4. For the repaired text the lines that are left are labelled body or break (a paragraph ends with the line) by a second
   hidden Markov model over length, full stop and what the next line begins with, trained alike over the counts of
   neighbouring lines' observations. Paragraphs end at breaks and at the end of a block.

The word table is distributed; the table of misread words, if it has at most MISREADS rows, is sent to the tasks for the
second pass, otherwise words are joined to it; both ways look up the same words. Words of one or two letters are never misread.

Defined results: null or empty content has no defects; blocks without a page take no part in step 2; a file none of whose
blocks names an extractor counts as scanned; repeated rows count once; very long texts are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.textnorm import canonical, needs
from folioforge.session import stage

MISREADS = 300_000
MIN_PAGES = 3
PASS = (
    "t string, id string, doc_id string, page int, native boolean, line_nos array<int>, keys array<bigint>, wholes array<bigint>, nums array<int>, pure array<boolean>, "
    "a string, b string, c string, n bigint, clean bigint"
)
# Characters that recognition confuses, each as the strokes it is read as (fixed values).
_STROKES = str.maketrans({"1": "l", "i": "l", "|": "l", "!": "l", "0": "o", "a": "o", "5": "s", "t": "f", "b": "h", "e": "c", "q": "g", "9": "g", "u": "ll", "d": "cl", "n": "rl", "m": "rrl", "w": "vv"})
_ROMAN = re.compile(r"m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})")
_VALUE = dict(zip("ivxlcdm", (1, 5, 10, 50, 100, 500, 1000)))
_NUM = r"(?:[0-9]{1,6}|[๐-๙]{1,6}|[ivxlcdm]{1,9}|[IVXLCDM]{1,9})"
_WORD_PAGE = r"(?:[Pp](?:[ao][gq9][ec]|[Aa][Gg][Ee]|\.|g\.?)|PAGE|หน้าที่|หน้า)"
_PURE = re.compile(rf"[\W_]*(?:{_WORD_PAGE}\s*)?({_NUM})(?:\s*(?:of|/|จาก|OF)\s*[0-9๐-๙]+)?[\W_]*")
_BESIDE = re.compile(rf"(?:(?:{_WORD_PAGE}\s*)?({_NUM})(?:\s*[|·•–—/-]\s*|\s{{2,}})(\S.*\S)|(\S.*\S)(?:\s*[|·•–—/-]\s*|\s{{2,}})(?:{_WORD_PAGE}\s*)?({_NUM}))")
_BETWEEN = re.compile(r"[|·•–—/-]|\s\s")
_NO_WORD = re.compile(r"[\W_]+")
_CUT = re.compile(r"([A-Za-z][A-Za-z'’]*|[A-Za-z0-9]*[A-Za-z][A-Za-z0-9]*)([-¬])[ ]*$")
_FIRST = re.compile(r"\s*([A-Za-z0-9]*[A-Za-z][A-Za-z0-9]*)")
_TOKEN = re.compile(r"(?<![\w@.\-/])[A-Za-z0-9|!]+(?:-[A-Za-z0-9|!]+)*(?![\w@/]|\.\w)")


def skeleton(word: str) -> str:
    """What is left of a lower-case text when the confusions of recognition are merged."""
    return word.translate(_STROKES)


def number(text: str) -> int:
    """The value of an Arabic, Thai or Roman number; 0 if it is none."""
    if text.isdigit():
        return int(text)
    low = text.lower()
    if not low or not _ROMAN.fullmatch(low):
        return 0
    values = [_VALUE[c] for c in low]
    return sum(-v if k + 1 < len(values) and v < values[k + 1] else v for k, v in enumerate(values))


def observed(line: str) -> tuple[int, int, bool]:
    """Fingerprint of an outer line without its number, its printed number (0: none), whether it is only a number."""
    line = line.strip()
    if not line or len(line) > 200:
        return 0, 0, False
    if len(line) <= 32 and (m := _PURE.fullmatch(line)):
        if v := number(m.group(1)):
            return 0, v, True
    v = 0
    if _BETWEEN.search(line) and (m := _BESIDE.fullmatch(line)):
        v = number(m.group(1) or m.group(4))
        if v:
            line = m.group(2) or m.group(3)
    return fingerprint(line), v, False


def fingerprint(line: str) -> int:
    """Of a whole line, its number included; 0 for a line too short to tell."""
    key = skeleton(_NO_WORD.sub("", line.lower()))
    return hash_text(key) if len(key) >= 4 else 0


def hash_text(s: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(s) - 2**63


def plain(text: str) -> str:
    return canonical(text)[0] if needs(text) else text


def lines_and_cuts(text: str) -> tuple[list[str], list[tuple[int, str, str, str, str]]]:
    """The lines, and the words cut at their ends: line number from 0, left part, mark, beginnings of the next two lines."""
    lines = text.split("\n")
    cuts = []
    if "-" in text or "¬" in text:
        for k in range(len(lines) - 1):
            if lines[k].rstrip(" ")[-1:] in ("-", "¬") and (m := _CUT.search(lines[k])):
                b = _FIRST.match(lines[k + 1])
                c = _FIRST.match(lines[k + 2]) if k + 2 < len(lines) else None
                if b or c:
                    cuts.append((k, m.group(1), m.group(2), b.group(1) if b else "", c.group(1) if c else ""))
    return lines, cuts


def without_cuts(lines: list[str], cuts: list[tuple[int, str, str, str, str]]) -> list[str]:
    """The lines without the parts of cut words, whose joined form is not guessed here."""
    if not cuts:
        return lines
    out, left = list(lines), {k for k, *_ in cuts}
    for k in left:
        out[k] = _CUT.sub("", out[k])
    for k in left:
        out[k + 1] = _FIRST.sub("", out[k + 1], count=1)
    return out


def words_in(run: str) -> list[str]:
    """The lower-case words of a run of characters between blanks."""
    return [w.lower() for w in _TOKEN.findall(run)]


def words_of(lines: list[str], cuts: list[tuple[int, str, str, str, str]]) -> Iterator[tuple[int, str]]:
    """Line number and word."""
    for k, line in enumerate(without_cuts(lines, cuts)):
        for run in line.split():
            for w in words_in(run):
                yield k, w


def _first_pass(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in PASS.split(", ")]
    counts: Counter = Counter()
    clean: Counter = Counter()
    cache: dict[str, tuple] = {}
    for pdf in it:
        blocks, events = [], []
        for id_, doc, page, native, text in zip(pdf["id"], pdf["doc_id"], pdf["page"], pdf["native"], pdf["content"]):
            text = plain(text)
            lines, cuts = lines_and_cuts(text)
            (clean if native else counts).update(" ".join(without_cuts(lines, cuts)).split() if cuts else text.split())
            for k, a, mark, b, c in cuts:
                events.append((id_, doc, k, a.lower(), b.lower(), c.lower(), mark))
            n = len(lines)
            at = [0, 1 if n > 1 else -1, n - 2 if n > 1 else -1, n - 1]
            seen = []
            for k in at:
                if k < 0:
                    seen.append((0, 0, False, 0))
                    continue
                if (o := cache.get(lines[k])) is None:
                    if len(cache) > 50_000:
                        cache.clear()
                    key, num, pure = observed(lines[k])
                    # A number beside text may belong to it (AR-7524): such a line also goes by its whole fingerprint.
                    o = cache[lines[k]] = key, num, pure, fingerprint(lines[k]) if num and not pure else key
                seen.append(o)
            blocks.append((id_, doc, page, native, at, [o[0] for o in seen], [o[3] for o in seen], [o[1] for o in seen], [o[2] for o in seen]))
        yield pd.DataFrame(blocks, columns=columns[1:10]).assign(t="block", a=None, b=None, c=None, n=None, clean=None)[columns]
        if events:
            e = pd.DataFrame(events, columns=["id", "doc_id", "n", "a", "b", "c", "mark"])
            e["line_nos"] = [[k] for k in e["n"]]
            e["pure"] = [[m == "¬"] for m in e.pop("mark")]
            yield e.assign(t="cut", page=None, native=None, keys=None, wholes=None, nums=None, clean=None)[columns]
        if len(counts) + len(clean) > 300_000:
            yield _counted(counts, clean, columns)
            counts, clean = Counter(), Counter()
    yield _counted(counts, clean, columns)


def _counted(raw: Counter, raw_clean: Counter, columns: list[str]) -> pd.DataFrame:
    """Word counts from the counts of runs between blanks, each of which is taken apart once."""
    counts, clean = Counter(), Counter()
    for runs, into in ((raw, counts), (raw_clean, clean)):
        for run, n in runs.items():
            for w in words_in(run):
                into[w] += n
    w = list(counts.keys() | clean.keys())
    out = pd.DataFrame({"t": "word", "a": w, "b": [skeleton(x) for x in w], "n": [counts[x] + clean[x] for x in w], "clean": [clean[x] for x in w]})
    return out.reindex(columns=columns).astype(object).where(lambda x: x.notna(), None)


# Hidden Markov model of a page's outer lines, read inwards.
STATES = ("header", "numbered_header", "page_number", "body")
# Observation codes: recurrence 0 none, 2 on MIN_PAGES pages, 1 on MIN_PAGES but behind a lone number, on few of the
# document's pages and at the edges of other documents too (See overleaf, Total);
# number 0 none, 1 a lone number at no constant distance, 2 a lone number at the constant distance, 3 beside text at it.
RECUR, NUMBER = 3, 4
CODES = RECUR * NUMBER
_START = np.array([0.3, 0.05, 0.15, 0.5])
_NEXT = np.array([[0.02, 0.005, 0.275, 0.7], [0.02, 0.005, 0.005, 0.97], [0.3, 0.02, 0.01, 0.67], [0.001, 0.001, 0.004, 0.994]])


def _emissions() -> np.ndarray:
    e = np.full((len(STATES), CODES), 1e-4)
    at = lambda r, n: r * NUMBER + n
    e[0, at(2, 0)], e[0, at(1, 0)], e[0, at(2, 3)] = 0.97, 0.01, 0.01
    e[1, at(2, 3)], e[1, at(1, 3)], e[1, at(0, 3)] = 0.97, 0.02, 0.005
    e[2, at(0, 2)], e[2, at(0, 1)], e[2, at(0, 3)] = 0.94, 0.005, 0.05
    e[3, at(0, 0)], e[3, at(1, 0)], e[3, at(0, 1)], e[3, at(0, 3)], e[3, at(2, 0)] = 0.93, 0.04, 0.02, 0.005, 0.005
    return e / e.sum(axis=1, keepdims=True)


def train(sequences: list[tuple[int, int, int]], rounds: int = 20, trust: float = 200.0) -> dict[tuple[int, int], tuple[int, int]]:
    """From (first code, second code, count) the best states of every code pair. The second code may be -1 (no line).
    ``trust`` is how many observations the starting probabilities weigh."""
    start, step, emit = _START.copy(), _NEXT.copy(), _emissions()
    s0, t0, e0 = start.copy(), step.copy(), emit.copy()
    for _ in range(rounds):
        ns, nt, ne = s0 * trust, t0 * trust, e0 * trust
        for a, b, n in sequences:
            p = start * emit[:, a]
            if b < 0:
                g = p / p.sum()
                ns = ns + n * g
                ne[:, a] += n * g
                continue
            joint = p[:, None] * step * emit[:, b][None, :]
            joint /= joint.sum()
            ns = ns + n * joint.sum(1)
            nt = nt + n * joint
            ne[:, a] += n * joint.sum(1)
            ne[:, b] += n * joint.sum(0)
        new = ns / ns.sum(), nt / nt.sum(1, keepdims=True), ne / ne.sum(1, keepdims=True)
        moved = max(float(np.abs(x - y).max()) for x, y in zip(new, (start, step, emit)))
        start, step, emit = new
        if moved < 1e-6:
            break
    best = {}
    for a, b, _n in sequences:
        p = start * emit[:, a]
        if b < 0:
            best[a, b] = int(p.argmax()), -1
        else:
            i, j = np.unravel_index(int((p[:, None] * step * emit[:, b][None, :]).argmax()), (4, 4))
            best[a, b] = int(i), int(j)
    return best


def _outer_lines(blocks: DataFrame, files: DataFrame, min_share: float) -> DataFrame:
    """id, line_no (from 0), state of the labelled outer lines of pages of scanned files."""
    b = blocks.where("page is not null").join(files.where("scanned").select("doc_id"), "doc_id", "left_semi").select("id", "doc_id", "page", "line_nos", "keys", "wholes", "nums", "pure")
    ends = b.groupBy("doc_id", "page").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    both = b.join(ends, ["doc_id", "page"]).where("id = first or id = last").dropDuplicates(["id", "page"])

    def side(edge: str, outer: int, inner: int) -> DataFrame:
        part = lambda k: F.struct(*(F.element_at(c, k + 1).alias(a) for c, a in (("line_nos", "line_no"), ("keys", "key"), ("wholes", "whole"), ("nums", "num"), ("pure", "pure"))))
        return both.where("id = first" if edge == "top" else "id = last").select("id", "doc_id", "page", F.lit(edge).alias("edge"), part(outer).alias("o"), part(inner).alias("i"))

    e = stage(side("top", 0, 1).unionByName(side("bottom", 3, 2)))
    one = e.select("doc_id", "page", "edge", "o.*").unionByName(e.select("doc_id", "page", "edge", "i.*"))
    # Inner lines recur as running lines only behind a lone number; else a stock line under the header would count.
    pages = ends.groupBy("doc_id").agg(F.count("*").alias("pages"))
    both_keys = lambda t, p: t.select("doc_id", "page", "edge", F.explode(F.array(f"{p}.key", f"{p}.whole")).alias("key"))
    running = both_keys(e, "o").unionByName(both_keys(e.where("o.pure"), "i"))
    recur = running.where("key <> 0").select("doc_id", "edge", "key", "page").distinct().groupBy("doc_id", "edge", "key").agg(F.count("*").alias("on"))
    docs = recur.groupBy("edge", "key").agg(F.count("*").alias("docs"), F.max("on").alias("most")).where(F.col("most") >= MIN_PAGES)
    own = (F.col("docs") == 1) | (F.col("on") >= min_share * F.col("pages"))
    recur = stage(recur.where(F.col("on") >= MIN_PAGES).join(docs, ["edge", "key"]).join(pages, "doc_id").select("doc_id", "edge", "key", F.lit(2).alias("o"), F.when(own, 2).otherwise(1).alias("i")))
    shift = one.where("num > 0").select("doc_id", (F.col("num") - F.col("page")).alias("shift"), "page").distinct().groupBy("doc_id", "shift").agg(F.count("*").alias("on"))
    best = shift.groupBy("doc_id").agg(F.max(F.struct("on", (-F.abs("shift")).alias("near"), "shift")).alias("x"), F.sum("on").alias("all"))
    best = best.where("x.on >= 2 and x.on >= 0.3 * all").select("doc_id", F.col("x.shift").alias("shift"))
    r = lambda p: recur.select("doc_id", "edge", F.col("key").alias(f"{p}_key"), F.col(p[0]).alias(f"{p}_recur"))
    e = e.select("*", *(F.col(f"{p}.{k}").alias(f"{p}_{k}_key") for p in ("o", "i") for k in ("key", "whole")))
    for p in ("o_key", "o_whole", "i_key", "i_whole"):
        e = e.join(r(p), ["doc_id", "edge", f"{p}_key"], "left")
    e = e.join(best, "doc_id", "left")

    def code(p: str):
        num, fits = F.col(f"{p}.num"), F.coalesce(F.col(f"{p}.num") - F.col("page") == F.col("shift"), F.lit(False))
        kind = F.when(num == 0, 0).when(F.col(f"{p}.pure"), F.when(fits, 2).otherwise(1)).otherwise(F.when(fits, 3).otherwise(0))
        return F.when(F.col(f"{p}.line_no") < 0, -1).otherwise(F.coalesce(F.greatest(f"{p}_key_recur", f"{p}_whole_recur"), F.lit(0)) * NUMBER + kind)

    e = stage(e.select("id", F.col("o.line_no").alias("o_line"), F.col("i.line_no").alias("i_line"), code("o").alias("o_code"), code("i").alias("i_code")))
    seen = e.groupBy("o_code", "i_code").agg(F.count("*").alias("n")).collect()  # at most CODES * (CODES + 1) rows
    states = train([(x.o_code, x.i_code, x.n) for x in seen if x.o_code >= 0])
    if not states:
        return e.select("id", F.col("o_line").alias("line_no"), F.lit("body").alias("state")).where("false")
    spark = blocks.sparkSession
    table = spark.createDataFrame([(a, b, STATES[s], STATES[t] if t >= 0 else None) for (a, b), (s, t) in states.items()], "o_code int, i_code int, o_state string, i_state string")
    e = e.join(F.broadcast(table), ["o_code", "i_code"])
    out = e.select("id", F.col("o_line").alias("line_no"), F.col("o_state").alias("state")).unionByName(e.where("i_state is not null").select("id", "i_line", "i_state").toDF("id", "line_no", "state"))
    return out.where("state <> 'body'").distinct()


def _misread_words(words: DataFrame) -> DataFrame:
    """word, fixed: words that clean files (almost) never have, and the known word of the same skeleton."""
    words = words.where(F.length("a") >= 3)
    top = words.groupBy("b").agg(F.max(F.struct("clean", "n", "a")).alias("top"), F.count("*").alias("forms")).where("forms > 1")
    return (
        words.join(top.select("b", "top"), "b")
        .where((F.col("a") != F.col("top.a")) & (F.col("clean") <= 0.01 * F.col("top.clean")) & (F.col("top.clean") > 0) & (F.col("n") <= 0.2 * F.col("top.n")))
        .where(F.col("top.a").rlike("^[a-z]+(-[a-z]+)*$"))
        .select(F.col("a").alias("word"), F.col("top.a").alias("fixed"))
    )


def _cut_words(cuts: DataFrame, words: DataFrame) -> DataFrame:
    """The cuts (id, doc_id, line_no, left, right) whose mark is not the word's own hyphen. Joined forms are looked up
    among known words and by skeleton, hyphenated forms among known compounds."""
    c = cuts.select("id", "doc_id", F.element_at("line_nos", 1).alias("line_no"), F.element_at("pure", 1).alias("never_own"), "a", "b", "c")
    ask = c.where("not never_own").select("a", "b", "c").distinct()
    forms = stage(ask.select("a", "b", "c", F.explode(F.array(*(F.struct(F.lit(k).alias("own"), F.concat("a", F.lit(h), x).alias("form")) for x in ("b", "c") for k, h in ((0, ""), (1, "-"))))).alias("f")).select("a", "b", "c", "f.*"))
    known = words.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "form")
    found = forms.join(known, "form").groupBy("a", "b", "c").agg(F.sum(F.when(F.col("own") == 1, F.col("n")).otherwise(0)).alias("own_n"), F.sum(F.when(F.col("own") == 0, F.col("n")).otherwise(0)).alias("cut_n"))
    # Compounds by their first part, for cuts whose second part was displaced by another line.
    first = words.where(F.col("a").contains("-")).groupBy(F.substring_index("a", "-", 1).alias("a")).agg(F.sum("n").alias("first_n"))
    alone = known.withColumnRenamed("form", "a").withColumnRenamed("n", "alone_n")
    said = ask.join(found, ["a", "b", "c"], "left").join(first, "a", "left").join(alone, "a", "left").fillna(0)
    own = F.when(F.col("own_n") + F.col("cut_n") > 0, F.col("own_n") > F.col("cut_n")).otherwise((F.col("first_n") > 0) & (F.col("alone_n") + F.col("first_n") > 1))
    judged = c.join(said.select("a", "b", "c", own.alias("own")), ["a", "b", "c"], "left")
    return judged.where(F.col("never_own") | ~F.col("own")).select("id", "doc_id", "line_no", F.col("a").alias("left"), F.col("b").alias("right"))


def words_here(text: str) -> Iterator[tuple[int, str]]:
    """Line number and word of a text, words cut at line ends joined."""
    lines, cuts = lines_and_cuts(plain(text))
    yield from words_of(lines, cuts)
    for k, a, _mark, b, _c in cuts:
        yield k, (a + b).lower()


def words_to_repair(text: str) -> set[str]:
    """Every word that may stand in the repaired text, whichever way its cut words are joined."""
    lines, cuts = lines_and_cuts(plain(text))
    out = {w for line in lines for run in line.split() for w in words_in(run)}
    out.update((a + mark + x).lower() for _k, a, _m, b, c in cuts for x in (b, c) for mark in ("", "-"))
    return out | {w for _, w in words_of(lines, cuts)}


_CUT_LINE = re.compile(r"[-¬] *\n")


def _few(misread: DataFrame) -> pd.DataFrame | None:
    """The misread words, if they are few enough to be sent to every task."""
    few = misread.limit(MISREADS + 1).toPandas()
    return few if len(few) <= MISREADS else None


def _occurrences(blocks: DataFrame, misread: DataFrame) -> DataFrame:
    """id, doc_id, line_no of the lines with a misread word."""
    rows = blocks.where("content is not null and not native").select("id", "doc_id", "content")
    if (few := _few(misread)) is not None:
        bad = blocks.sparkSession.sparkContext.broadcast(frozenset(few["word"]))

        def look(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known, seen = bad.value, {}

            def suspicious(run: str) -> bool:
                if (x := seen.get(run)) is None:
                    if len(seen) > 200_000:
                        seen.clear()
                    x = seen[run] = any(w in known for w in words_in(run))
                return x

            for pdf in it:
                out = []
                for id_, doc, text in zip(pdf["id"], pdf["doc_id"], pdf["content"]):
                    text = plain(text)
                    if _CUT_LINE.search(text) or any(map(suspicious, text.split())):
                        out += [(id_, doc, k) for k in {k for k, w in words_here(text) if w in known}]
                yield pd.DataFrame(out, columns=["id", "doc_id", "line_no"])

        return rows.mapInPandas(look, "id string, doc_id string, line_no int")

    def say(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = [(id_, doc, k, w) for id_, doc, text in zip(pdf["id"], pdf["doc_id"], pdf["content"]) for k, w in set(words_here(text))]
            yield pd.DataFrame(out, columns=["id", "doc_id", "line_no", "word"])

    return rows.mapInPandas(say, "id string, doc_id string, line_no int, word string").join(misread.select("word"), "word", "left_semi").drop("word")


def scan_parts(blocks: DataFrame, min_share: float = 0.5) -> dict[str, DataFrame]:
    """The labelled outer lines, cut words, misread words and lines that hold them, of ``blocks`` (id, doc_id, page,
    content, extra)."""
    ext = F.lower(F.col("extra")["extractor"])
    rows = blocks.where("id is not null and doc_id is not null").select("id", "doc_id", "page", "content", (F.coalesce(ext, F.lit("")) == "native").alias("native"), (F.coalesce(ext, F.lit("")) == "ocr").alias("ocr"))
    files = stage(rows.groupBy("doc_id").agg((F.max("ocr") | ~F.max("native")).alias("scanned")))
    first = stage(rows.where("content is not null").select("id", "doc_id", "page", "native", "content").mapInPandas(_first_pass, PASS))
    words = stage(first.where("t = 'word'").groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("clean").alias("clean")))
    outer = stage(_outer_lines(first.where("t = 'block'"), files, min_share))
    misread = stage(_misread_words(words))
    scanned = files.where("scanned").select("doc_id")
    cuts = _cut_words(first.where("t = 'cut'").join(scanned, "doc_id", "left_semi"), words)
    lines = _occurrences(rows, misread).join(scanned, "doc_id", "left_semi")
    return {"outer": outer, "cuts": cuts, "misread": misread, "misread_lines": lines.join(outer.where("state <> 'page_number'"), ["id", "line_no"], "left_anti"), "scanned": scanned}


def defects(blocks: DataFrame) -> DataFrame:
    """block_id, defect: hyphen, misread, header, page_number."""
    p = scan_parts(blocks)
    kinds = F.when(F.col("state") == "header", F.array(F.lit("header"))).when(F.col("state") == "page_number", F.array(F.lit("page_number"))).otherwise(F.array(F.lit("header"), F.lit("page_number")))
    return (
        p["outer"].select(F.col("id").alias("block_id"), F.explode(kinds).alias("defect"))
        .unionByName(p["cuts"].select(F.col("id").alias("block_id"), F.lit("hyphen").alias("defect")))
        .unionByName(p["misread_lines"].select(F.col("id").alias("block_id"), F.lit("misread").alias("defect")))
        .distinct()
    )


_STARTS = re.compile(r"\s*(?:[•*\-–]\s|\d+[.)]\s|[A-Za-z][.)]\s|Q:|A:)")


def _cased(word: str, like: str) -> str:
    if like.isupper() and len(like) > 1:
        return word.upper()
    return word[:1].upper() + word[1:] if like[:1].isupper() else word


# Hidden Markov model of the lines inside a block: does the paragraph go on behind the line (body) or end with it (break)?
#: Observation of a line: short (under three quarters of the block's longest) x ends like a sentence x what follows: 0 a small
#: or Thai letter, 1 a capital, digit or mark, 2 a list sign, 3 a blank line or nothing.
_LAYOUT = [(short, stop, follows) for short in (0, 1) for stop in (0, 1) for follows in range(4)]
_BREAKS = ("body", "break")


def _layout_start() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starting probabilities: of the first line's state, of the next state, and of the observations. No body line comes before
    a list sign, a blank line or the end; training cannot change that."""
    short, stop, follows = ((0.1, 0.85), (0.15, 0.7), ((0.78, 0.22, 1e-12, 1e-12), (0.05, 0.45, 0.2, 0.3)))
    emit = np.array([[(short[k] if s else 1 - short[k]) * (stop[k] if e else 1 - stop[k]) * follows[k][f] for s, e, f in _LAYOUT] for k in (0, 1)])
    return np.array([0.7, 0.3]), np.array([[0.75, 0.25], [0.7, 0.3]]), emit


def layout_codes(lines: list[str]) -> list[int]:
    longest = max(map(len, lines), default=0)
    out = []
    for line, following in zip(lines, [*lines[1:], ""]):
        head = following.lstrip()[:1]
        follows = 3 if not head else 2 if _STARTS.match(following) else 0 if head.islower() or "ก" <= head <= "๛" else 1
        out.append(8 * (len(line) < 0.75 * longest) + 4 * (line[-1:] in tuple(".!?:")) + follows)
    return out


def train_layout(pairs: list[tuple[int, int, int]], rounds: int = 20, trust: float = 2000.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The model from (code, next line's code, count), by expectation maximisation over neighbouring lines."""
    first = _layout_start()
    start, step, emit = first
    for _ in range(rounds):
        ns, nt, ne = (x * trust for x in first)
        for a, b, n in pairs:
            joint = (start * emit[:, a])[:, None] * step * emit[:, b][None, :]
            joint *= n / joint.sum()
            ns, nt = ns + joint.sum(1), nt + joint
            ne[:, a] += joint.sum(1)
            ne[:, b] += joint.sum(0)
        start, step, emit = ns / ns.sum(), nt / nt.sum(1, keepdims=True), ne / ne.sum(1, keepdims=True)
    return start, step, emit


def breaks(lines: list[str], model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[bool]:
    """Whether the paragraph ends with each line: the best state sequence (Viterbi). Blank lines are breaks in any case."""
    if not lines:
        return []
    start, step, emit = (np.log(x).tolist() for x in model)
    codes = layout_codes(lines)
    best, back = [start[k] + emit[k][codes[0]] for k in (0, 1)], []
    for c in codes[1:]:
        come = [max((0, 1), key=lambda j, k=k: best[j] + step[j][k]) for k in (0, 1)]
        best = [best[come[k]] + step[come[k]][k] + emit[k][c] for k in (0, 1)]
        back.append(come)
    state = [int(best[1] > best[0])]
    for come in reversed(back):
        state.append(come[state[-1]])
    return [s == 1 or not line.strip() for s, line in zip(reversed(state), lines)]


def kept_lines(text: str, drop: set[int]) -> list[tuple[int, str]]:
    return [(k, line.rstrip()) for k, line in enumerate(plain(text).split("\n")) if k not in drop]


def paragraphs(text: str, drop: set[int], joined: set[int], fixes: dict[str, str], model: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> str:
    """The text without the lines ``drop``, cut words joined where their line is in ``joined``, misread words replaced, and
    lines run together up to a line that the layout model calls a break, a blank line or the end."""
    kept = kept_lines(text, drop)
    ends = breaks([line for _, line in kept], model or _layout_start())
    out, here = [], ""
    for i, (k, line) in enumerate(kept):
        following = kept[i + 1][1] if i + 1 < len(kept) else ""
        if k in joined and following:
            here += line.rstrip("-¬ ")
            continue
        here += line
        if line.endswith("-") and following and not line.endswith(" -"):
            continue  # the word's own hyphen
        if not following.strip() or ends[i]:
            if here.strip():
                out.append(here.strip())
            here = ""
        else:
            here += " "
    if here.strip():
        out.append(here.strip())
    body = "\n".join(out)
    if not fixes:
        return body

    def one(m: re.Match) -> str:
        return _cased(fixes[m.group().lower()], m.group()) if m.group().lower() in fixes else m.group()

    return _TOKEN.sub(one, body)


def _as_set(x: object) -> set[int]:
    return set() if x is None or isinstance(x, float) else set(x)


def _layout_model(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The layout model of all scanned blocks' lines (``content``, ``drop``)."""

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for pdf in it:
            for text, drop in zip(pdf["content"], pdf["drop"]):
                codes = layout_codes([line for _, line in kept_lines(text, _as_set(drop))])
                seen.update(zip(codes, codes[1:]))
        yield pd.DataFrame([(a, b, n) for (a, b), n in seen.items()], columns=["a", "b", "n"])

    pairs = rows.where("scanned and content is not null").select("content", "drop").mapInPandas(count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return train_layout(sorted((r.a, r.b, r.n) for r in pairs.collect()))  # at most 16 x 16 rows


def repaired(blocks: DataFrame) -> DataFrame:
    """id, doc_id and the repaired text of each distinct block of a scanned file; other files' blocks keep their text."""
    p = scan_parts(blocks)
    drop = p["outer"].groupBy("id").agg(F.collect_set("line_no").alias("drop"))
    cut = p["cuts"].groupBy("id").agg(F.collect_set("line_no").alias("joined"))
    rows = blocks.where("id is not null").select("id", "doc_id", "content").dropDuplicates(["id"]).join(drop, "id", "left").join(cut, "id", "left").join(p["scanned"].withColumn("scanned", F.lit(True)), "doc_id", "left")
    if (few := _few(p["misread"])) is not None:
        shared = blocks.sparkSession.sparkContext.broadcast(dict(zip(few["word"], few["fixed"])))
        rows = rows.withColumn("fixes", F.lit(None).cast("map<string,string>"))
    else:
        shared = None

        def say(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                yield pd.DataFrame([(id_, w) for id_, text in zip(pdf["id"], pdf["content"]) for w in words_to_repair(text)], columns=["id", "word"])

        words = blocks.where("id is not null and content is not null").select("id", "content").mapInPandas(say, "id string, word string")
        fixes = words.join(p["misread"], "word").select("id", "word", "fixed").distinct().groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("word", "fixed"))).alias("fixes"))
        rows = rows.join(fixes, "id", "left")
    rows = stage(rows.select("id", "doc_id", "content", "scanned", "drop", "joined", "fixes"))
    model = _layout_model(rows)

    def work(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value if shared is not None else {}
        for pdf in it:
            out = []
            for text, scanned, drop_, joined, fixes in zip(pdf["content"], pdf["scanned"], pdf["drop"], pdf["joined"], pdf["fixes"]):
                if text is None or scanned is None or scanned != scanned:
                    out.append(text)
                else:
                    out.append(paragraphs(text, _as_set(drop_), _as_set(joined), known or dict(fixes if isinstance(fixes, (dict, list)) else {}), model))
            yield pdf[["id", "doc_id"]].assign(repaired=out)

    return rows.mapInPandas(work, "id string, doc_id string, repaired string")

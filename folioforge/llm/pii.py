"""Problem 6: personal details in free text and table cells, replaced by typed placeholders.

High-recall generators propose overlapping spans of each type; boosted trees over format and context features score them;
a span above its type's threshold is selected, longer and surer spans first. The trees are trained here, on the spans
that the generators propose in about SAMPLE texts, the same ones in every run (chosen and ordered by a hash of the text);
the spans are made and counted where the texts lie, and only counts of feature sets reach the driver. Nobody labelled those
texts, so spans that a check digit, a title, the name lexicon or a telling neighbour decides serve as examples; what decided
is hidden from the trees in half of the examples of every type. Names must be judged in the same way with and without that
evidence (the lexicon lacks most names); for the other types the trees are told that it is hidden, so that a span without
evidence is not taken for one whose evidence is unknown. Thresholds are the scores that give the best F1 on the examples held
out. One fit over blocks and tables serves found and redacted texts alike.

Spans are found in the canonical text (problem 4) with Arabic digits and mapped back, so the rest of a text stays as it
is. A table is read with its cells joined; a span over several cells leaves its placeholder in the first. Everything but the
trees' training covers whole texts and all rows.

Defined results: null texts and cells stay null; empty ones stay empty; repeated rows get the same result; tables without
rows have no details; existing placeholders such as [EMAIL] are left alone.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.textnorm import BLANKS, canonical, needs

TYPES = ("email", "phone", "id_number", "address", "person_name")
SAMPLE = 12_000
CELL = "\ue000"  # between the cells of a table; neither a letter nor a blank
_THAI_DIGIT = re.compile("[๐-๙]")
_DIGITS = str.maketrans("๐๑๒๓๔๕๖๗๘๙", "0123456789")

_EMAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.+-]*\s{0,2}(?:@|[\[({]\s?at\s?[\])}])\s{0,2}[A-Za-z0-9][A-Za-z0-9-]*(?:\s{0,2}(?:\.|[\[({]\s?dot\s?[\])}])\s{0,2}[A-Za-z0-9][A-Za-z0-9-]*)*", re.I)
_PHONE = re.compile(r"(?<![\w/.,-])(?:\(?(?:\+|00)\s?\d{1,3}\)?[\s.-]{0,2}\(?\d{1,4}\)?(?:[\s.-]{0,2}\d{2,4}){2,3}|\(?0\d{1,2}\)?[\s.-]{0,2}\d{3}[\s.-]?\d{3,4})(?![\d/]|[-.]\d)(?:\s*(?:ext\.?|ต่อ)\s*\d{1,5})?")
_ID13 = re.compile(r"(?<![\d.,/-])\d(?:[\s-]?\d){12}(?![\d/]|[-.,]\d)")
_PASSPORT = re.compile(r"(?:passport|หนังสือเดินทาง)(?:[^\d\n]{0,12}?|\s*(?:no\.?|number|เลขที่)\s*)\s*([A-Z]{1,2}\s?\d{6,8})(?!\d)", re.I)
_CODE = re.compile(r"(?<![\w-])[A-Z]{1,2}\s?\d{7}(?![\w-])")
_PLACE = r"(?-i:[A-Z][\w'’-]+(?:[ -][A-Z][\w'’-]+)?)"
_STREET = r"(?:road|rd|street|st|lane|ln|avenue|ave|drive|close|way|court|place|soi)\b\.?"
_ADDRESS = re.compile(rf"(?:(?:flat|unit|apt\.?|room|suite)\s+\w{{1,5}},?\s+)?(?<![\w.,/])\d{{1,5}}[A-Z]?(?:/\d+)?,?\s+(?:[A-Za-z][\w'’-]*\s+){{1,3}}{_STREET}(,\s*{_PLACE}(?:,\s*{_PLACE})?(?:\s+\d{{5}})?)?", re.I)
_BOX = re.compile(rf"p\.?\s?o\.?\s*box\s+\d+(,\s*{_PLACE}(?:\s+\d{{5}})?)?", re.I)
_THAI_ADDRESS = re.compile(r"(?:(?:บ้านเลขที่|เลขที่)\s*)?(?<![\d/.,-])\d{1,5}(?:/\d+)?\s*(?:(?:หมู่ที่|หมู่|ม\.)\s*\d+\s*)?(?:(?:ถนน|ถ\.|ซอย|ซ\.)\s*\S+\s*){0,2}((?:ตำบล|ต\.|แขวง)\s*\S+\s*(?:อำเภอ|อ\.|เขต)\s*\S+(?:\s*(?:จังหวัด|จ\.)\s*[ก-๙]+)?(?:\s*\d{5})?)")
_THAI_BOX = re.compile(r"ตู้\s*ปณ\.?\s*\d+(\s+\S+(?:\s*(?:จังหวัด|จ\.)\s*\S+)?(?:\s*\d{5})?)")
_W = r"(?:[A-Z][a-z'’]+(?:-[A-Z][a-z]+)?|[A-Z]{3,}(?:-[A-Z]{2,})?)"
_TITLED = re.compile(rf"\b(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Khun|MR|MRS|MS|MISS|DR|PROF|KHUN)\b\.?\s+({_W})(?:\s+[A-Z]\.)?(?:\s+({_W}))?")
_PAIR = re.compile(rf"(?=\b({_W})((?:\s+[A-Z]\.)?\s+|,\s+)({_W})\b)")
_CAPITAL = re.compile(r"[A-Z][A-Za-z'’-]+")
_THAI_TITLED = re.compile(r"(?<![ก-๙])(นางสาว|นาง|นาย|คุณ|ดร\.|รศ\.|ผศ\.|ศ\.|น\.ส\.|ด\.ช\.|ด\.ญ\.)\s*([ก-๙]{2,})(?:\s+([ก-๙]{2,}))?")
_THAI_PAIR = re.compile(r"(?=(?<![ก-๙])([ก-๙]{2,})\s+([ก-๙]{2,}))")
_AT_WORD = re.compile(r"[\[({]\s?(?:at|AT|At)\s?[\])}]")
_LONG_NUMBER = re.compile(r"\d[\d\s().+-]{6,}\d")
_LETTERED = re.compile(r"[A-Za-z]\s?\d{6}")
_PLACEHOLDER = re.compile(r"\[[A-Z_]{3,20}\]|<[A-Z_]{3,20}>")
# Words that make the names before them those of firms, streets or products (fixed values).
FIRM = frozenset("ltd limited inc llc co company corp corporation holdings partners services systems logistics works trading supply group bank metering industries sons associates plc & and".split())
THING = frozenset("road rd street st lane ln avenue ave bridge square park station tower building hall valve pump model engine series brand drive close way court place".split())
PERSON_AFTER = frozenset("was is has had asked said says signed will who wrote confirmed แล้ว เป็น เท่านั้น".split())
SIGNS = frozenset("signed witness contact attention attn by to from mr mrs ms dr prof khun according with and for dear ผู้ติดต่อ ลงนามโดย คุณ".split())
STREETS = ("road", " rd", "street", " st.", " st,", "lane", " ln", "avenue", " ave", "drive", " close", " way", "court", " place", " soi", "box")
TITLES = ("Mr", "MR", "Ms", "MS", "Mis", "MIS", "Mx", "Dr", "DR", "Prof", "PROF", "Khun", "KHUN")
THAI_TITLES = ("นาง", "นาย", "คุณ", "ดร.", "ศ.", "น.ส.", "ด.ช.", "ด.ญ.")
LINES = frozenset("order batch reference ref invoice item form clause rule annex number no. code lot".split())
CALL = frozenset("call tel tel. phone mobile mobile: telephone fax contact at on โทร โทร. เบอร์ หมายเลข".split())


def check_digit(digits: str) -> bool:
    """Whether the 13th digit is the check digit of the first twelve."""
    return (11 - sum(int(d) * (13 - k) for k, d in enumerate(digits[:12])) % 11) % 10 == int(digits[12])


class Lexicon:
    """Names and the parts they are made of: a name-like word is a beginning and an end that several names share."""

    def __init__(self, rows: list[tuple[str, str, str]], shared: int = 2) -> None:
        self.known: dict[str, frozenset[str]] = {}
        self.begin: dict[str, frozenset[str]] = {}
        self.end: dict[str, frozenset[str]] = {}
        for kind in ("given", "family"):
            names = {n.lower() for n, k, _ in rows if k == kind and n}
            self.known[kind] = frozenset(names)
            heads, tails = Counter(), Counter()
            for n in names:
                heads.update(n[:k] for k in range(2, len(n) - 1))
                tails.update(n[k:] for k in range(2, len(n) - 1))
            self.begin[kind] = frozenset(p for p, c in heads.items() if c >= shared)
            self.end[kind] = frozenset(p for p, c in tails.items() if c >= shared)
        self.cache: dict[str, int] = {}

    def flags(self, word: str) -> int:
        """Bits: 1 known given name, 2 known family name, 4 made like a given name, 8 made like a family name."""
        w = word.lower()
        if (f := self.cache.get(w)) is None:
            if len(self.cache) > 200_000:
                self.cache.clear()
            f = 0
            if len(w) > 40:
                return 0
            for bit, kind in ((1, "given"), (2, "family")):
                if w in self.known[kind]:
                    f |= bit
                if any(w[:k] in self.begin[kind] and w[k:] in self.end[kind] for k in range(2, len(w) - 1)):
                    f |= 4 * bit
            self.cache[w] = f
        return f


FEATURES = (
    "title", "given_known", "family_known", "given_made", "family_made", "second_given_made", "first_family_made", "ordered", "comma", "initial", "capitals",
    "after_the", "sign_before", "person_after", "firm_after", "thing_after", "thing_inside", "firm_inside", "single", "thai", "line_start",
    "tld", "dotted", "spelled_at", "numeric_domain", "check", "zero", "passport", "reference_before", "call_before", "plus", "length_phone", "extension",
    "place", "house", "code5", "box", "year_inside", "colon_before", "hidden",
)
_AT = {f: k for k, f in enumerate(FEATURES)}
#: Features that decide the examples' labels, by type; hidden in half of the examples.
HIDDEN = {
    "email": ("tld", "dotted", "numeric_domain"), "phone": ("plus", "length_phone", "reference_before"), "id_number": ("check", "zero", "passport"),
    "address": ("place", "house", "year_inside", "code5"), "person_name": ("given_known", "family_known"),
}


def _around(text: str, a: int, b: int) -> tuple[str, str]:
    left = text[max(0, a - 40) : a].split()
    right = text[b : b + 40].split()
    return (left[-1].lower() if left else ""), (right[0].lower().strip(".,;:") if right else "")


def candidates(text: str, lex: Lexicon) -> Iterator[tuple[str, int, int, list[str]]]:
    """Type, start, end and features of the proposed spans of a canonical text with Arabic digits."""
    for kind, a, b, f in _numbers_and_places(text):
        before = text[max(0, a - 40) : a].rstrip(" ")
        f += ["line_start"] if before[-1:] in ("\n", CELL, "") else []
        f += ["colon_before"] if before.endswith(":") else []
        yield kind, a, b, f
    yield from _names(text, lex)


def _numbers_and_places(text: str) -> Iterator[tuple[str, int, int, list[str]]]:
    if "@" in text or _AT_WORD.search(text):
        for m in _EMAIL.finditer(text):
            s = m.group()
            domain = re.split(r"@|[\[({]\s?at\s?[\])}]", s, maxsplit=1, flags=re.I)[1]
            f = ["spelled_at"] if "@" not in s else []
            f += ["dotted"] if re.search(r"\.|dot", domain, re.I) else []
            f += ["numeric_domain"] if re.fullmatch(r"[\s\d.]+", domain) else []
            f += ["tld"] if re.search(r"[A-Za-z]{2,}\s*$", domain) and "dotted" in f else []
            yield "email", m.start(), m.end(), f
    if _LONG_NUMBER.search(text):
        for m in _PHONE.finditer(text):
            digits = re.sub(r"\D", "", re.split("ext|ต่อ", m.group())[0])
            if not 8 <= len(digits) <= 15:
                continue
            before, _ = _around(text, m.start(), m.end())
            f = [x for x, ok in (("plus", m.group().lstrip("(").startswith(("+", "00"))), ("length_phone", len(digits) >= 9), ("reference_before", before in LINES), ("call_before", before in CALL), ("extension", "ext" in m.group())) if ok]
            yield "phone", m.start(), m.end(), f
        for m in _ID13.finditer(text):
            digits = re.sub(r"\D", "", m.group())
            before, _ = _around(text, m.start(), m.end())
            f = [x for x, ok in (("check", check_digit(digits)), ("zero", digits[0] == "0"), ("reference_before", before in LINES), ("call_before", before in CALL)) if ok]
            yield "id_number", m.start(), m.end(), f
    if _LETTERED.search(text):
        named = [m.span(1) for m in _PASSPORT.finditer(text)]
        for a, b in named:
            yield "id_number", a, b, ["passport", "check"]
        for m in _CODE.finditer(text):
            if m.span() not in named:
                yield "id_number", m.start(), m.end(), ["reference_before"]
    low = text.lower().replace("\n", " ")
    if any(x in low for x in STREETS):
        for pattern in (_ADDRESS, _BOX):
            for m in pattern.finditer(text):
                f = [x for x, ok in (("place", m.group(1)), ("house", True), ("box", pattern is _BOX), ("code5", re.search(r"\d{5}$", m.group())), ("year_inside", re.match(r"(?:19|20|25)\d\d\b", m.group()))) if ok]
                yield "address", m.start(), m.end(), f
    if "ต." in text or "ตำบล" in text or "แขวง" in text or "ปณ" in text:
        for pattern in (_THAI_ADDRESS, _THAI_BOX):
            for m in pattern.finditer(text):
                f = [x for x, ok in (("place", m.group(1)), ("house", True), ("thai", True), ("box", pattern is _THAI_BOX), ("code5", re.search(r"\d{5}$", m.group()))) if ok]
                yield "address", m.start(), m.end(), f


def _name_features(text: str, a: int, b: int, first: str, second: str, extra: list[str], lex: Lexicon) -> list[str]:
    f = list(extra)
    x, y = lex.flags(first) if first else 0, lex.flags(second) if second else 0
    given, family = (y, x) if "comma" in extra else (x, y)
    f += ["given_known"] if given & 1 else []
    f += ["family_known"] if family & 2 else []
    f += ["given_made"] if given & 5 else []
    f += ["family_made"] if family & 10 else []
    f += ["second_given_made"] if family & 5 else []
    f += ["first_family_made"] if given & 10 else []
    f += ["ordered"] if given & 5 and family & 10 else []
    f += ["single"] if not second else []
    before, after = _around(text, a, b)
    f += ["after_the"] if before in ("the", "a", "an", "left", "right", "on", "branch") else []
    f += ["sign_before"] if before.strip(":.,") in SIGNS or before.endswith(":") else []
    f += ["person_after"] if after in PERSON_AFTER else []
    f += ["line_start"] if a == 0 or text[:a].rstrip(" ")[-1:] in ("\n", CELL, "") else []
    f += ["firm_after"] if after in FIRM and not text[b : b + 1] == "." else []
    f += ["thing_after"] if after in THING else []
    low = {first.lower(), second.lower()}
    f += ["thing_inside"] if low & THING else []
    f += ["firm_inside"] if low & FIRM else []
    return f


def _names(text: str, lex: Lexicon) -> Iterator[tuple[str, int, int, list[str]]]:
    for m in _TITLED.finditer(text) if any(t in text for t in TITLES) else ():
        a, b = m.start(), m.end()
        first, second = m.group(1), m.group(2) or ""
        if second and not lex.flags(second) and (lex.flags(first) & 10 or not lex.flags(first)) and not second.isupper():
            b, second = m.end(1), ""  # the next sentence's first word
        initial = ["initial"] if re.search(r"\s[A-Z]\.\s", m.group()) else []
        yield "person_name", a, b, _name_features(text, a, b, first, second, ["title", *initial], lex)
    if any(lex.flags(w) for w in _CAPITAL.findall(text)):
        for m in _PAIR.finditer(text):
            first, gap, second = m.groups()
            if not (lex.flags(first) and lex.flags(second)) and not ((lex.flags(first) | lex.flags(second)) & 3):
                continue
            a, b = m.start(1), m.end(3)
            extra = (["comma"] if "," in gap else []) + (["initial"] if "." in gap else []) + (["capitals"] if first.isupper() and second.isupper() else [])
            yield "person_name", a, b, _name_features(text, a, b, first, second, extra, lex)
    if any(t in text for t in THAI_TITLES):
        for m in _THAI_TITLED.finditer(text):
            first, second = m.group(2), m.group(3) or ""
            x, y = lex.flags(first), lex.flags(second) if second else 0
            b = m.end()
            if second and not y and not x:
                b = m.end()
            elif second and not y:
                b, second = m.end(2), ""
            yield "person_name", m.start(), b, _name_features(text, m.start(), b, first, second, ["title", "thai"], lex)
    flags = [lex.flags(w) if w[0] >= "ก" else 0 for w in text.split()]
    if any(x & 1 and y & 10 for x, y in zip(flags, flags[1:])):
        for m in _THAI_PAIR.finditer(text):
            if lex.flags(m.group(1)) & 1 and lex.flags(m.group(2)) & 10:
                yield "person_name", m.start(1), m.end(2), _name_features(text, m.start(1), m.end(2), m.group(1), m.group(2), ["thai"], lex)


def example(kind: str, f: list[str]) -> int | None:
    """The label of a span that its evidence decides: 1, 0, or None."""
    f = set(f)
    if kind == "email":
        return int("tld" in f and "numeric_domain" not in f)
    if kind == "phone":
        return 0 if "reference_before" in f else int("plus" in f or "length_phone" in f)
    if kind == "id_number":
        return int("check" in f and "zero" not in f)
    if kind == "address":
        return int("place" in f and "house" in f or "box" in f and "place" in f) if "year_inside" not in f else (1 if {"place", "code5"} <= f else 0)
    if f & {"firm_after", "thing_after", "thing_inside", "firm_inside", "after_the"}:
        return 0
    if "thai" in f and "title" in f:
        return 1 if "given_made" in f or "family_made" in f else 0
    if "title" in f:
        return 1
    if {"given_known", "family_known"} <= f:
        return 1
    if not f & {"given_known", "family_known"} and "ordered" not in f:
        return 0
    if "ordered" in f or f & {"sign_before", "person_after"}:
        return 1 if {"ordered", "sign_before"} <= f and f & {"given_known", "family_known"} else None
    return 0


class Boosted:
    """Gradient boosting on the logistic loss with trees of depth DEPTH over binary features."""

    DEPTH, TREES, RATE, LEAST = 3, 40, 0.3, 5.0

    def __init__(self) -> None:
        self.trees: list[tuple[np.ndarray, np.ndarray]] = []  # split feature of each inner node, value of each leaf
        self.base = 0.0
        self.threshold = 0.5
        self.lesion = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> "Boosted":
        p = np.clip(np.average(y, weights=weight), 0.01, 0.99)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.base)
        for _ in range(self.TREES):
            p = 1 / (1 + np.exp(-score))
            g, h = weight * (y - p), weight * p * (1 - p)
            inner, at = np.zeros(2**self.DEPTH - 1, int), np.zeros(len(y), int)
            for level in range(self.DEPTH):
                for node in range(2**level):
                    rows = at == node
                    gx, hx, gs, hs = x[rows].T @ g[rows], x[rows].T @ h[rows], g[rows].sum(), h[rows].sum()
                    gain = gx**2 / (hx + self.LEAST) + (gs - gx) ** 2 / (hs - hx + self.LEAST)
                    inner[2**level - 1 + node] = int(gain.argmax())
                at = 2 * at + x[np.arange(len(y)), inner[2**level - 1 + at]].astype(int)
            leaves = 2**self.DEPTH
            value = self.RATE * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + self.LEAST)
            self.trees.append((inner, value))
            score += value[at]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for inner, value in self.trees:
            at = np.zeros(len(x), int)
            for level in range(self.DEPTH):
                at = 2 * at + x[rows, inner[2**level - 1 + at]].astype(int)
            out += value[at]
        return 1 / (1 + np.exp(-out))


def _matrix(features: list[list[str]]) -> np.ndarray:
    x = np.zeros((len(features), len(FEATURES)))
    for k, f in enumerate(features):
        x[k, [_AT[n] for n in f]] = 1
    return x


def examples(text: str, lex: Lexicon) -> Iterator[tuple[str, tuple[str, ...], int, bool]]:
    """Type, features, label and whether held out, of the decided spans of a text. One text in four is held out."""
    held = crc32(text.encode()) % 4 == 0
    for kind, _a, _b, f in candidates(prepared(text), lex):
        if (label := example(kind, f)) is not None:
            yield kind, tuple(sorted(set(f))), label, held


def train(texts: list[str], lex: Lexicon) -> dict[str, Boosted]:
    """A model per type, with its threshold."""
    return train_on(Counter(e for t in texts for e in examples(t, lex)))


def train_on(counts: dict[tuple[str, tuple[str, ...], int, bool], int]) -> dict[str, Boosted]:
    """The models from counts of examples, and per model ``lesion``: the share of held-out examples judged right when what
    decided them is hidden."""
    models = {}
    for kind in TYPES:
        rows = sorted((f, label, held, n) for (k, f, label, held), n in counts.items() if k == kind)
        # The plainest spans of a type, so that a small sample, too, knows both classes.
        rows += [(tuple(f), label, False, n) for f, label, n in _plain_examples(kind)]
        x, y = _matrix([list(r[0]) for r in rows]), np.array([r[1] for r in rows], float)
        held, n = np.array([r[2] for r in rows]), np.array([r[3] for r in rows], float)
        blind = x.copy()
        blind[:, [_AT[c] for c in HIDDEN[kind]]] = 0
        if kind != "person_name":
            blind[:, _AT["hidden"]] = 1
        both = np.vstack([x, blind])
        m = Boosted().fit(both[np.tile(~held, 2)], np.tile(y[~held], 2), np.tile(n[~held] / 2, 2))
        test = held if len(set(y[held])) == 2 else np.ones(len(y), bool)
        shown = (x, blind) if kind == "person_name" else (x,)
        p, true, w = np.concatenate([m.score(v[test]) for v in shown]), np.tile(y[test], len(shown)), np.tile(n[test], len(shown))
        cuts = np.linspace(0.1, 0.9, 17)
        f1 = [2 * w[(p >= c) & (true == 1)].sum() / max(1, w[p >= c].sum() + w[true == 1].sum()) for c in cuts]
        best = [c for c, v in zip(cuts, f1) if v >= max(f1) - 1e-9]
        m.threshold = float(best[len(best) // 2])
        m.lesion = float(np.average((m.score(blind[test]) >= m.threshold) == (y[test] == 1), weights=n[test]))
        models[kind] = m
    return models


def _plain_examples(kind: str) -> list[tuple[list[str], int, int]]:
    rows = {
        "email": [(["dotted", "tld"], 1), (["dotted", "tld", "spelled_at"], 1), (["dotted", "numeric_domain"], 0), ([], 0)],
        "phone": [(["plus", "length_phone"], 1), (["length_phone", "call_before"], 1), (["length_phone"], 1), (["reference_before", "length_phone"], 0), ([], 0)],
        "id_number": [(["check"], 1), (["passport", "check"], 1), (["reference_before"], 0), ([], 0), (["check", "zero"], 0), (["zero", "call_before"], 0)],
        "address": [(["place", "house"], 1), (["place", "house", "code5"], 1), (["place", "house", "thai"], 1), (["place", "house", "box"], 1), (["house"], 0), (["house", "year_inside"], 0)],
        "person_name": [
            (["title", "single"], 1), (["title", "given_made", "family_made", "ordered"], 1), (["given_made", "family_made", "ordered", "sign_before"], 1), (["given_made", "family_made", "ordered"], 1), (["given_made", "family_made", "ordered", "person_after"], 1), (["given_made", "sign_before", "person_after"], 1), (["family_made", "sign_before", "person_after"], 1),
            (["given_made", "sign_before"], 1), (["family_made", "sign_before"], 1), (["comma", "family_made", "sign_before"], 1), (["comma", "given_made", "sign_before"], 1),
            (["given_made", "family_made", "ordered", "comma"], 1), (["title", "thai", "given_made", "family_made", "ordered"], 1), (["title", "thai"], 0), (["given_made", "family_made", "ordered", "firm_after"], 0),
            (["family_made", "thing_after"], 0), (["family_made", "thing_inside"], 0), (["family_made", "firm_inside"], 0), (["given_made", "after_the"], 0), (["family_made"], 0), (["given_made"], 0), (["comma", "given_made"], 0),
        ],
    }[kind]
    return [(f, label, 10) for f, label in rows]


def prepared(text: str) -> str:
    return _arabic(canonical(text)[0] if needs(text) else text)


def _arabic(text: str) -> str:
    return text.translate(_DIGITS) if _THAI_DIGIT.search(text) else text


def aligned(text: str) -> tuple[str, list[int] | None]:
    """The prepared text, and for each of its positions (and its end) the position in ``text``; None if they agree."""
    if not needs(text):
        return _arabic(text), None
    out, at = [], []
    for m in re.finditer(rf"[\n{BLANKS} ]|[^\n{BLANKS} ]+", text):
        old = m.group()
        new = canonical(old)[0]
        if len(new) == len(old):
            at += range(m.start(), m.end())
        else:
            for tag, a, b, c, d in difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes():
                at += [m.start() + (a + k if tag == "equal" else min(a + k, max(a, b - 1))) for k in range(d - c)]
        out.append(new)
    return _arabic("".join(out)), [*at, len(text)]


def select(text: str, lex: Lexicon, models: dict[str, Boosted]) -> list[tuple[int, int, str]]:
    """Disjoint spans (start, end, type) of the personal details of a prepared text."""
    rows = list(candidates(text, lex))
    if not rows:
        return []
    taken = [m.span() for m in _PLACEHOLDER.finditer(text)]
    scored = []
    for kind in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == kind]
        keys = [tuple(r[3]) for r in own]
        memo = models[kind].__dict__.setdefault("memo", {})
        new = [k for k in set(keys) if k not in memo]
        if new:
            memo.update(zip(new, models[kind].score(_matrix([list(k) for k in new]))))
        scored += [(memo[k], r[1], r[2], kind) for k, r in zip(keys, own) if memo[k] >= models[kind].threshold]
    rank = {"email": 0, "id_number": 1, "address": 2, "phone": 3, "person_name": 4}
    out: list[tuple[int, int, str]] = []
    for _p, a, b, kind in sorted(scored, key=lambda r: (rank[r[3]], -(r[2] - r[1]), -r[0], r[1])):
        if all(b <= x or a >= y for x, y in taken):
            taken.append((a, b))
            out.append((a, b, kind))
    return sorted(out)


def redact(text: str, lex: Lexicon, models: dict[str, Boosted]) -> tuple[str, list[str]]:
    """The text with typed placeholders, and the types replaced."""
    plain, at = aligned(text)
    spans = select(plain, lex, models)
    if not spans:
        return text, []
    out, end = [], 0
    for a, b, kind in spans:
        x, y = (a, b) if at is None else (at[a], at[b - 1] + 1)
        if x < end:
            continue
        out += [text[end:x], f"[{kind.upper()}]"]
        end = y
    return "".join([*out, text[end:]]), [k for *_, k in spans]


def redact_cells(rows: list, lex: Lexicon, models: dict[str, Boosted]) -> list:
    """A table's rows with placeholders for the details found in its joined cells; one over several cells stands in the first."""
    mark = f" {CELL} "
    cells = [c for r in rows if r is not None for c in r if c is not None]
    text = mark.join(cells)
    plain, at = aligned(text)
    spans = [((a, b) if at is None else (at[a], at[b - 1] + 1), kind) for a, b, kind in select(plain, lex, models)]
    if not spans:
        return rows
    done, start = [], 0
    for c in cells:
        out, end, stop = [], start, start + len(c)
        for (x, y), kind in spans:
            if y > end and x < stop:
                out += [text[end : max(end, x)], f"[{kind.upper()}]" if x >= start else ""]
                end = min(y, stop)
        done.append("".join([*out, text[end:stop]]))
        start = stop + len(mark)
    fresh = iter(done)
    return [None if r is None else [None if c is None else next(fresh) for c in r] for r in rows]


Model = tuple[Lexicon, dict[str, Boosted]]


def fitted(texts: DataFrame, lexicon: DataFrame, sample: int = SAMPLE) -> Model:
    """The lexicon (a parameter table of some hundred rows) and the models, trained on about ``sample`` of ``texts`` (one
    column, text): those whose hash falls into a share of it, so that every run takes the same."""
    lex = Lexicon(sorted((r["name"], r["kind"], r["script"] or "") for r in lexicon.where("name is not null").collect()))
    part = texts.where(F.pmod(F.xxhash64("text"), F.lit(max(1, texts.count() // sample))) == 0)

    def work(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for pdf in it:
            counts.update(e for t in pdf["text"] if t for e in examples(t, lex))
        yield pd.DataFrame([(k, "\t".join(f), y, h, n) for (k, f, y, h), n in counts.items()], columns=["kind", "features", "label", "held", "n"])

    # As many rows as there are sets of features.
    seen = part.select("text").mapInPandas(work, "kind string, features string, label int, held boolean, n long").groupBy("kind", "features", "label", "held").agg(F.sum("n").alias("n"))
    return lex, train_on({(r["kind"], tuple(f for f in r["features"].split("\t") if f), r["label"], r["held"]): r["n"] for r in seen.collect()})


def _joined_cells() -> Column:
    return F.array_join(F.flatten(F.filter("rows", lambda r: r.isNotNull())), f" {CELL} ")


def text_items(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """item_kind, item_id, text of text blocks and of table cells joined by CELL."""
    return (
        blocks.select(F.lit("block").alias("item_kind"), F.col("id").alias("item_id"), F.col("content").alias("text"))
        .unionByName(tables.select(F.lit("table").alias("item_kind"), F.col("id").alias("item_id"), _joined_cells().alias("text")))
        .where("text is not null and text <> ''")
    )


def found(items: DataFrame, lexicon: DataFrame, model: Model | None = None) -> DataFrame:
    """item_kind, item_id, pii_type of every type present. Without a ``model`` one is fitted on ``items``."""
    lex, models = model or fitted(items.select("text"), lexicon)

    def work(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = [(k, i, t) for k, i, text in zip(pdf["item_kind"], pdf["item_id"], pdf["text"]) for t in {s[2] for s in select(prepared(text), lex, models)}]
            yield pd.DataFrame(out, columns=["item_kind", "item_id", "pii_type"])

    return items.mapInPandas(work, "item_kind string, item_id string, pii_type string").distinct()


def redacted_texts(blocks: DataFrame, lexicon: DataFrame, model: Model | None = None) -> DataFrame:
    """``blocks`` (id, content) with redacted content and the types replaced."""
    lex, models = model or fitted(blocks.where("content is not null").select(F.col("content").alias("text")), lexicon)

    def work(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            done = [(None, []) if t is None else redact(t, lex, models) for t in pdf["content"]]
            yield pdf[["id"]].assign(redacted=[d[0] for d in done], types=[d[1] for d in done])

    return blocks.select("id", "content").mapInPandas(work, "id string, redacted string, types array<string>")


def redacted_tables(tables: DataFrame, lexicon: DataFrame, model: Model | None = None) -> DataFrame:
    """``tables`` (id, rows) with the details of their cells replaced, as ``found`` sees them."""
    lex, models = model or fitted(tables.where("rows is not null").select(_joined_cells().alias("text")), lexicon)

    def work(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pdf[["id"]].assign(redacted=[None if rows is None else redact_cells(rows, lex, models) for rows in pdf["rows"]])

    return tables.select("id", "rows").mapInPandas(work, "id string, redacted array<array<string>>")

"""Problem 2: cut oversized items at natural boundaries.

Separator hierarchy: section, paragraph, line, sentence, word, character. Parts are packed greedily: a part joins the piece
that is open if it fits, else it starts the next piece if it fits there behind the overlap, else it is divided at the next
level and its parts are packed alike. So a part is only divided where neither piece could hold it.

Each next piece starts ``overlap`` characters before the end of the one before, or up to SLACK more where that reaches the
beginning of a word or keeps a combined character whole. Pieces are spans of the text, so dropping each piece's overlap and
joining gives the text back.

Defined results: null text gives no piece; empty text and text within the limit give one piece; repeated rows repeat;
extra columns are kept, and ones named like an added column are replaced.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLACK = 24
LEVELS = (
    re.compile(r"\n(?=\s*(?:#{1,6} |\d+(?:\.\d+)*[.)] \S|\[[^\]\n]{2,40}\]$|[A-Z][A-Z \-/&]{8,}$))", re.M),  # section headings
    re.compile(r"\n[ \t]*\n+"),
    re.compile(r"\n"),
    re.compile(r"(?<=[.!?。ฯ])[\"')\]]*\s+"),
    re.compile(r"\s+"),
)


def _joined(text: str, i: int) -> bool:
    """Whether a cut before ``i`` would tear a combined character."""
    return 0 < i < len(text) and (unicodedata.category(text[i]) in ("Mn", "Me", "Mc", "Cf") or text[i - 1] == "‍" or text[i] == "ำ" or text[i - 1] in "เแโใไ")


def _beginning(text: str, end: int, overlap: int, slack: int) -> int:
    """Where the piece behind one that ends at ``end`` starts."""
    start = max(0, end - overlap)
    if not overlap:
        return start
    whole = None
    for i in range(start, max(0, start - slack) - 1, -1):
        if i == 0 or text[i - 1].isspace() and not text[i : i + 1].isspace():
            return i
        if whole is None and not _joined(text, i):
            whole = i
    return start if whole is None else whole


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of the pieces of ``text``, each of at most ``limit`` characters."""
    if limit < 1 or overlap < 0 or overlap >= limit:
        raise ValueError("need 0 <= overlap < limit")
    if len(text) <= limit:
        return [(0, len(text))]
    slack = min(SLACK, (limit - overlap) // 4)
    pieces: list[tuple[int, int]] = []
    start = end = 0  # the open piece

    def place(a: int, b: int, level: int) -> None:
        nonlocal start, end
        if b - start <= limit:
            end = b
            return
        following = _beginning(text, end, overlap, slack)
        if end > (pieces[-1][1] if pieces else 0) and following > start and b - following <= limit:
            pieces.append((start, end))
            start, end = following, b
            return
        if level < len(LEVELS):
            for m in LEVELS[level].finditer(text, a, b):
                if a < m.end() < b:
                    place(a, m.end(), level + 1)
                    a = m.end()
            place(a, b, level + 1)
            return
        while b - start > limit:
            cut, least = start + limit, max(end, start + overlap) + 1
            while cut > least and _joined(text, cut):
                cut -= 1
            if _joined(text, cut):
                cut = start + limit
            pieces.append((start, cut))
            start, end = _beginning(text, cut, overlap, slack), cut
        end = b

    place(0, len(text), 0)
    pieces.append((start, end))
    return pieces


def split_items(items: DataFrame, text: str = "content", limit: str = "max_chars", overlap: str = "overlap_chars") -> DataFrame:
    """One row per piece: the columns of ``items`` with ``text`` replaced by the piece, plus piece_no (from 1), n_pieces,
    piece_start and piece_end (code points). Only oversized texts are shipped to Python."""
    small = items.where(F.length(text) <= F.col(limit)).withColumns(
        {"piece_no": F.lit(1), "n_pieces": F.lit(1), "piece_start": F.lit(0), "piece_end": F.length(text)}
    )
    big = items.where(F.length(text) > F.col(limit))
    schema = small.schema

    def cut(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            spans = [split_text(t, int(a), int(b)) for t, a, b in zip(pdf[text], pdf[limit], pdf[overlap])]
            n = pd.Series([len(s) for s in spans])
            out = pdf.loc[pdf.index.repeat(n.to_numpy())].reset_index(drop=True)
            flat = [(k + 1, len(s), a, b, t[a:b]) for s, t in zip(spans, pdf[text]) for k, (a, b) in enumerate(s)]
            for i, c in enumerate(("piece_no", "n_pieces", "piece_start", "piece_end", text)):
                out[c] = [f[i] for f in flat]
            yield out[schema.names]

    return small.unionByName(big.mapInPandas(cut, schema))

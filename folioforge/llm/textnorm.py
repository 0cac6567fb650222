"""Problem 4: text that looks the same but is made of other characters.

Every letter of a token has a set of scripts it can be spelled in (its own and those of its look-alikes). The sets are
intersected over the token. If all its letters can be Latin, a token of several scripts is respelled in Latin. If not, the
script of most of its letters decides: in a Latin word every foreign letter counts as irregular and is respelled where some
Latin letter resembles it, exactly or in some fonts, and a word of another script gets its own letters for Latin look-alikes;
Latin words are never respelled in another script. A token of one script that could be spelled in Latin throughout is a
whole-script confusable: ``whole_script`` reports it, the text keeps it. A lone Greek letter that Latin lacks, at an end of a
word, is a sign (unit, angle). Width forms, ligatures, separate accents, invisible characters, blanks, split Thai vowels and
styled letters (mathematical alphabets, small capitals) are normalised around that.

Defined results: null text stays null with no forms; empty text is its own canonical form; very long texts are processed
whole; repeated rows give repeated results; extra columns are kept.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Look-alike letters of other scripts and the Latin letter each resembles (fixed values).
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορυχϲϳ", "ABEZHIKMNOPTYXaikvopuxcj"))
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХԌԚԜаеёѕіїјһорсухԁԛԝӏ", "ABESIJKMHOPCTYXGQWaeësiïjhopcyxdqwl"))
ARMENIAN = dict(zip("ՍՏՕօոսհցզյ", "USOonuhgqj"))
CHEROKEE = dict(zip("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏒᏔᏚᏞᏟᏢᏦ", "DRTAJEWMHGZRWSLCPK"))
TO_LATIN: dict[str, str] = GREEK | CYRILLIC | ARMENIAN | CHEROKEE
#: Letters that resemble a Latin one in some fonts or roughly (fixed values): used only inside words that are Latin otherwise.
NEAR = dict(zip("вгкмнптгЬьЗзЯяИиЛΠπηνωτκεΣΛΞ", "brkmhntrbb33RrNulnnnvwtkeEAE"))
SCRIPTS = ("LATIN", "GREEK", "CYRILLIC", "ARMENIAN", "CHEROKEE")
BLANKS = "\t   -   　"
INVISIBLE = "­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ"
ACCENTS = "̀-ͯ᪰-᫿᷀-᷿⃐-⃰"
LIGATURES = "ﬀ-ﬆﬓ-ﬗĲĳǄ-ǌǱ-ǳ"
WIDTH = "！-｠￠-￦｡-ﾟﾡ-ￜ"

#: Superset of everything that can need work; rows without a match never leave the JVM.
STYLE = "ᴀ-ᴢɑɡ\U0001d400-\U0001d7ff"
SUSPECT = f"[{BLANKS}{INVISIBLE}{ACCENTS}{LIGATURES}{WIDTH}{STYLE}Ͱ-ϿЀ-ԯ԰-֏Ꭰ-Ᏽ]|เเ|ํ[่-๋]?า|[่-๋]ํา"

#: The same test in the JVM, where a class of few ranges is much cheaper: any character outside plain ASCII, Thai, Latin-1
#: letters and signs and common punctuation, then the superset.
_RARE = "[^\n -~฀-๿¡-¬®-ıĴ-ƿǍ-ǰǴ-ɐɒ-ɠɢ-ʯ‐-‧‰-⁞]"
_SPLIT_THAI = "เเ|ํ[่-๋]?า|[่-๋]ํา"

_BLANK = re.compile(f"[{BLANKS}]")
_INVISIBLE = re.compile(f"[{INVISIBLE}]")
_STYLED = re.compile(f"[{STYLE}]")
_LIGATURE = re.compile(f"[{LIGATURES}]")
_WIDTH = re.compile(f"[{WIDTH}]+")
_ACCENTED = re.compile(f"[^\\W\\d_][{ACCENTS}]+")
_EMOJI = "©®‼⁉™ℹ←-⇿⌀-⏿①-⓿■-➿⤀-⥿⬀-⯿〰〽㊗㊙\U0001f000-\U0001faff"
_EMOJI_RUN = re.compile(f"(?:[{_EMOJI}]|[0-9#*](?=️?⃣))[︎️⃣]*(?:‍[{_EMOJI}]️?)*")
_OTHER = re.compile("[Ͱ-ϿЀ-ԯ԰-֏Ꭰ-Ᏽ]")
_LETTERS = "A-Za-zªºÀ-ÖØ-öø-ɏḀ-ỿͰ-Ͽἀ-῿Ѐ-ԯ԰-֏Ꭰ-Ᏽ"
_TOKEN = re.compile(f"[{_LETTERS}]+(?:(?:['’‐‑]|[-¬] ?\n?)[{_LETTERS}]+)*")
_THAI_AE = re.compile("เเ")
_THAI_AM = re.compile("ํ([่-๋]?)า|([่-๋])ํา")

_CLASS = re.compile(SUSPECT.split("|", 1)[0])


def needs(text: str) -> bool:
    """Whether a text may hold an irregular form; no false negatives."""
    if text.isascii():
        return "\t" in text
    return _CLASS.search(text) is not None or "เเ" in text or "ํ" in text


FORMS = ("width", "ligature", "accent", "invisible", "blank", "mixed_script", "split_thai", "styled")
CASES = FORMS[:-1]  # what TESTDATA.md counts as irregular; styled letters are normalised besides
RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("forms", T.ArrayType(T.StringType()))])


def script_of(c: str) -> str:
    n = ord(c)
    if n < 0x250 or 0x1E00 <= n < 0x1F00:
        return "LATIN"
    if 0x370 <= n < 0x400 or 0x1F00 <= n < 0x2000:
        return "GREEK"
    if 0x400 <= n < 0x530:
        return "CYRILLIC"
    return "ARMENIAN" if 0x530 <= n < 0x590 else "CHEROKEE"


_FROM_LATIN = {"GREEK": {}, "CYRILLIC": {}, "ARMENIAN": {}, "CHEROKEE": {}}
for _c, _l in TO_LATIN.items():
    _FROM_LATIN[script_of(_c)].setdefault(_l, _c)


def spellings(c: str) -> dict[str, str]:
    """Script -> letter that looks like ``c`` in it, its own script included."""
    own = script_of(c)
    latin = c if own == "LATIN" else TO_LATIN.get(c)
    out = {own: c}
    if latin:
        out["LATIN"] = latin
        for s, m in _FROM_LATIN.items():
            if s not in out and latin in m:
                out[s] = m[latin]
    return out


def plain_letter(c: str) -> str:
    """The letter behind a styled one: a mathematical alphabet's, a small capital's, the script a's or g's."""
    if c in "ɑɡ":
        return "ag"["ɑɡ".index(c)]
    new = unicodedata.normalize("NFKC", c)
    if new == c and (m := re.fullmatch(r"LATIN LETTER SMALL CAPITAL ([A-Z])", unicodedata.name(c, ""))):
        return m.group(1).lower()
    return new


def resolve_token(token: str) -> tuple[str, str | None]:
    """The token in one script, and 'mixed' (a Latin word with other letters), 'other' (a word of another script with foreign
    letters), 'whole' (another script's word that could be Latin) or None."""
    letters = [c for c in token if c.isalpha()]
    own = {script_of(c) for c in letters}
    if own == {"LATIN"}:
        return token, None
    sets = [spellings(c) for c in letters]
    common = set(sets[0]).intersection(*sets[1:])
    if len(own) == 1:
        return token, "whole" if "LATIN" in common else None
    if "LATIN" in common:
        return "".join(spellings(c)["LATIN"] if c.isalpha() else c for c in token), "mixed"
    latin = sum(script_of(c) == "LATIN" for c in letters)
    if 2 * latin > len(letters):
        foreign = [k for k, c in enumerate(token) if c.isalpha() and script_of(c) != "LATIN"]
        if len(foreign) == 1 and foreign[0] in (0, len(token) - 1) and script_of(token[foreign[0]]) == "GREEK" and token[foreign[0]] not in TO_LATIN:
            return token, None  # a sign: μmol, kWΩ
        return "".join(TO_LATIN.get(c, NEAR.get(c, c)) if k in foreign else c for k, c in enumerate(token)), "mixed"
    if not common:
        return token, None
    script = max(sorted(common), key=lambda s: sum(script_of(c) == s for c in letters))
    return "".join(spellings(c)[script] if c.isalpha() else c for c in token), "other"


def whole_script(text: str) -> list[str]:
    """The words of another script that could be spelled in Latin throughout, once each, in order."""
    if not _OTHER.search(text):
        return []
    words = dict.fromkeys(m.group() for m in _TOKEN.finditer(text) if _OTHER.search(m.group()))
    return [w for w in words if resolve_token(w)[1] == "whole"]


def canonical(text: str) -> tuple[str, list[str]]:
    """One consistent form of a text, and which of FORMS it held."""
    forms: set[str] = set()

    def note(form: str, new: str) -> str:
        forms.add(form)
        return new

    if _INVISIBLE.search(text):
        parts, at = [], 0
        for m in _EMOJI_RUN.finditer(text):
            parts += [_INVISIBLE.sub(lambda _: note("invisible", ""), text[at : m.start()]), m.group()]
            at = m.end()
        text = "".join([*parts, _INVISIBLE.sub(lambda _: note("invisible", ""), text[at:])])
    text = _BLANK.sub(lambda _: note("blank", " "), text)
    text = _WIDTH.sub(lambda m: note("width", unicodedata.normalize("NFKC", m.group())), text)
    text = _STYLED.sub(lambda m: note("styled", plain_letter(m.group())), text)
    text = _LIGATURE.sub(lambda m: note("ligature", unicodedata.normalize("NFKC", m.group())), text)

    def join(m: re.Match) -> str:
        new = unicodedata.normalize("NFC", m.group())
        return note("accent", new) if len(new) < len(m.group()) else m.group()

    text = _ACCENTED.sub(join, text)
    if _OTHER.search(text):

        def one(m: re.Match) -> str:
            if not _OTHER.search(m.group()):
                return m.group()
            new, kind = resolve_token(m.group())
            if kind == "mixed":
                forms.add("mixed_script")
            return new

        text = _TOKEN.sub(one, text)
    text = _THAI_AE.sub(lambda _: note("split_thai", "แ"), text)
    text = _THAI_AM.sub(lambda m: note("split_thai", (m.group(1) or m.group(2) or "") + "ำ"), text)
    return text, [f for f in FORMS if f in forms]


@F.pandas_udf(RESULT)
def _canonical(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in it:
        out = [(None, None) if x is None else canonical(x) for x in s]
        yield pd.DataFrame({"text": [a for a, _ in out], "forms": [b for _, b in out]})


def suspect(col: Column) -> Column:
    return (col.rlike(_RARE) & col.rlike(SUSPECT)) | col.rlike(_SPLIT_THAI)


def canonical_text(col: Column) -> Column:
    """The canonical text; only suspect texts are sent to Python."""
    return F.coalesce(_canonical(F.when(suspect(col), col))["text"], col)


def with_canonical(df: DataFrame, column: str, text: str = "canonical", forms: str = "forms") -> DataFrame:
    """``df`` with the canonical form of ``column`` and the list of irregular forms it held (empty when none)."""
    fixed = _canonical(F.when(suspect(F.col(column)), F.col(column)))
    tmp = "__canonical"
    return (
        df.withColumn(tmp, fixed)
        .withColumn(text, F.coalesce(F.col(f"{tmp}.text"), F.col(column)))
        .withColumn(forms, F.coalesce(F.col(f"{tmp}.forms"), F.array().cast("array<string>")))
        .drop(tmp)
    )


def irregular(df: DataFrame, column: str) -> DataFrame:
    """Only rows whose ``column`` holds an irregular form, with its canonical text. The suspect test runs in the scan,
    so regular rows are never shipped to Python."""
    fixed = df.where(suspect(F.col(column))).withColumn("__canonical", _canonical(F.col(column)))
    return fixed.withColumns({"canonical": F.col("__canonical.text"), "forms": F.col("__canonical.forms")}).drop("__canonical").where(F.arrays_overlap("forms", F.array(*map(F.lit, CASES))))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _whole_script(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in it:
        yield pd.Series([None if x is None else whole_script(x) for x in s])


def confusable_words(df: DataFrame, column: str) -> DataFrame:
    """``df`` where ``column`` holds whole-script confusables, with them as ``words``."""
    return df.where(F.col(column).rlike("[Ͱ-ϿЀ-ԯ԰-֏Ꭰ-Ᏽ]")).withColumn("words", _whole_script(F.col(column))).where(F.size("words") > 0)

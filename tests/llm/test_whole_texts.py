import itertools
import random

from folioforge.llm.neardup import copy_groups, copy_pairs, text_sketches
from folioforge.llm.reading import features, is_english
from folioforge.llm.scans import defects, repaired


def test_p1_pairs_of_wide_buckets(spark):
    """Half of every text is one boilerplate, so all meet in buckets of many components; pairs that just reach the
    threshold through twelve further runs must still be linked, and no others."""
    rng = random.Random(3)
    new = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    hot, texts = new(52), {}
    for k in range(200):
        common = new(10)
        for side in "ab":
            texts[f"c{k:03d}{side}"] = hot + common + new(40)
    runs = {i: set(zip(w, w[1:], w[2:])) for i, w in texts.items()}
    want = {(a, b) for a, b in itertools.combinations(sorted(texts), 2) if len(runs[a] & runs[b]) >= 0.55 * max(len(runs[a]), len(runs[b]))}
    assert want == {(f"c{k:03d}a", f"c{k:03d}b") for k in range(200)}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "id string, content string")
    got = {(r.id_a, r.id_b) for r in copy_pairs(copy_groups(text_sketches(df, "chunk"), {"chunk": 0.55})).collect()}
    assert got == want


def test_p5_running_lines_on_few_pages(spark):
    """A running line on three of ten pages, and one that ends in a reference beside which a page number may stand."""
    few = {2: "Minutes of the yard", 6: "Minutes of the yard", 9: "Minutes of the yard"}
    lines = {("few", p): few.get(p, f"Opening {chr(96 + p) * 5} words") for p in range(1, 11)}
    lines |= {("ref", p): "Annex of the filter AR-7524" if p in (1, 4, 8, 9) else f"{p} | Annex of the filter AR-7524" for p in range(1, 12)}
    lines |= {("two", p): "Kept on two" if p < 3 else f"Other {chr(96 + p) * 5} words" for p in range(1, 11)}
    lines |= {(d, p): f"{d} {chr(96 + p) * 5} words" for d in ("big", "oth") for p in range(1, 11)}
    ends = {(d, p): f"\nSee overleaf\nPage {p}" for d, ps in (("big", (2, 5, 7)), ("oth", (4,))) for p in ps}  # recurs, but not as a running line
    rows = [(f"{d}{p:02d}", d, p, f"{x}\n{chr(96 + p) * 6} is said here\nand {chr(96 + p) * 7} ends it{ends.get((d, p), '')}", {"extractor": "ocr"}) for (d, p), x in lines.items()]
    df = spark.createDataFrame(rows, "id string, doc_id string, page int, content string, extra map<string,string>")
    got = {r.block_id for r in defects(df).where("defect = 'header'").collect()}
    assert got == {f"few{p:02d}" for p in few} | {f"ref{p:02d}" for p in range(1, 12)}
    text = {r.id: r.repaired for r in repaired(df).collect()}
    assert not any("Minutes" in t or "Annex" in t for t in text.values()) and "Kept on two" in text["two01"]


def test_p9_nominal_english():
    """English without function words; running text of other languages in Latin letters stays out."""
    english = (
        "Without promulgation, disproportionate consideration corroborates discretionary miscalculation. Unconditional documentation incorporates irrevocability.",
        "Comprehensive amortisation exacerbates authentication; obligation exacerbates contemporaneous recapitalisation.",
    )
    other = (
        "La documentation administrative présente une évaluation considérable des conditions générales, notamment la validation obligatoire du règlement et son application.",
        "Die Dokumentation der Organisation enthält wichtige Informationen über Produktion, Kommunikation und Installation dieser Anlage.",
        "La administración presenta una evaluación general del reglamento vigente sobre importación, exportación y distribución.",
        "Dokumentasi administrasi menjelaskan informasi organisasi.",
    )
    assert all(is_english(t, features(t)) for t in english)
    assert not any(is_english(t, features(t)) for t in other)

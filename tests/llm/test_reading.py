import random

import numpy as np
from pyspark.sql import functions as F

from folioforge.llm.reading import is_english, features, reading_levels, thresholds

PLAIN, MID, HARD = "the cat has a red cup and we see it".split(), "the department shall return the corrected delivery to the office".split(), "the contemporaneous instrumentation circumscribes irrevocable commensurability of the adjudication".split()


def _docs(n=90):
    rng = random.Random(4)
    out = []
    for k in range(n):
        words = (PLAIN, MID, HARD)[k % 3]
        out.append((k, ". ".join(" ".join(rng.sample(words, 6)) for _ in range(6)) + "."))
    return out


def test_levels(spark):
    docs = _docs()
    names = ("plain", "standard", "demanding")
    labels = spark.createDataFrame([(k, "r", names[k % 3]) for k in range(30)] + [(0, "r2", "Plain "), (999, "r", "plain"), (3, "r", None)], "doc_id long, rater string, level string")
    df = spark.createDataFrame([*docs, docs[0], (500, None), (501, ""), (502, "ภาษาไทยล้วน"), (503, "Der Hund läuft über den großen Platz und bellt laut")], "doc_id long, text string").withColumn("grade", F.lit(1))
    got = reading_levels(df, labels).collect()
    level = {r.doc_id: r.level for r in got}
    assert len(got) == 91 and set(level) == set(range(90))
    assert all(level[k] == names[k % 3] for k in level)
    assert reading_levels(df, labels.limit(0)).where("level is not null").count() == 0
    assert reading_levels(df.limit(0), labels).count() == 0




def test_language_and_thresholds():
    assert is_english("the cat is in the box", features("the cat is in the box"))
    assert not is_english("ปฏิทิน of", features("ปฏิทิน of")) and not is_english("", features(""))
    cuts = thresholds(np.array([0.1, 0.2, 0.5, 0.55, 0.9, 1.0]), np.array([0, 0, 1, 1, 2, 2.0]))
    assert 0.2 < cuts[0] < 0.5 and 0.55 < cuts[1] < 0.9

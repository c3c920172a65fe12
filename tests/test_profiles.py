"""Trigram profiles against a literal count, and how many rows their training makes."""

import re
from collections import Counter

from newsloom.operators import language

TEXTS = [
    ("da", "Rød grød med fløde, RØD grød!\n\nOg én ting til: x"), ("da", "Ål i å_å, a1b2c; _ikke_"), ("da", ""), ("da", None), ("da", "…  - 12 _"),
    ("en", "The cat sat on the mat. The CAT's hat."), ("en", "naïve \U0001d4d0\U0001d4d1c 中文字 ﬁ Straße İstanbul"), (None, "uden sprog"),
]


def _model(texts):
    counts = Counter()
    for code, body in texts:
        words = re.findall(r"[^\W\d_]+", body or "")
        counts.update((code, f"_{w}_"[i : i + 3]) for w in words for i in range(len(w)))
    return counts


def test_profiles_against_a_literal_count(spark, monkeypatch):
    df = spark.createDataFrame(TEXTS, "lang string, text string").repartition(3)
    lowered = [(r["lang"], r["low"]) for r in df.selectExpr("lang", "lower(text) as low").collect()]
    counts = _model(lowered)
    want = {}
    for code in {c for c, _ in counts}:
        ranked = sorted((g for c, g in counts if c == code), key=lambda g: (-counts[code, g], g.encode()))
        want |= {(code, g): 12 - i for i, g in enumerate(ranked[:12])}
    got = language.train_profiles(df, "text", "lang", 12).collect()
    assert {(r["language"], r["gram"]): r["weight"] for r in got} == want


def test_a_long_text_is_counted_in_parts(monkeypatch):
    body = "_".join(w for _, t in TEXTS for w in re.findall(r"[^\W\d_]+", (t or "").lower()))
    whole = Counter(f"_{w}_"[i : i + 3] for w in body.split("_") for i in range(len(w)))
    for step in (1, 2, 7, 1 << 20):
        monkeypatch.setattr(language, "_STEP", step)
        found = Counter()
        for gram, n in language._gram_counts(body):
            found[gram] += n
        assert found == whole


def test_training_makes_no_row_of_an_occurrence(spark, capsys):
    df = spark.createDataFrame(TEXTS, "lang string, text string")
    language.train_profiles(df, "text", "lang").explain()
    assert "Generate" not in capsys.readouterr().out

from collections import Counter

import corpus_pipeline as P
from test_ngram_join import brute, corpus

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, language string, copies int, kept string, id int"


def test_stages(spark):
    rows = corpus(9, [(2, 1), (15, 3), (4, 2)])
    rows = rows + [(d + 1, t) for d, t in rows[:20]] + [(7001, None), (7002, ""), (7003, "12 34"), (None, "alone without a number at all")]
    table = [(d, t, "en" if t and len(t) % 2 else "xx", f"s{(d or 0) % 4}" if (d or 0) % 5 else None, 1, "l", 2, "k", 3) for d, t in rows]
    docs = spark.createDataFrame(table, SCHEMA)
    columns, seen = docs.columns, {}
    for name, stage in P.STAGES:
        docs = P.cut_lineage(stage(spark, docs, ""))
        seen[name] = docs.collect()
        assert name == P.STAGES[-1][0] or docs.columns == columns
    texts = {d: t for d, t in rows}
    first = [r.doc_id for r in seen["language_id"]]
    assert not {7001, 7002, 7003} & set(first) and None in first
    second = [r.doc_id for r in seen["exact_dedup"]]
    last_of = {}
    for d in first:
        last_of[texts[d]] = max(last_of.get(texts[d], -1), d if d is not None else -1)
    assert sorted(str(d) for d in second) == sorted(str(None if d == -1 else d) for d in last_of.values())
    third = {r.doc_id for r in seen["ngram_join"]}
    roots = {d for d, _, root in brute([(d, texts[d]) for d in second]) if d == root}
    assert {str(d) for d in third} == roots
    copies = Counter(r.doc_id for r in seen["mix_sources"])
    assert set(copies) <= third and max(copies.values()) <= 3
    assert Counter(r.doc_id for r in seen["byte_bpe"]) == copies


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in P.STAGES:
        docs = P.cut_lineage(stage(spark, docs, ""))
    assert docs.count() == 0

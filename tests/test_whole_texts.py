"""Queries without an SQL twin read whole titles and texts."""

import pytest

from newsloom import catalog

HEAD = "alpha beta gamma delta epsilon " + "zeta " * 20
ROWS = [
    (3, HEAD + "apples pears plums " * 30, "en", "a"),
    (10, HEAD + "iron copper tin lead zinc " * 30, "en", "a"),
    (13, "Some other words here at last\n" + "x " * 300 + "the ships with all of the cargo", "en", "b"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(3, 1)], "doc_id bigint, quality bigint").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, HEAD + "gold silver platinum osmium iridium " * 30)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_titles_that_differ_behind_120_characters(spark, folder):
    kept = {r.mention_id: r.title for r in catalog.queries()["near_dedup"](spark, folder).collect()}
    assert kept == {d: t.split("\n")[0] for d, t, *_ in ROWS}
    assert {r.mention_id for r in catalog.queries()["historical_anti_join"](spark, folder).collect()} >= {10, 13}
    counts = {r.stage: r.removed for r in catalog.queries()["ingest_stage_counts"](spark, folder).collect()}
    assert set(counts.values()) == {0}


def test_keywords_behind_500_characters(spark, folder):
    stored = catalog.queries()["ingest_rows_to_store"](spark, folder).collect()
    assert [(r.seq, r.topic_id) for r in stored] == [(13, 1)]


def test_history_judges_new_documents_of_all_ids(spark, folder):
    stored = catalog.queries()["historical_anti_join"](spark, folder).collect()
    assert sorted(r.mention_id for r in stored) == [10, 13]

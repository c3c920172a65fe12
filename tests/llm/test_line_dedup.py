from collections import Counter

from pyspark.sql import functions as F

from newsloom.llm.line_dedup import drop_lines

SCHEMA = "doc_id bigint, text string, source string, n_lines string, digests string, site string, host_x string"


def expected(rows, ratio, least):
    pages = Counter(s for _, _, s in rows)
    on = Counter((s, line) for _, t, s in rows for line in set((t or "").split("\n")) if line.strip(" "))
    result = []
    for doc_id, text, source in rows:
        lines = [] if text is None else text.split("\n")
        kept = [x for x in lines if not (on[source, x] >= least and on[source, x] > ratio * pages[source])]
        result.append((str(doc_id), None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(result, key=str)


def test_against_brute_force(spark):
    rows = [(i, f"own {i}\nfoot\n\n{'rare' if i < 3 else 'own'}\nfoot", "hot") for i in range(60)]
    rows += [(100 + i, f"foot\nhead {i % 2}\nx" * (1 + i % 3), f"s{i % 4}") for i in range(20)]
    rows += [(200, None, "hot"), (201, "", "hot"), (None, "foot\n \nz", None), (202, "foot", None), (203, "foot\r\nfoot", None), (203, "foot", None), (204, "solo", "one"), (205, "long " * 50_000 + "\nfoot", "hot")]
    df = spark.createDataFrame([(*r, "n", "d", "s", "h") for r in rows], SCHEMA)
    for ratio, least in ((0.02, 3), (0.3, 2), (0.9, 1)):
        got = drop_lines(df, F.col("source"), "text", ratio, least)
        assert got.columns == ["doc_id", "source", "digests", "site", "host_x", "text", "n_lines", "n_dropped"]
        assert sorted(((str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=str) == expected(rows, ratio, least)
    assert drop_lines(df.limit(0), F.col("source"), "text").count() == 0


def test_a_column_of_the_name_used_inside(spark):
    df = spark.createDataFrame([(i, "foot\nown" + str(i), "s", "mine") for i in range(4)], "doc_id bigint, text string, source string, host_ string")
    assert {(r.text, r.host_, r.n_dropped) for r in drop_lines(df, F.col("source"), "text").collect()} == {(f"own{i}", "mine", 1) for i in range(4)}

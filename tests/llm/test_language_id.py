from newsloom.llm.language_id import fit, identify, subwords

SCHEMA = "doc_id bigint, text string, lang string, score string, rejected int"


def test_cases(spark):
    words = {"x": "alpha beta gamma delta", "y": "uno dos tres quatro", "z": "ett tva tre fyra"}
    rows = [(i, " ".join([words[k]] * (1 + i % 5)), k) for i in range(90) for k in [list(words)[i % 3]]]
    rows += [(100, None, "x"), (101, "", "y"), (102, "123 !?", "z"), (None, "alpha beta", None), (103, "UNO DOS", None), (104, "tva " * 200_000, None), (104, "tva", None)]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], SCHEMA)
    got = {}
    for r in identify(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    assert all(got[i][0].lang_pred == "xyz"[i % 3] and not got[i][0].rejected for i in range(90))
    for i in (100, 101, 102):
        assert (got[i][0].lang_pred, got[i][0].score, got[i][0].rejected) == ("und", 0.0, True)
    assert got[None][0].lang_pred == "x" and got[None][0].held_out is False
    assert got[103][0].lang_pred == "y" and {r.lang_pred for r in got[104]} == {"z"}


def test_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "some text", None, "s", 1)], SCHEMA)
    assert [(r.lang_pred, r.score) for r in identify(df).collect()] == [("und", 0.0)]
    assert identify(spark.createDataFrame([], SCHEMA)).count() == 0


def test_never_learns_from_held_out_rows(spark):
    import zlib

    out = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2][:5]
    df = spark.createDataFrame([(i, "only held out", "q", "s", 1) for i in out], SCHEMA)
    assert fit(df).languages == []


def test_subwords():
    assert len(subwords(None)) == len(subwords("12 3")) == 0
    assert subwords("Ab, c!").tolist() == subwords("ab C").tolist()

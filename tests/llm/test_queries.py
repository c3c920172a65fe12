"""Registered queries against their SQL twins, or against what another library makes of the same tables."""

import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from check_oracle import compare, connect
from newsloom.llm import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_twin(spark, name):
    assert compare(catalog.queries()[name](spark, FOLDER), connect(FOLDER), catalog.oracle_sql()[name]) is None


@pytest.fixture(scope="module")
def documents():
    rows = duckdb.sql(f"SELECT doc_id, text, lang FROM '{FOLDER}/documents.parquet' ORDER BY doc_id").fetchall()
    return [(d, t or "", lang) for d, t, lang in rows]


def test_byte_bpe(spark, documents):
    from newsloom.llm.byte_bpe import coder

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = coder(path, public_tokenizers.PATTERN)[0].ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in catalog.queries()["op7_byte_bpe"](spark, FOLDER).collect()}
    assert len(got) == len(documents)
    for doc_id, text, _ in documents:
        ids = np.array(library.encode_ordinary(text), "<u4")
        row = got[doc_id]
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_token_output(spark, documents):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got, start = {r.doc_id: r for r in catalog.queries()["op9_token_output"](spark, FOLDER).collect()}, 0
    for doc_id, text, _ in documents:
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert (got[doc_id].start, got[doc_id].n_tokens, got[doc_id].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_language_accuracy(spark, documents):
    truth = {d: lang for d, _, lang in documents}
    rows = catalog.queries()["op8_language_id"](spark, FOLDER).collect()
    assert {r.doc_id for r in rows if r.held_out} == {d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2}
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_html(spark):
    import html
    import re

    pages = dict(duckdb.sql(f"SELECT page_id, html FROM '{FOLDER}/pages.parquet'").fetchall())
    for row in catalog.queries()["op3_html_text"](spark, FOLDER).collect():
        inside = re.search(r"<article>(.*?)</article>", pages[row.page_id], re.S)[1]
        text = html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", inside)))
        assert row.text == " ".join(text.split()) and row.n_chars == len(row.text)

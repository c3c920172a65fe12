import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer, normalizers

from newsloom.llm import pieces, token_output as T
from newsloom.llm.byte_bpe import coder, encode_decode

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PARTS = ["a", " ", "  ", "\n", "\t", "'s", "é", "1", "!", " \n", "\x1c", "\x85", "\xa0", "<|endoftext|>", "　", " b", "word.", "ß,", "'ll", "࢏", "\U0001e6c0", "日本"]


def texts(count):
    rand = random.Random(5)
    yield from ("ab" * 5000, "".join(rand.choices("abcdefgh", k=9000)), "é" * 700, "x" * 129, "", " ", "\n ")
    for _ in range(count):
        yield "".join(rand.choices(PARTS, k=rand.randint(0, 9)))


def test_bpe_is_the_library(spark):
    bpe, runs = coder(PATH, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    for text in texts(4000):
        ids = runs.encode([text])[0]
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), repr(text)
        assert bpe.decode(ids) == text.encode()


def test_tokenizer_runs(spark):
    encode, _ = T._coder(public_tokenizers.path("byte_bpe_50k.json"))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in [*texts(4000), "hello <|endoftext|> x", "a<|endoftext|>", "<|endoftext|><|endoftext|>", "<|endoftext| >"]:
        assert np.frombuffer(encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    assert np.frombuffer(encode(["hello <|endoftext|> x"])[0], "<u4").tolist() == [31373, 220, 50256, 2124]


def test_forgetting_keeps_ids_right():
    _, runs = coder(PATH, public_tokenizers.PATTERN)
    most, runs.most = runs.most, 3
    try:
        plain = [runs.encode([t])[0] for t in ("one two three four", "two five six", "one two")]
        assert plain == [runs.encode([t])[0] for t in ("one two three four", "two five six", "one two")]
    finally:
        runs.most = most


@given(st.integers(1, 31), st.lists(st.integers(0, 2**31 - 1), max_size=40))
@settings(max_examples=80, deadline=None)
def test_packing(bits, values):
    ids = np.array([v % (1 << bits) for v in values], np.uint32)
    data = T.packed(ids, bits)
    assert len(data) == -(-len(ids) * bits // 8) and T.unpacked(data, len(ids), bits).tolist() == ids.tolist()


def test_shard_random_access():
    rand = np.random.default_rng(1)
    ids = [rand.integers(0, 50257, n).astype(np.uint32) for n in (3, 0, 9000, 1, 4096)]
    shard = T.Shard(T.write_shard([5, None, 6, 6, 7], ids, 16))
    assert shard.doc_ids == [5, None, 6, 6, 7]
    assert [shard.document(k).tolist() for k in range(5)] == [i.tolist() for i in ids]
    assert shard.ids(4000, 9500).tolist() == np.concatenate(ids)[4000:9500].tolist()
    assert T.Shard(T.write_shard([], [], 16)).ids(0, 0).tolist() == []


SCHEMA = "doc_id bigint, text string, ids string, n_tokens int"


def test_written_and_read(spark, tmp_path):
    rows = [(3, "b c", "", 1), (1, None, "", 1), (None, "n", "", 1), (2, "", "", 1), (3, "a", "", 1), (3, "a", "", 1)]
    T.write_ids(spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/ids", public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted(T.read_ids(spark, f"{tmp_path}/ids").collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(None, 0, 2), (1, 2, 1), (2, 3, 1), (3, 4, 2), (3, 6, 2), (3, 8, 3)]
    T.write_ids(spark.createDataFrame([], SCHEMA), f"{tmp_path}/none", public_tokenizers.path("byte_bpe_50k.json"))
    assert T.read_ids(spark, f"{tmp_path}/none").count() == 0
    coded = encode_decode(spark.createDataFrame(rows, SCHEMA), PATH)
    assert sorted(r.n_tokens for r in coded.collect()) == [0, 0, 1, 1, 1, 2]


def test_pieces_are_the_library():
    """Whole batches, with steps that end anywhere and little memory: as the library on each text."""
    library, rand = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), random.Random(7)
    parts = [*PARTS, "×", "÷", "'", "’", "\n\n", "\r\n", "<|", " ", "ж", "क", "́", "😀", "²", "\x00", "x\n", "'re", *"\u1680\u180e\u2000\u200b\u2014\u201d\u2028\u202f\u205f\u20ac\u3000\u3002\u1ec3\ufeff", None]
    made = ["".join(p or "" for p in rand.choices(parts, k=rand.randint(0, 12))) for _ in range(2000)]
    texts = [*made, None, "one\ntwo.\n\nthree|four " * 900, "日本" * 3000, "a<|endoftext|>b c " * 50]
    wanted = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for step, most in ((1 << 20, 300_000), (50, 5), (3, 300_000)):
        coder, before = pieces.PieceCoder(library, most), pieces.STEP_BYTES
        pieces.STEP_BYTES = step
        try:
            got = coder.encode(pa.array(["left out", *texts]).slice(1))
        finally:
            pieces.STEP_BYTES = before
        assert [np.frombuffer(ids, "<u4").tolist() for ids in got] == wanted
    assert coder.encode(pa.array([], pa.string())) == [] and coder.encode(pa.array([None, ""])) == [b"", b""]


def test_pieces_meet_the_library_once():
    """A word behind a space is asked for once, whatever mark or line end stands beside it."""
    coder, asked = pieces.PieceCoder(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))), []
    for name in ("_by_model", "_by_library"):
        plain = getattr(coder, name)
        setattr(coder, name, lambda runs, plain=plain: asked.extend(runs) or plain(runs))
    coder.encode(pa.array([" word word, word.\nword word|word 12 word!"]))
    coder.encode(pa.array([" word; word"]))
    assert sorted(asked) == sorted([b" word", b"word", b",", b".", b"\n", b"|", b" 12", b"!", b";"])
    asked.clear()
    coder.encode(pa.array([" th\u1ec3 \u0436\u0443 th\u1ec3 \u0436\u0443 \u2014 th\u1ec3\u3000th\u1ec3"]))
    assert sorted(map(bytes.decode, asked)) == sorted([" th\u1ec3", " \u0436\u0443", " \u2014", " th\u1ec3\u3000th\u1ec3"])


def test_other_tokenizers_encode_whole_texts():
    """Where the tokenizer does not split as byte-level ones do, or lower-cases, nothing is cut."""
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.normalizer = normalizers.Lowercase()
    texts = ["Some Text, here", "ÀÉ"]
    got = pieces.PieceCoder(library).encode(pa.array(texts))
    assert [np.frombuffer(i, "<u4").tolist() for i in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]

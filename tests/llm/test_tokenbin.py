import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import pfor, tokenbin
from quire.llm.common import scratch_path

from conftest_rows import texts


def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenbin.tokenizer_path())


def brute(rows):
    tok, out, start = plain(), [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        out.append((i, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=400), st.integers(1, 64))
def test_round_trip(values, block):
    ids = np.asarray(values, np.uint32)
    cut = len(ids) // 3
    chunk = pfor.Chunk(memoryview(pfor.encode_chunk([5, None], [cut, len(ids) - cut], ids, block)))
    assert (chunk.ids() == ids).all()
    assert (chunk.document(1, block) == ids[cut:]).all() and chunk.docs["null"].tolist() == [0, 1]


def test_outliers_become_exceptions():
    ids = np.asarray([7] * 2000 + [4_000_000_000], np.uint32)
    data = pfor.encode_block(ids)
    assert len(data) < 40 and (pfor.decode_block(memoryview(data), 0) == ids).all()


PIECES = ["foo", "bar,", "x.\ny", "", " ", "\n", "\t", "é́", "don't", "it's.", "3.5", "<|endoftext|>", " ", "a\x1cb", "²", "١", "!!", "end."]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=9), min_size=1, max_size=4))
def test_pieces_agree_with_the_library(rows):
    joined = [" ".join(r) for r in rows]
    encoder = ENCODER.setdefault("e", None) or ENCODER.__setitem__("e", tokenbin.PieceEncoder(open(tokenbin.tokenizer_path()).read(), 6)) or ENCODER["e"]
    tok = encoder.tokenizer
    assert [x.tolist() for x in encoder.encode(joined)] == [tok.encode(t, add_special_tokens=False).ids for t in joined]


ENCODER = {}


def test_query_equals_the_library(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in tokenbin.op8_token_binary(spark, tiny).collect())
    assert got == brute([(r.doc_id, r.text) for r in docs])


def test_odd_rows(spark, odd):
    path = scratch_path(spark, "test-tokens")
    tokenbin.write_tokens(odd, path)
    got = sorted((tuple(r) for r in tokenbin.read_tokens(spark, path).collect()), key=lambda r: r[1])
    assert got == brute(texts())


def test_empty_table(spark, none):
    path = scratch_path(spark, "test-tokens")
    tokenbin.write_tokens(none, path)
    assert tokenbin.read_tokens(spark, path).collect() == []

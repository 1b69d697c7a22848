import zlib
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fathom.llm import packing, token_files, tokens
from fathom.llm.common import new_path

DOCS = [(5, "Hello, world! It's 3 o'clock"), (1, None), (3, ""), (2, "naïve Straße É×÷ “q”. a̸≠ <|endoftext|> X"), (9, "word " * 5000), (None, "no id"), (5, "again"), (7, "\n\t "), (8, "'sword 're x's.'s (a)b--c… d")]
SCHEMA = "doc_id long, text string"


@cache
def loaded():
    return Tokenizer.from_file(tokens.vocabulary())


def library(text):
    return [*loaded().encode(text or "", add_special_tokens=False).ids, 2]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aZé×'s.,!<|> \n\t0Σς̸́-_"), st.characters(codec="utf-8")), max_size=40), max_size=6))
def test_encoding_is_the_librarys(texts):
    ids, n = tokens.encode(texts, tokens.vocabulary())
    ends = np.cumsum(n)
    assert [ids[e - k : e].tolist() for e, k in zip(ends, n, strict=True)] == [library(t) for t in texts]


@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_ranks_round_trip(values):
    control, data = token_files.pack_ranks(np.array(values, dtype=np.uint32))
    assert token_files.unpack_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(values)).tolist() == values
    assert len(data) == sum(max(1, (v.bit_length() + 7) // 8) for v in values)


def test_packing_brute(spark, clashing):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    got = packing.sequences(packing.pieces(clashing(docs))).collect()
    ids = sorted((str(i), library(t)) for i, t in DOCS)
    want = sorted((i, x[s : s + k]) for i, x in ids for s, k in _cuts(len(x)))
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want
    assert sorted(r.sequence_id for r in got) == list(range(len(got)))
    assert [r.length for r in sorted(got, key=lambda r: r.sequence_id)] == sorted((r.length for r in got), reverse=True)
    assert packing.sequences(packing.pieces(docs.limit(0))).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        packing.pieces(docs, max_len=100)


def _cuts(n, most=4096):
    out, at = [], 0
    while at < n:
        k = most
        while k > n - at:
            k //= 2
        out.append((at, k))
        at += k
    return out


def test_token_files_round_trip(spark, clashing):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    path = new_path(spark, "t")
    token_files.write_token_files(clashing(docs), path, ids_per_file=40)
    got = token_files.with_starts(token_files.read_token_files(spark, path)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 5, 5, 7, 8, 9]
    assert len({r.file for r in got}) > 1
    at = 0
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert r.start == at and r.n_tokens == len(ids)
        at += len(ids)
    assert sorted(zlib.crc32(r.ids) for r in got) == sorted(zlib.crc32(np.array(library(t), "<u4").tobytes()) for _, t in DOCS)
    empty = new_path(spark, "t")
    token_files.write_token_files(docs.limit(0), empty)
    assert token_files.with_starts(token_files.read_token_files(spark, empty)).count() == 0


def test_token_files_of_few_parts(spark):
    """Three range partitions that write more than twenty files: their order is that of the documents."""
    rows = [(i, f"word{i} " * (i % 7 + 1)) for i in range(120)]
    path = new_path(spark, "t")
    token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), path, ids_per_file=30, most_parts=3)
    got = token_files.with_starts(token_files.read_token_files(spark, path)).orderBy("start").collect()
    assert [r.doc_id for r in got] == list(range(120))
    files = {r.file for r in got}
    assert len(files) > 20 and len({f[:7] for f in files}) <= 3
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))

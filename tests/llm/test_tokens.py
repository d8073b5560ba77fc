"""Byte-level BPE against the library on uncut text, and round trips."""
import array
import hashlib

import public_tokenizers as public
import pytest
from hypothesis import given, settings, strategies as st

from trialweave.llm import byte_bpe, catalogue

PATH = public.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def enc():
    return byte_bpe.encoding(PATH, public.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aZ09 '\n\t.!sl%é漢́\x85\x1c"), st.characters(
    exclude_categories=["Cs"])), max_size=200))
def test_cutting_changes_nothing(text):
    enc = byte_bpe.encoding(PATH, public.PATTERN)
    whole = enc.encode_ordinary(text)
    assert byte_bpe.encode(enc, text, size=7) == whole
    assert enc.decode_bytes(whole) == text.encode()


@pytest.mark.parametrize("unit", [" ", "^", "a", "7", "é", "'", "ab1 ", "a'", "\n"])
def test_unbroken_runs(enc, unit):
    text = unit * 9001 + "end"
    assert byte_bpe.encode(enc, text, size=64) == enc.encode_ordinary(text)


def test_a_run_that_the_library_alone_cannot_take(enc):
    ids = byte_bpe.encode(enc, "x" + " " * 1_200_000 + "y")
    assert enc.decode_bytes(ids) == b"x" + b" " * 1_200_000 + b"y"


def test_documents(spark, docs, empty, pairs, enc):
    got = byte_bpe.encode_documents(docs, PATH, public.PATTERN)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], bytes(r["ids"]), bytes(r["decoded"]))
                  for r in got.collect()) == sorted(
        (i is None, i or 0, len(ids), array.array("I", ids).tobytes(), t.encode())
        for i, t in pairs for ids in [enc.encode_ordinary(t)])
    back = byte_bpe.decode_documents(got, PATH, public.PATTERN)
    assert sorted(bytes(r["decoded"]) for r in back.collect()) == sorted(
        t.encode() for _, t in pairs)
    assert byte_bpe.encode_documents(empty, PATH, public.PATTERN).count() == 0


def test_query(spark, enc):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {r["doc_id"]: (len(ids), hashlib.sha256(array.array("I", ids).tobytes()).hexdigest(),
                          hashlib.sha256(r["text"].encode()).hexdigest())
            for r in rows for ids in [enc.encode_ordinary(r["text"])]}
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"])
           for r in catalogue.op4_byte_bpe(spark, sf).collect()}
    assert got == want

"""Encoding and decoding against the tokenizers library."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaspan.llm import bpe
from mediaspan.llm.queries import LIBRARY_TOKENIZER, queries
from mediaspan.llm.tokens import vocabulary

FOLDER = "/root/testdata/sf0.001"
TEXTS = [None, "", " ", "\n\n  x \t", "it's 'S they'll 12 345!", "a<|endoftext|> b<|endoftext|>", "日本語 ß ÀÉ", "a" * 3000, "ab " * 3000, "\x1c \x85 　x", "x" + " " * 999, "<|endoftext", "\U0001f600‍\U0001f600"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(LIBRARY_TOKENIZER))


def test_every_character_beside_letters_digits_and_blanks(library):
    known = bpe.load(LIBRARY_TOKENIZER)
    for at in [*range(0xD800), *range(0xE000, 0x110000, 13)]:
        c = chr(at)
        text = f"a{c}a {c}1{c} {c}{c}b"
        assert bpe.unpack(known.encode(text, True)) == library.encode(text, add_special_tokens=False).ids, hex(at)


@pytest.mark.parametrize("size", [5, 1 << 19])
def test_slices_change_nothing(library, monkeypatch, size):
    monkeypatch.setattr(bpe, "SLICE", size)
    known = bpe.load(LIBRARY_TOKENIZER)
    for text in filter(None, TEXTS):
        assert bpe.unpack(known.encode(text, True)) == library.encode(text, add_special_tokens=False).ids


def test_memory_of_words_is_bounded(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 3)
    known = bpe.Vocabulary(vocabulary(LIBRARY_TOKENIZER))
    text = " ".join(f"word{n}" for n in range(50))
    assert bpe.unpack(known.encode(text, True)) == library.encode(text, add_special_tokens=False).ids
    assert len(known) <= 3


def test_odd_rows_and_clashing_columns(spark, library):
    rows = [(n % 11, t, "k", [1]) for n, t in enumerate(TEXTS)] + [(None, "null id", None, None), (5, TEXTS[5], "k", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, ids array<int>")
    coded = bpe.decode(bpe.encode(docs, LIBRARY_TOKENIZER), LIBRARY_TOKENIZER)
    found = sorted(((r.doc_id, bytes(r.ids), r.text) for r in coded.collect()), key=repr)
    wanted = sorted(((i, np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes(), t or "") for i, t, _, _ in rows), key=repr)
    assert found == wanted
    assert bpe.encode(docs.limit(0), LIBRARY_TOKENIZER).count() == 0


def test_special_strings_as_ordinary_text(spark):
    docs = spark.createDataFrame([(1, "a<|endoftext|>")], "doc_id long, text string")
    plain = bpe.encode(docs, LIBRARY_TOKENIZER, special_tokens=False)
    assert 50256 not in bpe.unpack(plain.first().ids)
    assert bpe.decode(plain, LIBRARY_TOKENIZER).first().text == "a<|endoftext|>"


def test_arrays_of_ids_and_broken_characters(spark, library):
    rows = [(1, [50256, 64]), (2, [160, 254]), (3, None), (4, [])]
    found = bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), LIBRARY_TOKENIZER)
    assert {r.doc_id: r.text for r in found.collect()} == {i: library.decode(ids or [], skip_special_tokens=False) for i, ids in rows}
    assert {r.doc_id: r.ids for r in bpe.ids_array(found).collect()} == {i: ids or ([] if ids is not None else None) for i, ids in rows}


def test_query_equals_the_library(spark, library):
    found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries()["op13_bpe"](spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    for d in docs:
        ids = library.encode(d.text, add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert found[d.doc_id] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert len(found) == len(docs)

"""Byte-pair encoding against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.read_tables(PATH))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(encoder, library, texts):
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_every_token_encodes_to_itself(encoder):
    spelled = {k: b.decode() for k, b in enumerate(encoder.t.spelled) if b.decode("utf-8", "ignore").encode() == b}
    words = {k: s for k, s in spelled.items() if len(encoder.cut(s)) == 1 and s not in encoder.t.added}
    assert len(words) > 45_000
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(list(words.values()))] == [[k] for k in words]


def test_texts_as_the_library(encoder, library):
    draw = random.Random(5)
    parts = ["a", "aa", "e", "th", "the", " ", "  ", "\n", "\t", "'s", "'ll", "'", "1", "22", "é", "ß", "ж", "中", "\xa0", "\x85", "\x1c", "\x00", "<|endoftext|>", "<|end", " ", "!", "?!", "A", " \n", "\r\n", "🙂", "²", "ª", "ǅ", "́", "abab", "banana", "﻿"]
    same(encoder, library, ["".join(draw.choice(parts) for _ in range(draw.randint(0, 25))) for _ in range(8000)])
    anything = ["".join(chr(draw.choice([draw.randint(0, 0x24F), draw.randint(0, 0xFFFF), draw.randint(32, 126), 32])) for _ in range(20)) for _ in range(4000)]
    same(encoder, library, [t.encode("utf-8", "ignore").decode() for t in anything])


def test_long_pieces_and_a_full_cache(encoder, library, monkeypatch):
    draw = random.Random(6)
    same(encoder, library, ["x" * 20_000, "ab" * 9_000, "".join(draw.choice("abcdefgh") for _ in range(8_000))])
    monkeypatch.setattr(bpe, "CACHE_BYTES", 2_000)
    small = bpe.Encoder(encoder.t)
    for _ in range(20):
        same(small, library, ["".join(draw.choice(" abcdefgh'\n") for _ in range(300)) for _ in range(5)])


def test_query_columns_on_odd_rows(spark, library, tmp_path):
    texts = [None, "", "a", "a", " ", "Ça va? 'll <|endoftext|> ok", "word " * 40_000]
    rows = [(k if k != 2 else None, t, "x", 3) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, n_tokens long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op11_bpe(spark, str(tmp_path)).collect()}
    want = set()
    for k, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.add((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == want
    back = bpe.decode(bpe.encode(docs).drop("text"))
    assert sorted(back.columns) == ["a.b", "doc_id", "ids", "n_tokens", "text"] and back.where(F.length("text") == 200_000).count() == 1
    assert bpe.op11_bpe(spark, str(tmp_path)).count() == len(rows) and bpe.decode(bpe.encode(docs.limit(0)).drop("text")).count() == 0


def test_bytes_that_are_no_text(spark, library):
    ids = [library.encode("é", add_special_tokens=False).ids[0], 127, 200, 50256]
    rows = spark.createDataFrame([(bytearray(np.array(ids, "<u4").tobytes()),), (None,)], "ids binary")
    assert [r.text for r in bpe.decode(rows).collect()] == [library.decode(ids, skip_special_tokens=False), ""]

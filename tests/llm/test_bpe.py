import hashlib
import random
import sys

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from matchloom.llm import bpe
from matchloom.llm.queries import QUERIES

from .common import empty_docs, hard_docs

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def ours():
    return bpe.ByteBPE(PATH)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def same(ours, library, batch):
    want = [e.ids for e in library.encode_batch(batch, add_special_tokens=False)]
    got = ours.encode(batch)
    for text, a, b in zip(batch, got, want, strict=True):
        assert np.frombuffer(a, "<u4").tolist() == b, text[:200]
        assert ours.decode(a).decode() == library.decode(b, skip_special_tokens=False)


def test_documents(ours, library, spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()
    same(ours, library, [r.text or "" for r in rows])
    assert 0 < ours.failed < ours.proposed


def test_hard_texts(ours, library):
    rng = random.Random(3)
    spaces = " \t\n\x0b\x0c\r\x1c\x1f\x85\xa0 　"
    pool = "aAbéßñ1½²Ⅷ٣!#'$_ \n" + spaces + "日本語안녕🙂́‍﻿"
    batch = ["", " ", "  ", "a  b", " 's it's I'LL 'll", "<|endoftext|>", "x<|endoftext|> y  <|endoftext|><|endoftext|>\n", "\n\n \n a", "tail ", "a" * 5000, "ab" * 3000, " " * 999 + "x"]
    batch += ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    batch += ["".join(rng.choice("etaoinshrd") for _ in range(rng.randrange(1, 40))) for _ in range(2000)]
    same(ours, library, batch)


def test_every_character(ours, library):
    chars = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and (c < 0x3100 or c % 97 == 0)]
    same(ours, library, [f"a{c} {c}b {c}{c}1" for c in chars])


def test_query(spark, sf_dir, library):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids for r in rows}
    for r in QUERIES["op4_bpe"](spark, sf_dir).collect():
        ids = want[r.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_hard_rows(spark, library):
    rows = bpe.bpe_round_trip(hard_docs(spark), PATH).collect()
    assert len(rows) == 15
    for r in rows:
        assert r.n_tokens == len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert r.decoded == (r.text or "")
    assert bpe.bpe_round_trip(empty_docs(spark), PATH, digests=True).collect() == []


def test_cache_is_bounded_by_bytes():
    small = bpe.ByteBPE(PATH, cached_bytes=1 << 20)
    for i in range(40):
        small.encode([" ".join(chr(0x4E00 + (7 * i + j) % 9000) * 400 for j in range(100))])
        assert small.held <= (1 << 20) + 100 * 400 * 30
        assert sum(4 * len(k) + len(v) for k, v in small.known.items()) <= small.held

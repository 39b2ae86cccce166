import random

import public_tokenizers
import pytest
import sentencepiece

from matchloom.llm import prefix_counts as prefix
from matchloom.llm.queries import QUERIES

from .common import empty_docs, hard_docs

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_every_prefix(library):
    counter = prefix.PrefixCounter(PATH)
    rng = random.Random(4)
    pool = "aAbétheing ß1½!#'$_ \n\t ▁▁日本語안🙂<s>0x  "
    batch = ["", " ", "  ", "   a", "a  b", "<s> </s><unk> <0x0A>", "▁▁é", "   日  日", "tail  ", " lead", "\n\n  \n", " " * 140 + "x" + " " * 223, "y" + " " * 50 + "é"]
    batch += ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    batch += ["".join(rng.choice("etaoinshrd ") for _ in range(rng.randrange(1, 60))) for _ in range(200)]
    for text in batch:
        assert counter.prefixes(text).tolist() == [len(library.encode(text[:i])) for i in range(len(text) + 1)], repr(text)


def test_every_character(library):
    counter = prefix.PrefixCounter(PATH)
    for c in range(1, 0x3100):
        text = f"a{chr(c)} {chr(c)}b  {chr(c)}"
        assert counter.prefixes(text)[-1] == len(library.encode(text)), c


def test_query(spark, sf_dir, library):
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op9_token_counts"](spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        text = rows[r.doc_id]
        n = len(library.encode(text))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 4096)
        assert len(library.encode(text[: r.cut_chars])) <= 4096
        assert r.cut_chars == len(text) or len(library.encode(text[: r.cut_chars + 1])) > 4096


def test_hard_rows(spark, library):
    rows = prefix.token_counts(hard_docs(spark), PATH).collect()
    assert len(rows) == 15
    for r in rows:
        assert r.n_tokens == len(library.encode(r.text or ""))
    assert prefix.token_counts(empty_docs(spark), PATH).collect() == []


def test_normalisers_that_change_texts_are_refused(monkeypatch):
    class Folding(sentencepiece.SentencePieceProcessor):
        def normalize(self, text, **more):
            return super().normalize(text.casefold(), **more)

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Folding)
    with pytest.raises(ValueError, match="normaliser"):
        prefix.PrefixCounter(PATH)

import os
import random

import pytest
from pyspark.sql import types as T

from fieldlab.llm import token_counts as tc

os.environ["TOKENIZERS_PARALLELISM"] = "false"
public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda s: len(tok.encode(s, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def enc():
    return tc.Encoder(public_tokenizers.path(tc.RANKS), public_tokenizers.path(tc.TOKENIZER))


ODD = ["", " ", "a  <|endoftext|>  b", "<|endoftext|><|endoftext|>", "it's we'll\n\n  x", "日本語の文章。次の文", "é̂ñ ß", " x   y", "😀😀 a", "x" * 3000, "a1b2!?,,," * 30, "  lead", "tail  "]


def test_counts_equal_the_library(enc, library):
    for t in ODD:
        assert enc.count(t) == library(t), t


def test_chunked_counts_equal_whole_ones(enc, library):
    rng = random.Random(5)
    parts = [*ODD, " the", "ing", " 12", "\n", "ü", "漢字", "<|endo", "ftext|>", "<|endoftext|>", "''s", "   ", "_-_", "n't"]
    for _ in range(150):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(1, 120)))
        assert tc.count_long(t, enc.starts, enc.specials, chunk=rng.choice([16, 40, 200]), overlap=rng.choice([4, 16, 64])) == library(t)


def test_table(spark, library):
    long = "wörd the 12, " * 20_000
    rows = [(1, "a b", "x"), (1, "a b", "x"), (2, None, "x"), (3, "", None), (4, long, "x"), (None, "z", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in tc.token_counts(df).collect()))
    assert got == sorted((i or 0, len((t or "").encode()), n := library(t or ""), n > 512) for i, t, _ in rows)
    assert tc.token_counts(df.limit(0)).count() == 0
    assert isinstance(tc.token_counts(df).schema["over_limit"].dataType, T.BooleanType)

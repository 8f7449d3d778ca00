"""Token counts against the tokenizer itself."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from leafmill.llm import token_counts
from leafmill.llm.queries import COUNT_JSON
from leafmill.sources.tables import sample_table
from tests.llm.helpers import LONG, docs, empty

PATH = public_tokenizers.path(COUNT_JSON)
TEXTS = [
    None, "", " ", "plain words, and 123 numbers's they'll  we've", "UPPER'S Ärger ÉTÉ ß İstanbul ²½", LONG, "x" * 5000,
    "<|startoftext|>a<|endoftext|><|endoftext|> b", "<|startoftext| >", "été İ ΣΣ ΟΔΟΣ", "日本語 テスト 123",
    "á<|endoftext|>́b", "tabs\tand\nlines\x0b\x85\xa0 end\x1c\x1d", "\x00\x01 control ​ zero", "👍🏽 emoji 🇩🇪",
    "plain words, and 123 numbers's they'll  we've",
]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: len(tokenizer.encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("block_pairs", [1, 20, token_counts.BLOCK_PAIRS])
def test_odd_texts(spark, library, block_pairs):
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts.count(docs(spark, TEXTS), PATH, block_pairs=block_pairs).collect()}
    assert got == {i: (len((t or "").encode()), library(t)) for i, t in enumerate(TEXTS)}


def test_repeated_and_null_ids(spark, library):
    rows = [(1, "one two"), (1, "three"), (1, "three"), (None, "four"), (None, None)]
    got = token_counts.count(spark.createDataFrame(rows, "doc_id long, text string"), PATH)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(
        ((i, len((t or "").encode()), library(t)) for i, t in rows), key=repr
    )


def test_empty_table(spark):
    assert token_counts.count(empty(spark), PATH).collect() == []


def test_sample(spark, library):
    rows = sample_table(spark, "/root/testdata/sf0.001", "documents")
    want = {r["doc_id"]: library(r["text"]) for r in rows.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.count(rows, PATH).collect()} == want


def test_every_latin_character(library):
    splitter = token_counts.PreTokens(PATH)
    for c in range(token_counts.NARROW):
        text = f"a{chr(c)}1 '{chr(c)}S{chr(c)}{chr(c)}"
        special, raw, mapped = splitter.split(text)
        assert not mapped and sum(splitter.pieces(splitter.mapped(t)) for t in raw) + special == library(text), c

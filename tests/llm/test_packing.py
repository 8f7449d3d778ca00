import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from leafmill.llm import packing
from leafmill.llm.queries import PACK_JSON, op1_packing, pack_encoder
from tests.llm.helpers import LONG, docs, empty

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    made = Tokenizer.from_file(public_tokenizers.path(PACK_JSON))
    made.encode_special_tokens = True
    return made


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def check(rows, wanted):
    """Pieces cover every document once, and windows without gap."""
    of_doc, of_window = defaultdict(list), defaultdict(list)
    for r in rows:
        of_doc[r.doc_id].append(r)
        of_window[r.sequence_id].append(r)
    assert set(of_doc) == set(wanted)
    for doc, pieces in of_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(wanted[doc])
            at += p.length
            assert zlib.crc32(wanted[doc][p.start : at].tobytes()) == p.ids_crc32
        assert at == len(wanted[doc])
    for pieces in of_window.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert {p.tier for p in pieces} == {at}  # no window is padded
        assert at <= 1024 and at & (at - 1) == 0
        assert len({p.step_group for p in pieces}) == 1


def test_whole_table(spark, tokenizer):
    rows = op1_packing(spark, FOLDER).collect()
    texts = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    check(rows, {r.doc_id: ids_of(tokenizer, r.text) for r in texts})


def test_odd_rows(spark, tokenizer):
    texts = [None, "", " ", "a  b\n c", LONG, "naïve Ωmega 日本", "<|endoftext|>", "x", "x"]
    found = packing.pack(docs(spark, texts), pack_encoder, pool_tokens=500).collect()
    check(found, {i: ids_of(tokenizer, t) for i, t in enumerate(texts)})
    assert packing.pack(empty(spark), pack_encoder).count() == 0


def test_step_groups_are_even(spark):
    texts = ["tok " * n for n in range(20, 700, 3)]
    found = packing.pack(docs(spark, texts).repartition(3), pack_encoder, step_tokens=4096).collect()
    tokens = defaultdict(int)
    for r in found:
        tokens[r.step_group] += r.length
    most, least = max(tokens.values()), min(tokens.values())
    assert len(tokens) > 5 and most - least <= 2 * sum(packing.TIERS)


def test_latin_texts_are_encoded_whole(tokenizer, monkeypatch):
    cut = []
    monkeypatch.setattr(packing, "pieces", lambda text: cut.append(text) or text.split(" "))
    encode = pack_encoder()
    latin = ["Der  Wörter\n\n viele, cœur ɏ!", "it's  \t x\r\n", "", " \n", "\x85\xa0 a­ 1²½", "x" * 3000]
    for text in [*latin, "a ɐ b", "naïve Ω mega 日本"]:
        assert encode(text) == ids_of(tokenizer, text)[:-1].tobytes()
    assert cut == ["a ɐ b", "naïve Ω mega 日本"]

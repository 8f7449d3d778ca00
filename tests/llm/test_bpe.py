import random

import public_tokenizers
import pytest
import tiktoken

from leafmill.llm import bpe
from leafmill.llm.queries import BPE_RANKS
from tests.llm.helpers import LONG, docs, empty

PATH = public_tokenizers.path(BPE_RANKS)
ALPHABET = "abcdefghijklmnopqrstuvwxyzéüñ    \n\t'.,0123456789ABCЖДя日本語की😀 \x1c "


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load(PATH)


@pytest.fixture(scope="module")
def reference(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def test_random_texts(vocabulary, reference):
    encode = bpe.encoder(vocabulary, public_tokenizers.PATTERN)
    draw = random.Random(4)
    tokens = list(vocabulary.ranks)
    texts = ["".join(draw.choice(ALPHABET) for _ in range(draw.randint(0, 40))) for _ in range(3000)]
    texts += [b"".join(draw.choice(tokens) for _ in range(draw.randint(1, 6))).decode("utf8", "replace") for _ in range(3000)]
    texts += ["a" * 3000, " " * 3000, "ab" * 2000, "=-" * 2000, "aaab" * 1000]
    for text in texts:
        wanted = reference.encode_ordinary(text)
        ids = memoryview(encode(text)).cast("I").tolist()
        assert ids == wanted, text
        assert vocabulary.decode(ids) == text.encode()


def test_every_token_is_reached_or_known_not_to_be(vocabulary):
    """A token encodes to itself, and its halves are tokens of lower rank."""
    for rank, token in vocabulary.tokens.items():
        assert vocabulary.word(token) == [rank]
        if vocabulary.halves[rank]:
            left, right = vocabulary.halves[rank]
            assert vocabulary.tokens[left] + vocabulary.tokens[right] == token and max(left, right) < rank


def test_odd_rows(spark, reference):
    texts = [None, "", " ", LONG, "same", "same", "<|endoftext|>"]
    encoded = bpe.encode(docs(spark, texts), PATH, public_tokenizers.PATTERN)
    rows = {r.doc_id: r for r in bpe.decode(encoded, PATH).collect()}
    for i, text in enumerate(texts):
        assert rows[i].ids == reference.encode_ordinary(text or "")
        assert rows[i].decoded == (text or "").encode()
    assert bpe.decode(bpe.encode(empty(spark), PATH, public_tokenizers.PATTERN), PATH).count() == 0

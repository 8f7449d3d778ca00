"""Byte-level BPE in linear time: longest matches, backtracking and a memoised test of neighbouring tokens.

The bytes of a word are mapped to Latin-1 characters, so a string automaton finds every token in it. An encoding
is the one that merging by rank gives exactly if each two neighbours are an encoding themselves: no merge of a
lower rank would have crossed the border between them. The encoder therefore walks forward by the longest token
and takes a shorter one, or steps back, where a pair does not fit; an end that was tried once is not tried again.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.words import Memo, narrow, pieces

PAIR_LIMIT = 500_000


class Vocabulary:
    """Tokens by rank. ``lines`` are those of a rank file: base64 token, rank."""

    def __init__(self, lines: Iterator[bytes]):
        import ahocorasick

        pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.most = max(map(len, self.ranks), default=0)
        self.shorter = Memo(self._shorter, PAIR_LIMIT)
        self.halves = Memo(self._halves, PAIR_LIMIT)
        self.fits = Memo(self._fits, PAIR_LIMIT)
        # Built upwards, so that halving a token only looks at tokens that are halved already.
        for rank in sorted(self.tokens):
            if rank not in self.halves:
                self.halves[rank] = self._halves(rank)

    def _shorter(self, rank: int) -> int | None:
        """The longest token that is a proper prefix of this one."""
        token = self.tokens[rank]
        return next((self.ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ranks), None)

    def _halves(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None if no merge does."""
        token = self.tokens[rank]
        for n in range(1, len(token)):
            left, right = self.ranks.get(token[:n], rank), self.ranks.get(token[n:], rank)
            if left < rank and right < rank and self._stays_apart(left, right, rank):
                return left, right
        return None

    def _stays_apart(self, left: int, right: int, below: int | None = None) -> bool:
        """Whether no merge crosses the border of two tokens, before the later of their own merges is done.

        Both are taken apart from their border outwards, latest merge first; a token that reaches over the
        border would have been made if its rank came before the merge that has just been undone. ``below``
        leaves out the token that the two make themselves.
        """
        limit = None
        while True:
            over = self.ranks.get(self.tokens[left] + self.tokens[right])
            if over is not None and over != below and (limit is None or over < limit[0] or over == limit[0] and limit[1]):
                return False
            parts_left, parts_right = self.halves[left], self.halves[right]
            if parts_left is None and parts_right is None:
                return True
            # At equal ranks merges run from left to right, so the right one is the later.
            if parts_right is None or parts_left is not None and left > right:
                limit, left = (left, False), parts_left[1]
            else:
                limit, right = (right, True), parts_right[0]

    def _fits(self, pair: tuple[int, int]) -> bool:
        return self._stays_apart(*pair)

    def word(self, word: bytes) -> list[int]:
        """Ids of one pre-token: the longest tokens from left to right, and from where two do not fit, a search."""
        if word in self.ranks:
            return [self.ranks[word]]
        text = word.decode("latin-1")
        found: list[int] = []
        at, last, fits = 0, None, self.fits
        for end, (n, rank) in self.automaton.iter_long(text):
            if last is not None and not fits[last, rank]:
                return self._backtracked(text, found, at, rank)
            found.append(rank)
            at, last = end + 1, rank
        return found

    def _longest(self, text: str, at: int) -> int:
        """The longest token from a place on; single bytes are tokens, so there is one."""
        rest = text[at : at + self.most]
        n = self.automaton.longest_prefix(rest)
        while (hit := self.automaton.get(rest[:n], None)) is None:
            n -= 1
        return hit[1]

    def _backtracked(self, text: str, found: list[int], at: int, token: int | None) -> list[int]:
        """Goes on from ``found``, whose neighbours fit, with ``token`` at ``at``."""
        fits, shorter, tokens = self.fits, self.shorter, self.tokens
        size = len(text)
        dead = bytearray(size + 1)
        while True:
            end = at + len(tokens[token])
            if not dead[end] and (not found or fits[found[-1], token]):
                found.append(token)
                if end == size:
                    return found
                at, token = end, self._longest(text, end)
                continue
            token = shorter[token]
            while token is None:
                dead[at] = 1
                last = found.pop()
                at -= len(tokens[last])
                token = shorter[last]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def encoder(vocabulary: Vocabulary, pattern: str) -> Callable[[str], bytes]:
    """Ids of a text as little-endian unsigned 32-bit numbers. Each match of ``pattern`` is encoded separately."""
    import struct

    import regex

    find = regex.compile(pattern).findall

    def packed(match: str) -> bytes:
        ids = vocabulary.word(match.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    words = Memo(packed, 200_000)

    def whole(text: str) -> bytes:
        return b"".join(map(words.__getitem__, find(text)))

    def spaced(piece: str) -> bytes:
        # Most are one match, which need not be remembered twice.
        matches = find(" " + piece)
        return packed(matches[0]) if len(matches) == 1 else b"".join(map(words.__getitem__, matches))

    after_space = Memo(spaced, 500_000)

    def encode(text: str) -> bytes:
        parts = pieces(text)
        if parts is None:
            return whole(text)
        return whole(parts[0]) + b"".join(map(after_space.__getitem__, parts[1:]))

    return encode


def load(path: str) -> Vocabulary:
    with open(path, "rb") as lines:
        return Vocabulary(lines)


@lru_cache(maxsize=1)
def _stored_encoder(path: str, pattern: str) -> Callable[[str], bytes]:
    """An encoder that the tasks of a worker share."""
    return encoder(load(path), pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id`` and ``ids`` (array of int).

    ``ranks_path`` must exist on every executor. A null or empty text has no ids. Rows that repeat an id are
    encoded each. Other columns are dropped. Texts stay whole; a batch holds as many as fit the session's limit
    of Arrow bytes.
    """
    rows = narrow(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        one = _stored_encoder(ranks_path, pattern)
        for batch in batches:
            found = [one(text.as_py()) for text in batch.column("text")]
            ends = np.cumsum([0, *(len(x) // 4 for x in found)], dtype=np.int32)
            values = pa.array(np.frombuffer(b"".join(found), dtype="<i4"))
            ids = pa.ListArray.from_arrays(pa.array(ends), values)
            yield pa.RecordBatch.from_arrays([batch.column("id"), ids], ["doc_id", "ids"])

    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_type}, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Adds ``decoded`` (binary), the bytes of ``ids``; null ids count as none."""
    id_type = encoded.schema["doc_id"].dataType.simpleString()
    rows = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        with open(ranks_path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        table = [b""] * (max((int(rank) for _, rank in pairs), default=-1) + 1)
        for token, rank in pairs:
            table[int(rank)] = base64.b64decode(token)
        text_of = table.__getitem__
        for batch in batches:
            lists = batch.column("ids")
            ends = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False)
            out = [b"".join(map(text_of, values[a:b].tolist())) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), lists, pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"]
            )

    return rows.mapInArrow(run, f"doc_id {id_type}, ids array<int>, decoded binary")

"""Token counts of documents: pieces are counted once per distinct pre-token and joined to the documents' frequencies.

Documents are read once, in blocks. A block is one stored row: its distinct pre-tokens, and for each document how often
it holds which of them. Pre-tokens of all blocks then meet by their text, each distinct one is counted once by the
tokenizer's model, and the counts go back to the blocks, where frequency times pieces is summed. No ids are made.

A pre-token comes at most once per block, however many documents hold it, so a word of every document is a row per
block and not a row per document.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.words import narrow
from leafmill.session import fresh_path

BLOCK_PAIRS = 2_000_000  # (document, pre-token) pairs after which a block is closed
NARROW = 0x250  # code points below it are Latin: composed as they are, lowered one by one

# Shape of a tokenizer whose pre-tokens are the matches of one pattern in the lowered text (fixed values of its file format).
LOWERED = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]


class PreTokens:
    """Pre-tokens of a ``tokenizers`` file, as its model sees them, and their numbers of pieces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.config = json.load(file)
        added = [token for token in self.config["added_tokens"] or []]
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that depend on their surroundings are not supported")
        strings = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, strings))) if strings else None
        self.words = self._narrow_pattern()
        self.wide = re.compile(f"[^\\x00-{chr(NARROW - 1)}]")
        self.to_model = _byte_characters()

    def _narrow_pattern(self) -> re.Pattern | None:
        """The pattern for Latin texts with classes written out, if the file has the shape of ``LOWERED``."""
        normal, cut = self.config["normalizer"] or {}, self.config["pre_tokenizer"] or {}
        steps = cut.get("pretokenizers", [])
        if normal.get("normalizers") != LOWERED or [s["type"] for s in steps] != ["Split", "ByteLevel"]:
            return None
        split, level = steps
        plain = (split["behavior"], split["invert"], level["add_prefix_space"], level["use_regex"]) == ("Removed", True, False, False)
        pattern = split["pattern"].get("Regex")
        if not plain or pattern is None:
            return None
        for name, members in (
            (r"\p{L}", _ranges(lambda c: unicodedata.category(c)[0] == "L")),
            (r"\p{N}", _ranges(lambda c: unicodedata.category(c)[0] == "N")),
            (r"\s", r"\x09-\x0d\x20\x85\xa0"),
        ):
            pattern = pattern.replace(name, members)
        return None if "\\p" in pattern else re.compile(pattern)

    def split(self, text: str) -> tuple[int, list[str], list[str]]:
        """Number of special strings, raw pre-tokens of Latin stretches, and pre-tokens in the model's characters."""
        parts = self.special.split(text) if self.special else [text]
        raw: list[str] = []
        mapped: list[str] = []
        for part in parts:
            if self.words is not None and not self.wide.search(part):
                raw += self.words.findall(part.lower())
            elif part:
                if self.tokenizer.normalizer is not None:
                    part = self.tokenizer.normalizer.normalize_str(part)
                mapped += [token for token, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]
        return len(parts) - 1, raw, mapped

    def mapped(self, raw: str) -> str:
        return "".join(map(self.to_model.__getitem__, raw.encode()))

    def pieces(self, token: str) -> int:
        return len(self.tokenizer.model.tokenize(token))


def _ranges(test) -> str:
    """Code points below ``NARROW`` that pass, as the inside of a character class."""
    return "".join(f"\\u{c:04x}" for c in range(NARROW) if test(chr(c)))


def _byte_characters() -> list[str]:
    """The visible character for each byte: itself if it is printable Latin-1, else the next free one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


@lru_cache(maxsize=1)
def _stored(path: str) -> PreTokens:
    """A splitter that the tasks of a worker share."""
    return PreTokens(path)


class _Numbers(dict):
    """Numbers from 0 in order of first appearance."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


class _RawNumbers(dict):
    """Numbers of raw pre-tokens, those of their form in the model's characters."""

    def __init__(self, numbers: _Numbers, mapped):
        super().__init__()
        self.numbers, self.mapped = numbers, mapped

    def __missing__(self, raw):
        self[raw] = number = self.numbers[self.mapped(raw)]
        return number


class _Block:
    """Frequencies of some documents. Pairs are stored by document and number, as planes of bytes, which pack well."""

    def __init__(self, splitter: PreTokens):
        self.splitter = splitter
        self.numbers = _Numbers()
        self.raw = _RawNumbers(self.numbers, splitter.mapped)
        self.ids: list[pa.Scalar] = []
        self.bytes: list[int] = []
        self.specials: list[int] = []
        self.sizes: list[int] = []
        self.pairs = 0
        self.parts: list[tuple] = []

    def add(self, id_: pa.Scalar, text: str) -> None:
        import numpy as np

        special, raw, mapped = self.splitter.split(text)
        counts = Counter(map(self.raw.__getitem__, raw))
        if mapped:
            counts.update(map(self.numbers.__getitem__, mapped))
        self.ids.append(id_)
        self.bytes.append(len(text) if text.isascii() else len(text.encode()))
        self.specials.append(special)
        self.sizes.append(len(counts))
        self.pairs += len(counts)
        numbers = np.fromiter(counts, "<u4", len(counts))
        times = np.fromiter(counts.values(), "<u4", len(counts))
        order = np.argsort(numbers)
        self.parts.append((np.diff(numbers[order], prepend=np.uint32(0)), times[order]))

    def row(self, block: int) -> dict:
        import numpy as np

        def planes(n: int) -> bytes:
            values = np.concatenate([p[n] for p in self.parts]).astype("<u4")
            return values.view("u1").reshape(-1, 4).T.tobytes()

        return {
            "block": block, "ids": self.ids, "n_bytes": self.bytes, "specials": self.specials, "sizes": self.sizes,
            "steps": planes(0), "times": planes(1), "tokens": list(self.numbers),
        }


def _unplane(data: bytes):
    import numpy as np

    return np.ascontiguousarray(np.frombuffer(data, "u1").reshape(4, -1).T).view("<u4").ravel().astype("int64")


def count(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """One row per document: ``doc_id``, ``n_bytes`` (UTF-8) and ``n_tokens``, as the tokenizer of ``path`` gives them.

    ``path`` is a ``tokenizers`` file that exists on every executor. Begin and end tokens are not added; a special
    string inside a text is one token. A null or empty text has no tokens. Rows that repeat an id and rows without one
    are counted each; an empty table gives no rows; other columns are dropped. A block closes after ``block_pairs``
    pairs, so one very long text is a block of its own, and no result depends on the blocks.
    """
    rows = narrow(docs, id_col, text_col)
    spark = docs.sparkSession
    id_type = rows.schema["id"].dataType.simpleString()
    stored = (
        f"block long, ids array<{id_type}>, n_bytes array<long>, specials array<long>, sizes array<long>, "
        "steps binary, times binary, tokens array<string>"
    )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        splitter = _stored(path)
        base, done = TaskContext.get().partitionId() << 32, 0
        block, arrow = _Block(splitter), None

        def close() -> pa.RecordBatch:
            row = block.row(base + done)
            types = {"block": pa.int64(), "ids": pa.list_(arrow), "steps": pa.binary(), "times": pa.binary(), "tokens": pa.list_(pa.string())}
            return pa.RecordBatch.from_arrays([pa.array([v], types.get(k, pa.list_(pa.int64()))) for k, v in row.items()], list(row))

        for batch in batches:
            arrow = batch.column("id").type
            for id_, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                block.add(id_, text.as_py())
                if block.pairs >= block_pairs:
                    yield close()
                    block, done = _Block(splitter), done + 1
        if block.ids:
            yield close()

    folder = fresh_path(spark, "frequencies")
    rows.mapInArrow(blocks, stored).write.option("compression", "zstd").parquet(folder)
    kept = spark.read.schema(stored).parquet(folder)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _stored(path).pieces
        last, n = None, 0
        for batch in batches:
            made = []
            for token in batch.column("token").to_pylist():
                if token != last:  # rows of one pre-token stand together
                    last, n = token, pieces(token)
                made.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("at"), pa.array(made, pa.int32())], ["block", "at", "pieces"])

    held = kept.select("block", F.posexplode("tokens").alias("at", "token"))
    together = held.repartition("token").sortWithinPartitions("token")
    back = together.mapInArrow(measure, "block long, at int, pieces int")

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        import numpy as np

        pieces = np.zeros(right.num_rows, "int64")
        pieces[right.column("at").to_numpy()] = right.column("pieces").to_numpy()
        out = []
        for row in left.to_batches():
            sizes = row.column("sizes").values.to_numpy()
            steps, times = _unplane(row.column("steps")[0].as_py()), _unplane(row.column("times")[0].as_py())
            # Numbers rise within a document and start anew with each.
            ends = np.cumsum(sizes)
            running = np.concatenate([[0], np.cumsum(steps)])
            numbers = running[1:] - np.repeat(running[ends - sizes], sizes)
            totals = np.concatenate([[0], np.cumsum(pieces[numbers] * times)])
            tokens = totals[ends] - totals[ends - sizes] + row.column("specials").values.to_numpy()
            out.append(
                pa.table(
                    [row.column("ids").values, row.column("n_bytes").values, pa.array(tokens, pa.int64())],
                    ["doc_id", "n_bytes", "n_tokens"],
                )
            )
        return pa.concat_tables(out)

    names = [c for c in kept.columns if c not in ("block", "tokens")]
    frequencies = kept.select(F.col("block").alias("of"), *names).groupBy("of")
    return frequencies.cogroup(back.groupBy("block")).applyInArrow(add_up, f"doc_id {id_type}, n_bytes long, n_tokens long")

"""Repeated substrings and passages with their frequencies."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import letter_runs
from leafmill.operators import suffixes
from leafmill.operators.search import TASK_BYTES, tasks_for
from leafmill.session import keep

ANCHOR = 3  # words that decide where a passage is counted
PIECE_BYTES = 2 << 20  # text cut into stretches at once
PACK_BYTES = 16 << 20  # text whose stretches are packed together
PARTS = 4  # per task; the passages of a part are counted at once
STRETCH = 256  # passages in a stretch; a longer one goes on in the next


def repeated_substrings(texts: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Repeated substrings of any length that at least two different symbols follow, with counts.

    These are the inner nodes of a suffix tree, the empty one included. ``keys`` names a text; with no keys counts
    are over all texts together. The end of each text is a symbol of its own, so two ends differ. The rounds follow the
    logarithm of the longest repeat, and no text has to fit into a task.
    """
    found, groups, rows = _nodes(texts, keys, text)
    grams = suffixes.substrings(found, rows).select("_g", "gram", "freq")
    roots = rows.groupBy("_g").agg(F.sum(F.char_length("_text")).alias("freq")).where("freq > 0")
    grams = grams.unionByName(roots.select("_g", F.lit("").alias("gram"), "freq"))
    return grams.join(groups, "_g").select(*keys, "gram", "freq")


def repeat_places(texts: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """As ``repeated_substrings``, but each substring by its length and one place of it, for very long repeats.

    ``keys`` should tell the texts apart, as ``pos`` is a position in a text of theirs.
    """
    found, groups, _ = _nodes(texts, keys, text)
    return found.join(groups, "_g").select(*keys, "pos", "length", "freq")


def _nodes(texts: DataFrame, keys: Sequence[str], text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows, groups = suffixes.numbered(texts, text, keys)
    return suffixes.nodes(suffixes.neighbours(suffixes.rank(rows))), groups, rows


def suffix_order(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Suffixes of each text in order, with the length of the prefix shared with the one before.

    Rows that repeat a key are texts of their own. A null or empty text has no suffixes.
    """
    rows, groups = suffixes.numbered(texts.select(key, text), text, None)
    placed = suffixes.neighbours(suffixes.rank(rows))
    return placed.join(groups, "_g").select(
        key, F.col("rank").cast("int").alias("rank"), F.col("pos").cast("int").alias("pos"), F.col("shared").cast("int").alias("shared")
    )


def _words(text: str) -> Column:
    return letter_runs(F.lower(F.col(text)))


def _passage(words: str, start: Column, length: int) -> Column:
    return F.array_join(F.slice(words, start + 1, length), " ")


def _repeated_places(texts: DataFrame, text: str, length: int) -> DataFrame:
    """``(_t, pos)`` where a passage of ``length`` words stands whose hash another text holds too.

    Only numbers are shuffled, and once: hashes are counted and met again where they were dealt to.
    """
    starts = F.when(F.size("_w") >= length, F.sequence(F.lit(0), F.size("_w") - length)).otherwise(F.array().cast("array<int>"))
    hashes = texts.select("_t", _words(text).alias("_w")).select(
        "_t", F.posexplode(F.transform(starts, lambda i: F.xxhash64(_passage("_w", i, length)))).alias("pos", "hash")
    )
    dealt = hashes.repartition(tasks_for(texts, [text], TASK_BYTES), "hash")
    found = dealt.groupBy("hash").agg(F.min("_t").alias("_low"), F.max("_t").alias("_high")).where("_low < _high")
    return dealt.join(found.select("hash").hint("shuffle_merge"), "hash", "left_semi").select("_t", "pos")


def _told_apart(texts: DataFrame) -> DataFrame:
    """``texts`` with a number ``_t`` each, kept, as they are read again."""
    return keep(texts.withColumn("_t", F.monotonically_increasing_id()))


def _mixed(values: np.ndarray) -> np.ndarray:
    values = values * np.uint64(0x9E3779B97F4A7C15)
    values ^= values >> np.uint64(32)
    values *= np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


class _Lines:
    """Words of lines in which one space parts words; ``line`` is the number of a word's line, ``ends`` are exclusive."""

    def __init__(self, data: bytes):
        self.data = data
        marks = np.frombuffer(data, np.uint8)
        gaps = np.flatnonzero((marks == ord(" ")) | (marks == ord("\n")))
        self.starts = np.append(0, gaps + 1)
        self.ends = np.append(gaps, len(marks))
        self.line = np.append(0, np.cumsum(marks[gaps] == ord("\n")))

    def passages(self, length: int) -> np.ndarray:
        """The first word of every ``length`` words that stand in one line."""
        return np.flatnonzero(self.line[: max(0, len(self.line) - length + 1)] == self.line[length - 1 :])

    def cut(self, first: np.ndarray, last: np.ndarray) -> list[bytes]:
        return [self.data[a:z] for a, z in zip(self.starts[first].tolist(), self.ends[last].tolist())]

    def hashes(self) -> np.ndarray:
        """A number per word, of its length and its first and last eight bytes. Equal words have equal numbers."""
        eights = np.ndarray(len(self.data) + 1, "<u8", self.data + bytes(8), strides=(1,))
        size = self.ends - self.starts
        some = np.append(np.uint64(256) ** np.arange(8, dtype=np.uint64) - np.uint64(1), ~np.uint64(0))[np.minimum(size, 8)]
        last = _mixed((eights[np.maximum(self.ends - 8, self.starts)] & some) + size.astype(np.uint64))
        return _mixed((eights[self.starts] & some) + last)


def _of_runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """A number per run of ``length`` words, by its first word."""
    count = max(0, len(hashes) - length + 1)
    found = hashes[:count]
    for k in range(1, length):
        found = _mixed(found + hashes[k : count + k])
    return found


def _sums(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each row the sum of ``values`` over the rows with its key."""
    order = np.argsort(keys)
    new = np.append(True, keys[order][1:] != keys[order][:-1])
    sums = np.empty(len(keys), np.int64)
    sums[order] = np.add.reduceat(values[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    return sums


def _stretches(texts: Sequence[bytes], length: int) -> pa.Table:
    """All passages of ``texts``, as stretches of passages that follow each other and have the same anchor.

    The anchor is the smallest hash of ``ANCHOR`` words in a passage, so it follows from the passage's words; neighbours
    mostly share it. ``first`` says that the passages of the stretch come for the first time in their text; that is
    decided by their words, and hashes only tell which ones have to be looked at.
    """
    words = _Lines(b"\n".join(texts))
    at = words.passages(length)
    hashes, anchor = words.hashes(), min(ANCHOR, length)
    grams = _of_runs(hashes, anchor)
    lowest = grams[: max(0, len(hashes) - length + 1)].copy()
    for k in range(1, length - anchor + 1):
        np.minimum(lowest, grams[k : len(lowest) + k], out=lowest)
    lowest = lowest[at]
    first, seen = np.ones(len(at), bool), set()
    if len(at):
        alike = _mixed(_of_runs(hashes, length)[at] + _mixed(words.line[at].astype(np.uint64)))
        again = np.flatnonzero(_sums(alike, np.ones(len(at), np.int64)) > 1)
        for i, passage in zip(again.tolist(), zip(words.line[at[again]].tolist(), words.cut(at[again], at[again] + length - 1))):
            first[i] = passage not in seen
            seen.add(passage)
    new = np.append(True, (lowest[1:] != lowest[:-1]) | (at[1:] != at[:-1] + 1) | (first[1:] != first[:-1]))[: len(at)]
    begun = np.flatnonzero(new)
    new |= (np.arange(len(at)) - np.repeat(begun, np.diff(np.append(begun, len(at))))) % STRETCH == 0
    begun = np.flatnonzero(new)
    ended = np.append(begun, len(at))[1:] - 1
    cut = words.cut(at[begun], at[ended] + length - 1)
    return pa.table({"anchor": lowest[begun], "stretch": pa.array(cut, pa.binary()), "first": first[begun]})


def _pieces(batches: Iterator[pa.RecordBatch], each: int) -> Iterator[list[bytes]]:
    """Whole texts, ``each`` bytes of them at a time."""
    piece, size = [], 0
    for batch in batches:
        for text in filter(None, batch.column(0).to_pylist()):
            piece.append(text.encode())
            size += len(piece[-1])
            if size >= each:
                yield piece
                piece, size = [], 0
    if piece:
        yield piece


PACKED = "part int, stretches binary, occurrences array<int>, documents array<int>"


def _packed(
    texts: DataFrame, text: str, length: int, parts: int, pack_bytes: int = PACK_BYTES, piece_bytes: int = PIECE_BYTES
) -> DataFrame:
    """Stretches compressed by part of their anchors: how often each comes, and in how many texts for the first time."""
    plain = F.btrim(F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{N}]+", " "))

    def pack(tables: list[pa.Table]) -> pa.RecordBatch:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        found = pa.concat_tables(tables).group_by(["anchor", "stretch"], use_threads=False)
        found = found.aggregate([("first", "count"), ("first", "sum")])
        anchor = found["anchor"].to_numpy()
        part = (anchor % np.uint64(parts)).astype(np.int32)
        order = np.lexsort((anchor, part))
        lines = pc.binary_join_element_wise(found["stretch"], b"", b"\n").take(pa.array(order)).combine_chunks()
        at, data = np.frombuffer(lines.buffers()[1], np.int32), memoryview(lines.buffers()[2])
        part = part[order]
        ends = np.append(np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)).astype(np.int32)
        starts = np.append(0, ends[:-1]).astype(np.int32)
        packs = [squeeze(data[a : z - 1]) for a, z in zip(at[starts].tolist(), at[ends].tolist())]
        counts = (pa.array(found[c].to_numpy()[order].astype(np.int32)) for c in ("first_count", "first_sum"))
        lists = (pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1])), c) for c in counts)
        return pa.RecordBatch.from_arrays(
            [pa.array(part[starts]), pa.array(packs, pa.binary()), *lists], ["part", "stretches", "occurrences", "documents"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, size = [], 0
        for piece in _pieces(batches, piece_bytes):
            table = _stretches(piece, length)
            if table.num_rows:
                tables.append(table)
            size += sum(map(len, piece))
            if tables and size >= pack_bytes:
                yield pack(tables)
                tables, size = [], 0
        if tables:
            yield pack(tables)

    return texts.where(F.col(text).isNotNull()).select(plain).mapInArrow(run, PACKED)


def _counted(packed: DataFrame, length: int) -> DataFrame:
    """Passages of at least two texts in the stretches of a part.

    Packs are opened some at a time, first for hashes and then for the words of passages whose hash comes again; these
    are counted by their words.
    """

    def opened(packs: pa.ChunkedArray) -> Iterator[_Lines]:
        import zstandard

        plain = zstandard.ZstdDecompressor().decompress
        some, size = [], 0
        for pack in packs:
            some.append(plain(pack.as_py()))
            size += len(some[-1])
            if size >= PIECE_BYTES:
                yield _Lines(b"\n".join(some))
                some, size = [], 0
        if some:
            yield _Lines(b"\n".join(some))

    def run(group: pa.Table) -> pa.Table:
        occurrences, documents = (
            group[c].combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("occurrences", "documents")
        )
        hashes, texts, lines = [], [], 0
        for words in opened(group["stretches"]):
            at = words.passages(length)
            hashes.append(_of_runs(words.hashes(), length)[at])
            texts.append(documents[lines + words.line[at]])
            lines += words.line[-1] + 1
        again = _sums(np.concatenate(hashes), np.concatenate(texts)) > 1
        found, lines, done = [], 0, 0
        for words, own in zip(opened(group["stretches"]), texts):
            at = words.passages(length)[again[done : done + len(own)]]
            place = lines + words.line[at]
            cut = pa.array(words.cut(at, at + length - 1), pa.binary())
            found.append(pa.table([cut, occurrences[place], documents[place]], ["passage", "occurrences", "documents"]))
            lines, done = lines + words.line[-1] + 1, done + len(own)
        sums = pa.concat_tables(found).group_by("passage", use_threads=False).aggregate([("occurrences", "sum"), ("documents", "sum")])
        sums = sums.filter(pc.greater(sums["documents_sum"], 1))
        return pa.table([sums["passage"].cast(pa.string()), sums["occurrences_sum"], sums["documents_sum"]], found[0].schema.names)

    return packed.groupBy("part").applyInArrow(run, "passage string, occurrences long, documents long")


def repeated_passages(texts: DataFrame, text: str, length: int) -> DataFrame:
    """Runs of ``length`` words found in at least two texts, with counts.

    Passages that follow each other and share an anchor are moved as one stretch of text, so a word is moved about three
    times and not once per passage. An anchor follows from a passage's words, so equal passages meet in a part, where
    they are counted by their words; nothing else is shuffled or kept. Equal stretches of texts packed together are one.
    """
    tasks = tasks_for(texts, [text], TASK_BYTES)
    return _counted(_packed(texts, text, length, PARTS * tasks).repartition(tasks, "part"), length)


def repeated_runs(texts: DataFrame, key: str, text: str, length: int) -> DataFrame:
    """The longest stretches of each text in which every ``length`` words stand in another text too.

    Rows are (``key``, ``start``, ``words``), counted in words. Seeds are passages of ``length`` words whose hash several
    texts hold; seeds at neighbouring places are one stretch, of any length. Passages are told by 64-bit hashes. Rows that
    repeat a key are texts of their own. Hashes are shuffled once, however many of them come again.
    """
    kept = _told_apart(texts.select(key, text))
    in_text = Window.partitionBy("_t").orderBy("pos")
    seeds = _repeated_places(kept, text, length).withColumn("_run", F.col("pos") - F.row_number().over(in_text))
    runs = seeds.groupBy("_t", "_run").agg(F.min("pos").alias("start"), (F.count(F.lit(1)) + length - 1).alias("words"))
    return runs.join(kept.select("_t", key), "_t").select(key, "start", "words")

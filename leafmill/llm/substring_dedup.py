"""Repeated passages from prefix-partitioned suffix trees over words.

A word is removed if a window of ``window`` words over it starts twice, so what counts are the inner nodes of the tree of
all suffixes at a depth of ``window`` words or more: a suffix below such a node repeats at least so far.

1. Every window has an anchor, the word 8-gram in it with the smallest hash, so suffixes that meet at such a depth have
   equal anchors at equal places. Suffixes are counted by anchor; where an anchor has one place only, none can repeat.
2. Suffixes are split into groups by a prefix of variable length. As long as an anchor has at most ``group_rows``
   suffixes, its words are the prefix, and the group is held in memory. It comes as one row per place of the anchor,
   with the words around it once, for all suffixes whose window has its anchor there.
3. A group's suffixes are sorted by content, to the depth that is asked; neighbours that agree so far are leaves below a
   deep inner node, and all of them are marked. Contents are compared themselves, not hashes of them.
4. For larger groups the prefix grows to the whole window (by two 64-bit hashes of it). Such a group is a single node, of
   which only the number of leaves is asked, so it is counted and never gathered: a passage in very many documents is
   no large group. Places with the same words around them are counted as one before; within a document they are marked
   at once, as a range, and one of them goes on, so a text that says one thing over and over gives few rows.

Copies of a whole text are found first by digest; one of them takes part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.words import Memo, narrow
from leafmill.session import fresh_path, keep

WINDOW = 35
ANCHOR = 8
GROUP_ROWS = 10_000
BATCH_RUNS = 2_000

# Odd multipliers of the two window hashes.
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_SHIFT = np.uint64(33)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _SHIFT)) * _MIX[0]
    x = (x ^ (x >> _SHIFT)) * _MIX[1]
    return x ^ (x >> _SHIFT)


class _Powers:
    """Powers of an odd number and of its inverse, modulo 2**64."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = (
                np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]))
                for b in (self.base, self.inverse)
            )
        return self.up[:n], self.down[:n]


class Suffixes:
    """Anchors and window hashes of a text's words."""

    def __init__(self, window: int, anchor: int):
        import xxhash

        self.window, self.anchor = window, anchor
        self.hash = Memo(xxhash.xxh3_64_intdigest, 100_000)
        self.p, self.q = _Powers(_P), _Powers(_Q)

    def words(self, text: str) -> list[bytes]:
        return text.encode().split()  # of bytes: cut at the six ASCII blanks only

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.hash.__getitem__, words), np.uint64, len(words))

    def _hashes(self, ids: np.ndarray, n: int, powers: _Powers) -> np.ndarray:
        """A polynomial hash of the ``n`` words from each place."""
        up, down = powers.upto(len(ids))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ids * up)])
        return _mix((sums[n:] - sums[:-n]) * down[: len(ids) - n + 1])

    def anchors(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each window its anchor's hash and the anchor's place in the window (leftmost of equals)."""
        grams = self._hashes(ids, self.anchor, self.p)
        span, width = self.window - self.anchor + 1, 1
        best = np.arange(len(grams))
        while width < span:
            step = min(width, span - width)
            left, right = best[:-step], best[step:]
            best = np.where(grams[left] <= grams[right], left, right)
            width += step
        return grams[best], best - np.arange(len(best))

    def runs(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of anchors in a text: first window that has its anchor there, number of such windows, anchor."""
        anchors, places = self.anchors(ids)
        absolute = np.arange(len(places)) + places
        first = np.concatenate([[0], np.flatnonzero(np.diff(absolute)) + 1])
        return first, np.diff(np.append(first, len(places))), anchors[first]

    def listed(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct anchors of a text, in how many places each is, and how many suffixes it has there."""
        _, sizes, anchors = self.runs(self.ids(words))
        keys, which, places = np.unique(anchors, return_inverse=True, return_counts=True)
        return keys, places.astype(np.int32), np.bincount(which, weights=sizes).astype(np.int32)

    def windows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of each window."""
        return self._hashes(ids, self.window, self.p), self._hashes(ids, self.window, self.q)


def _scan(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """Per document: number of words, digest of its words, and its anchors with their places and suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        suffixes = Suffixes(window, anchor)
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32))
        for batch in batches:
            sizes, digests, found = [], [], [none]
            for text in batch.column("text"):
                words = suffixes.words(text.as_py())
                sizes.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).digest())
                found.append(suffixes.listed(words) if len(words) >= window else none)
            ends = pa.array(np.cumsum([0, *(len(f[0]) for f in found[1:])], dtype=np.int32))
            keys, places, counts = (np.concatenate(column) for column in zip(*found))
            lists = (pa.ListArray.from_arrays(ends, pa.array(v)) for v in (keys.view(np.int64), places, counts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), *lists],
                ["id", "n_words", "digest", "anchor", "places", "suffixes"],
            )

    return rows.mapInArrow(
        run, f"id {_kind(rows)}, n_words long, digest binary, anchor array<long>, places array<int>, suffixes array<int>"
    )


def _kind(rows: DataFrame) -> str:
    return rows.schema["id"].dataType.simpleString()


def _squeezed(rows: DataFrame) -> DataFrame:
    """The words of each text, joined by one space and compressed, with their digest, for joins that move them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            joined = [b" ".join(text.as_py().encode().split()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), pa.array([hashlib.sha256(x).digest() for x in joined], pa.binary()),
                    pa.array([squeeze(x) for x in joined], pa.binary()),
                ],
                ["id", "digest", "packed"],
            )

    return rows.mapInArrow(run, f"id {_kind(rows)}, digest binary, packed binary")


GROUPED = "runs array<struct<anchor: long, at: int, n: int, words: binary>>"
COUNTED = "leaves array<struct<at: int, n: int, places: int, first: long, second: long, windows: array<struct<prefix: long, content: long>>>>"
MARKS = "array<struct<first: int, last: int>>"


def _suffix_rows(texts: DataFrame, window: int, anchor: int) -> DataFrame:
    """Suffixes with a shared anchor: ``runs`` for groups that are gathered, ``leaves`` for those that are counted.

    A row is a document or, with many suffixes, a part of one. Of the places of a document with the same words around
    them one is a leaf, with the number of ``places``; where there are several, ``marks`` has the suffixes of all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        suffixes, plain = Suffixes(window, anchor), zstandard.ZstdDecompressor().decompress
        run_type = pa.struct([("anchor", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("words", pa.binary())])
        window_type = pa.struct([("prefix", pa.int64()), ("content", pa.int64())])
        leaf_type = pa.struct(
            [
                ("at", pa.int32()), ("n", pa.int32()), ("places", pa.int32()), ("first", pa.int64()), ("second", pa.int64()),
                ("windows", pa.list_(window_type)),
            ]
        )
        mark_type = pa.struct([("first", pa.int32()), ("last", pa.int32())])

        def out(batch: pa.RecordBatch, i: int, runs: tuple | None = None, leaves: tuple | None = None, marks: tuple | None = None) -> pa.RecordBatch:
            def listed(columns: tuple | None, kind: pa.StructType) -> pa.Array:
                if columns is None:
                    return pa.array([None], pa.list_(kind))
                arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, kind)]
                return pa.ListArray.from_arrays(pa.array([0, len(arrays[0])], pa.int32()), pa.StructArray.from_arrays(arrays, fields=list(kind)))

            keys = [batch.column(c).slice(i, 1) for c in ("id", "part")]
            columns = (listed(runs, run_type), listed(leaves, leaf_type), listed(marks, mark_type))
            return pa.RecordBatch.from_arrays([*keys, *columns], ["id", "part", "runs", "leaves", "marks"])

        for batch in batches:
            for i in range(batch.num_rows):
                shared, frequent = (
                    batch.column(c)[i].values.to_numpy(zero_copy_only=False).view(np.uint64) for c in ("shared", "frequent")
                )
                words = plain(batch.column("packed")[i].as_py()).split()
                ids = suffixes.ids(words)
                first, sizes, anchors = suffixes.runs(ids)
                counted = np.isin(anchors, frequent)
                gathered = np.flatnonzero(np.isin(anchors, shared) & ~counted)
                for a in range(0, len(gathered), BATCH_RUNS):
                    some = gathered[a : a + BATCH_RUNS]
                    around = [b" ".join(words[first[r] : first[r] + sizes[r] + window - 1]) for r in some]
                    yield out(batch, i, (anchors[some].view(np.int64), first[some].astype(np.int32), sizes[some].astype(np.int32), around))
                if counted.any():
                    content, prefix = suffixes.windows(ids)
                    every = np.flatnonzero(counted)
                    digests = b"".join(
                        xxhash.xxh3_128_digest(b" ".join(words[first[r] : first[r] + sizes[r] + window - 1])) for r in every
                    )
                    around, one, which, places = np.unique(
                        np.frombuffer(digests, np.int64).reshape(-1, 2), axis=0, return_index=True, return_inverse=True, return_counts=True
                    )
                    again = every[places[which.ravel()] > 1]
                    if len(again):
                        yield out(batch, i, marks=_joined(first[again], first[again] + sizes[again] - 1))
                    for a in range(0, len(one), BATCH_RUNS):
                        some, halves = every[one[a : a + BATCH_RUNS]], around[a : a + BATCH_RUNS]
                        ends = np.concatenate([[0], np.cumsum(sizes[some])]).astype(np.int32)
                        at = np.arange(ends[-1]) - np.repeat(ends[:-1], sizes[some]) + np.repeat(first[some], sizes[some])
                        both = [pa.array(h[at].view(np.int64)) for h in (prefix, content)]
                        windows = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(both, fields=list(window_type)))
                        yield out(
                            batch, i, None,
                            (
                                first[some].astype(np.int32), sizes[some].astype(np.int32), places[a : a + BATCH_RUNS].astype(np.int32),
                                halves[:, 0].copy(), halves[:, 1].copy(), windows,
                            ),
                        )

    return texts.mapInArrow(run, f"id {_kind(texts)}, part long, {GROUPED}, {COUNTED}, marks {MARKS}")


def _joined(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending ranges, those that touch as one."""
    cuts = np.flatnonzero(first[1:] > last[:-1] + 1)
    return first[np.concatenate([[0], cuts + 1])].astype(np.int32), last[np.append(cuts, len(last) - 1)].astype(np.int32)


def _deep(rows: list[tuple[int, int, bytes]], window: int) -> list[list[int]]:
    """For each (first, number, words) of a group the suffixes below an inner node of ``window`` words or more.

    In the order of content those below one such node stand side by side, so each is compared with the one before it.
    """
    suffixes = []
    for r, (_, n, words) in enumerate(rows):
        ends = [i for i, c in enumerate(words) if c == 32]
        ends.append(len(words))
        begins = [0, *(e + 1 for e in ends)]
        suffixes += [(words[begins[k] : ends[k + window - 1]], r, k) for k in range(n)]
    suffixes.sort()
    found: list[list[int]] = [[] for _ in rows]
    before = None
    for suffix in suffixes:
        if before is not None and suffix[0] == before[0]:
            if not found[before[1]] or found[before[1]][-1] != before[2]:
                found[before[1]].append(before[2])
            found[suffix[1]].append(suffix[2])
        before = suffix
    return found


def _gathered(suffixes: DataFrame, window: int) -> DataFrame:
    """(id, part, marks) of groups that fit into memory, ``marks`` being ranges of suffixes that repeat."""
    rows = suffixes.where("runs is not null").select("id", "part", F.inline("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, keys, group = None, [], []
        ids, marks, arrow = [], [], None
        mark = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

        def close() -> None:
            if len(group) > 1 or group and group[0][1] > 1:
                for (id_, part), (at, _, _), own in zip(keys, group, _deep(group, window)):
                    if own:
                        ids.append((id_, part))
                        marks.append(_ranges(sorted(at + k for k in own)))

        def out() -> pa.RecordBatch:
            columns = list(zip(*ids)) if ids else [(), ()]
            made = pa.RecordBatch.from_arrays(
                [pa.array(columns[0], arrow), pa.array(columns[1], pa.int64()), pa.array(marks, mark)], ["id", "part", "marks"]
            )
            ids.clear()
            marks.clear()
            return made

        for batch in batches:
            arrow = batch.schema.field("id").type
            columns = (batch.column(c).to_pylist() for c in ("id", "part", "anchor", "at", "n", "words"))
            for id_, part, anchor, at, n, words in zip(*columns):
                if anchor != key:
                    close()
                    key, keys, group = anchor, [], []
                keys.append((id_, part))
                group.append((at, n, words))
            if len(ids) > 5_000:
                yield out()
        close()
        if ids:
            yield out()

    ordered = rows.repartition("anchor").sortWithinPartitions("anchor")
    return ordered.mapInArrow(run, f"id {_kind(rows)}, part long, marks {MARKS}")


def _ranges(at: list[int]) -> list[dict]:
    out: list[dict] = []
    for a in at:
        if out and a == out[-1]["last"] + 1:
            out[-1]["last"] = a
        else:
            out.append({"first": a, "last": a})
    return out


def _counted(suffixes: DataFrame) -> DataFrame:
    """(id, part, marks) of suffixes whose prefix is the whole window, where the node has several leaves.

    Places with the same words around them are counted first: all their suffixes repeat, and they are marked as a range.
    Of each such place one goes on, so the windows that are compared are those of different surroundings. Those that come
    again in their own document are marked there already.
    """
    rows = suffixes.where("leaves is not null").select("id", "part", F.inline("leaves"))
    place = F.struct("id", "part", "at").alias("place")
    distinct = keep(rows.groupBy("first", "second").agg(F.sum("places").alias("copies"), F.min(place).alias("place"), F.first("windows").alias("windows")))
    copied = distinct.where("copies > 1").select("first", "second")
    whole = rows.where("places = 1").select("id", "part", "at", "n", "first", "second").join(copied, ["first", "second"], "left_semi")
    whole = whole.select("id", "part", F.col("at").alias("start"), (F.col("at") + F.col("n") - 1).alias("end"))
    leaves = distinct.select("copies", "place", F.posexplode("windows").alias("k", "window")).select("copies", "place", "k", "window.*")
    nodes = leaves.groupBy("prefix", "content").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    single = leaves.where("copies = 1").join(nodes, ["prefix", "content"], "left_semi")
    at = F.col("place.at") + F.col("k")
    single = single.select("place.id", "place.part", at.alias("start"), at.alias("end"))
    mark = F.struct(F.col("start").alias("first"), F.col("end").alias("last"))
    return whole.unionByName(single).groupBy("id", "part").agg(F.collect_list(mark).alias("marks"))


def _cut(texts: DataFrame, window: int) -> DataFrame:
    """Takes the marked windows out of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        plain = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            sizes, removed, spans, texts = [], [], [], []
            for packed, copy, at in zip(*(batch.column(c) for c in ("packed", "copy", "at"))):
                text = plain(packed.as_py())
                words = text.split()
                sizes.append(len(words))
                if copy.as_py() and len(words) >= window:
                    runs = [(0, len(words))]
                else:
                    runs = _runs([(m["first"], m["last"]) for m in at.as_py() or []], window)
                spans.append([{"start": a, "end": b} for a, b in runs])
                removed.append(sum(b - a for a, b in runs))
                if runs:
                    gaps = zip([0, *(b for _, b in runs)], [*(a for a, _ in runs), len(words)])
                    text = b" ".join(w for a, b in gaps for w in words[a:b])
                texts.append(text.decode())
            span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                    pa.array(spans, pa.list_(span)), pa.array(texts, pa.string()),
                ],
                ["doc_id", "n_words", "n_removed", "spans", "kept_text"],
            )

    return texts.mapInArrow(
        run,
        f"doc_id {_kind(texts)}, n_words long, n_removed long, spans array<struct<start: long, end: long>>, kept_text string",
    )


def _runs(marks: list[tuple[int, int]], window: int) -> list[tuple[int, int]]:
    """The word ranges that the windows of these ranges of suffixes cover."""
    runs: list[tuple[int, int]] = []
    for first, last in sorted(marks):
        if runs and first <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(runs[-1][1], last + window))
        else:
            runs.append((first, last + window))
    return runs


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per document: ``n_words``, ``n_removed``, ``spans`` (removed word ranges) and ``kept_text``.

    Removed are the words covered by a window of ``window`` words that also starts anywhere else, in the same
    document too; all windows are judged on the input. A null text has no words. Rows that repeat an id are
    documents of their own, as are rows without an id. Texts below ``window`` words stay. An empty table gives no rows. Other columns are dropped.
    """
    rows = narrow(docs, id_col, text_col)
    found = keep(_scan(rows, window, anchor))
    classes = found.where(F.col("n_words") >= window).groupBy("digest").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first(F.arrays_zip("anchor", "places", "suffixes")).alias("anchors")
    )
    anchors = classes.select("id", F.xxhash64("digest").alias("part"), F.inline("anchors"))
    shared = _shared(anchors, group_rows)
    texts = _squeezed(rows).select("id", F.xxhash64("digest").alias("part"), "packed")
    own = texts["id"].eqNullSafe(shared["id"]) & (texts["part"] == shared["part"])
    anchored = texts.join(shared, own).select(texts["id"], texts["part"], "packed", "shared", "frequent")
    folder = fresh_path(docs.sparkSession, "suffixes")
    split = _suffix_rows(anchored, window, anchor)
    split.write.option("compression", "zstd").parquet(folder)
    suffixes = docs.sparkSession.read.schema(split.schema).parquet(folder)
    marked = suffixes.where("marks is not null").select("id", "part", "marks")
    found_marks = _gathered(suffixes, window).unionByName(_counted(suffixes)).unionByName(marked)
    cuts = found_marks.groupBy("id", "part").agg(F.flatten(F.collect_list("marks")).alias("at"))
    copied = found.join(classes.where("copies > 1").select("digest"), "digest", "left_semi")
    copied = copied.select("id", F.xxhash64("digest").alias("part"), F.lit(True).alias("copy")).distinct()
    marks = (
        cuts.select("id", "part", "at", F.lit(False).alias("copy"))
        .unionByName(copied.withColumn("at", F.lit(None).cast(MARKS)))
        .groupBy("id", "part")
        .agg(F.max("copy").alias("copy"), F.first("at", ignorenulls=True).alias("at"))
    )
    own = texts["id"].eqNullSafe(marks["id"]) & (texts["part"] == marks["part"])
    joined = texts.join(marks, own, "left").select(texts["id"], "packed", "copy", "at")
    return _cut(joined, window)


def _shared(anchors: DataFrame, group_rows: int) -> DataFrame:
    """Per document its anchors with several places, and those of them with more than ``group_rows`` suffixes.

    One shuffle serves the counts and the join that gives them back.
    """
    dealt = anchors.repartition("anchor")
    counts = dealt.groupBy("anchor").agg(F.sum("places").alias("n"), F.sum("suffixes").alias("all"))
    joined = dealt.drop("places", "suffixes").join(counts.where("n > 1"), "anchor")
    return joined.groupBy("id", "part").agg(
        F.collect_list("anchor").alias("shared"),
        F.collect_list(F.when(F.col("all") > group_rows, F.col("anchor"))).alias("frequent"),
    )

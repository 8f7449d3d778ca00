"""Jaccard join on word n-grams, exact, in size-banded tiles with bitmap bounds.

1. Documents become sets of shingles (64-bit hashes). Equal sets form a class, which gets a number; ids come in again
   only at the end, so rows that repeat an id or have none take part like all others.
2. Two sets that link differ in at most k shingles, k following from their sizes. In a band of sizes, shingles are
   dealt by their hash to more than k buckets, so linked sets agree in whole buckets. A tile is a band, a bucket
   and its content. Buckets of under two shingles say little; they are left out where enough others remain that
   one must agree, which is so for all but a few sets. Where the threshold is low, buckets would be that small;
   then the lowest hashes of a set are its tiles, so many that linked sets share one of them.
3. In each tile every set is compared with a leader. Tiles whose sets are then not all in one component get a few
   more leaders; what then still is apart is compared within the tile, in blocks of bounded size, over bands of
   sizes that can link. So no pair is lost, copies cost no square, and only pairs that pass the bitmaps are listed.
4. A pair is first judged by bitmaps of hashed shingles: bits that only one side has bound the overlap from
   above. What passes is decided on the sorted shingle arrays themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.components import components
from leafmill.llm.words import Memo, narrow, text_digest
from leafmill.operators.joins import broadcast_if_small
from leafmill.session import keep

WORDS, PERCENT = 3, 90
BAND = 1.5  # ratio of the sizes at the ends of a band
SPARE = 1.15  # buckets over the least number, so that light ones can be left out
LIGHT = 2  # buckets of fewer shingles are light
LEAST_BUCKET = 8  # shingles per differing one, from which on buckets are used
# Mixed tiles get more leaders while they hold more pairs than this per member, and so many times at most.
PAIRS_PER_MEMBER, LEADERS = 64, 3
EARLIER = 4  # tiles before the present one that a set carries along
NAMED = 2_000_000  # numbers of sets that are broadcast to choose their texts
BLOCK = 2048  # sets of a tile that are compared in one group

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_SHIFT = np.uint64(33)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _SHIFT)) * _MIX[0]
    x = (x ^ (x >> _SHIFT)) * _MIX[1]
    return x ^ (x >> _SHIFT)


class Shingler:
    """Sorted distinct shingle hashes of a text."""

    def __init__(self, words: int):
        import xxhash

        self.words = words
        self.hash = Memo(xxhash.xxh3_64_intdigest)

    def __call__(self, text: str) -> np.ndarray:
        found = text.encode().translate(_LOWER).split()
        if not found:
            return np.zeros(0, np.uint64)
        ids = np.fromiter(map(self.hash.__getitem__, found), np.uint64, len(found))
        size = min(self.words, len(found))
        n = len(ids) - size + 1
        out = np.full(n, size, np.uint64)
        for k in range(size):
            out = _mix(out * _MIX[0] + ids[k : k + n])
        return np.unique(out)


def _band(n: int) -> int:
    return int(math.log(n) / math.log(BAND) + 1e-9)


class Tiler:
    """Bucket signatures of a set in the bands where a partner can be."""

    def __init__(self, percent: int):
        self.percent = percent
        self.buckets = Memo(self._buckets)

    def _buckets(self, band: int) -> tuple[int, int]:
        """Most differing shingles of linked sets in this band, and the number of buckets."""
        upper = math.ceil(BAND ** (band + 1))  # smaller sets of the band's pairs stay below
        larger = upper * 100 // self.percent
        k = (100 - self.percent) * (upper + larger) // (100 + self.percent)
        return k, math.ceil((k + 1) * SPARE)

    def bands(self, n: int) -> list[int]:
        """The own band, and the one below if a smaller partner can lie in it."""
        own = _band(n)
        lower = _band(max(1, -(-n * self.percent // 100)))
        return list(range(min(lower, own), own + 1))

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        if (100 + self.percent) // (2 * (100 - self.percent)) < LEAST_BUCKET:
            return shingles[: len(shingles) - -(-len(shingles) * self.percent // 100) + 1]
        mixed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(shingles + np.uint64(1)))])
        out = []
        for band in self.bands(len(shingles)):
            k, m = self.buckets[band]
            if not k:  # linked sets are equal here, and equal sets are one class
                continue
            bucket = ((shingles >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            edges = np.searchsorted(bucket, np.arange(m + 1, dtype=np.uint64))
            sums = mixed[edges[1:]] - mixed[edges[:-1]]
            tag = np.arange(m, dtype=np.uint64) + np.uint64(band << 32)
            signature = _mix(sums ^ _mix(tag))
            heavy = np.diff(edges) >= LIGHT
            if np.count_nonzero(heavy) > k:
                signature = signature[heavy]
            out.append(signature)
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def bitmap(shingles: np.ndarray) -> bytes:
    """One bit per hash, in a power of two of at least twice as many bits as shingles."""
    bits = max(64, 1 << (2 * len(shingles) - 1).bit_length())
    out = np.zeros(bits // 8, np.uint8)
    at = shingles & np.uint64(bits - 1)
    np.bitwise_or.at(out, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
    return out.tobytes()


def overlap_bound(a: bytes, n_a: int, b: bytes, n_b: int) -> int:
    """No two sets with these bitmaps and sizes share more."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    return min(n_a - int(np.bitwise_count(x & ~y).sum()), n_b - int(np.bitwise_count(y & ~x).sum()))


def _enough(overlap: int, n_a: int, n_b: int, percent: int) -> bool:
    return 100 * overlap >= percent * (n_a + n_b - overlap)


def sets(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Per document: number of shingles, class of its set, tile signatures, bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingle, tile = Shingler(words), Tiler(percent)
        for batch in batches:
            sizes, classes, tiles, bits = [], [], [], []
            for text in batch.column("text"):
                found = shingle(text.as_py())
                sizes.append(len(found))
                classes.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                tiles.append(tile(found).view(np.int64) if len(found) else np.zeros(0, np.int64))
                bits.append(bitmap(found) if len(found) else None)
            ends = np.cumsum([0, *map(len, tiles)], dtype=np.int32)
            values = np.concatenate(tiles) if tiles else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), batch.column("digest"), pa.array(sizes, pa.int32()), pa.array(classes, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(values)), pa.array(bits, pa.binary()),
                ],
                ["id", "digest", "n", "class", "tiles", "bits"],
            )

    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {id_type}, digest binary, n int, class binary, tiles array<long>, bits binary")


def _squeezed(rows: DataFrame) -> DataFrame:
    """Texts compressed, for a join that moves them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            out = pa.array([squeeze(t.as_py().encode()) for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), out], ["id", "digest", "packed"])

    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {id_type}, digest binary, packed binary")


def _passing(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose bitmaps allow enough overlap."""
    side = lambda s: bits.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(2, 6)]
            fits = [_enough(overlap_bound(x, n, y, m), n, m, percent) for n, m, x, y in zip(*columns)]
            yield batch.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    return joined.mapInArrow(run, f"a {kind}, b {kind}")


def _linked(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs whose sets share enough, by their sorted arrays. Only texts of sets in ``pairs`` are moved."""
    texts = texts.join(_named(pairs), "id", "left_semi")
    side = lambda s: texts.select(F.col("id").alias(s), F.col("packed").alias(f"text_{s}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        one, plain = Shingler(words), zstandard.ZstdDecompressor().decompress
        shingles = Memo(lambda packed: one(plain(packed).decode()), 64)  # a leader's rows stand together
        for batch in batches:
            links = []
            for x, y in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()):
                left, right = shingles[x], shingles[y]
                overlap = len(np.intersect1d(left, right, assume_unique=True))
                links.append(_enough(overlap, len(left), len(right), percent))
            yield batch.select(["a", "b"]).filter(pa.array(links, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    return joined.mapInArrow(run, f"a {kind}, b {kind}")


def _named(pairs: DataFrame) -> DataFrame:
    """The sets in ``pairs``, once, for a broadcast unless they are very many."""
    both = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return broadcast_if_small(keep(both), NAMED)


def link(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT,
    pairs_per_member: int | None = None,
) -> DataFrame:
    """One row per document: ``n_shingles`` and ``component_id``, the smallest id it is linked with over any path.

    Two sets link when ``100 * overlap >= percent * union``. A text without words has no set and no links. Rows
    that repeat an id, with one text or several, and rows without an id are documents of their own; a component without
    any id has none. Mixed tiles get more leaders while they hold more pairs than ``pairs_per_member`` a set; a low number
    suits low similarities, where a set is in many tiles. ``component`` numbers the components of this run (null without words), ``digest`` (``text_digest``)
    tells rows of one id apart. An empty table gives no rows. Other columns are dropped.
    """
    rows = narrow(docs, id_col, text_col).withColumn("digest", text_digest(F.col("text")))
    found = keep(sets(rows, words, percent))
    classes = found.where("class is not null").groupBy("class").agg(
        F.min("id").alias("least"), F.min(F.struct("id", "digest")).alias("row"), F.first("tiles").alias("tiles"),
        F.first("n").alias("n"), F.first("bits").alias("bits"),
    )
    classes = _numbered(keep(classes))
    members = keep(_members(classes.select("id", "tiles")))
    # Texts move once, one for each class that shares a tile with another.
    sharing = members.select("id").distinct()
    shared = keep(classes.select("id", "n", "bits", "row").join(sharing, "id", "left_semi"))
    wanted = shared.select(F.col("id").alias("node"), _row_key(F.col("row.id"), F.col("row.digest")).alias("row_key"))
    squeezed = _squeezed(rows).select(_row_key(F.col("id"), F.col("digest")).alias("row_key"), "packed")
    texts = keep(squeezed.join(wanted, "row_key").dropDuplicates(["row_key"]).select(F.col("node").alias("id"), "packed"))
    bits = shared.select("id", "n", "bits")

    def linked(pairs: DataFrame) -> DataFrame:
        return keep(_linked(keep(_passing(pairs, bits, percent)), texts, words, percent))

    pairs = members.where("id <> led").select(F.col("led").alias("a"), F.col("id").alias("b")).distinct()
    links = linked(pairs)
    roots = components(links)
    for left in range(LEADERS, -1, -1):
        members = keep(_mixed(members.where("id > led"), roots))
        sets_left, pairs_left = _cross_pairs(members)
        if not sets_left:
            break
        if not left or pairs_left <= (PAIRS_PER_MEMBER if pairs_per_member is None else pairs_per_member) * sets_left:
            pairs = keep(_tile_pairs(members, bits, percent).distinct())
            found_links = keep(_linked(pairs, texts, words, percent))
            if not found_links.isEmpty():
                roots = components(links.unionByName(found_links))
            break
        members = members.repartition("tile")  # for the leaders and the join that gives them back
        leaders = members.groupBy("tile").agg(F.min_by(F.struct("id", "root"), "id").alias("first"))
        led = members.drop("led").join(leaders, "tile").withColumn("led", F.col("first.id"))
        pairs = led.where("root <> first.root").select(F.col("led").alias("a"), F.col("id").alias("b")).distinct()
        found_links = linked(pairs)
        members = led.select("tile", "id", "led")
        if not found_links.isEmpty():
            links = keep(links.unionByName(found_links))
            roots = components(links)
    # Of classes to components, and of these to their smallest id.
    placed = classes.select("class", "id", "least").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = placed.select("class", "root").join(smallest, "root")
    return found.select("id", "digest", "n", "class").join(placed, "class", "left").select(
        F.col("id").alias("doc_id"),
        F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.col("root").alias("component"),
        "digest",
    )


def _row_key(id_: Column, digest: Column) -> Column:
    """Id and digest of a row as one value, never null, so that one shuffle serves a join and the removal of repeats."""
    return F.concat(digest, F.coalesce(id_.cast("string"), F.lit("")).cast("binary"))


def _numbered(classes: DataFrame) -> DataFrame:
    """Classes with a number ``id``: their smallest document id, so that leaders of tiles tend to be first copies.

    Classes that share it with others (rows that repeat an id) or have none get numbers of their own beyond all ids.
    """
    if not isinstance(classes.schema["least"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return keep(classes.withColumn("id", F.monotonically_increasing_id()))
    least = F.col("least").cast("long")
    again = classes.groupBy("least").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or least is null")
    again = keep(again.select(F.col("least").alias("again"), F.lit(True).alias("other")))
    if again.isEmpty():
        return classes.withColumn("id", least)
    beyond = (classes.agg(F.max(least)).first()[0] or 0) + 1
    marked = classes.join(broadcast_if_small(again), F.col("least").eqNullSafe(F.col("again")), "left")
    number = F.when(F.col("other"), F.lit(beyond) + F.monotonically_increasing_id()).otherwise(least)
    return keep(marked.withColumn("id", number).drop("again", "other"))


def _members(sets_of_classes: DataFrame) -> DataFrame:
    """Sets in tiles of two or more, each with its tile's first leader (tile, id, led).

    One shuffle serves the leaders and the join that gives them to the members.
    """
    tiles = sets_of_classes.select("id", F.explode("tiles").alias("tile")).repartition("tile")
    leaders = tiles.groupBy("tile").agg(F.min("id").alias("led"), F.max("id").alias("last")).where("led < last")
    return tiles.join(leaders.select("tile", "led"), "tile").select("tile", "id", "led")


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of tiles in which not all are in one component, with their ``root``."""
    marked = members.join(roots, "id", "left").select("tile", "id", "led", F.coalesce("root", "id").alias("root"))
    mixed = marked.groupBy("tile").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y")
    return marked.join(mixed.select("tile"), "tile", "left_semi")


def _cross_pairs(members: DataFrame) -> tuple[int, int]:
    """Number of members and of pairs of them in a tile and in different components."""
    groups = members.groupBy("tile", "root").agg(F.count(F.lit(1)).alias("n"))
    tiles = groups.groupBy("tile").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    found = tiles.agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("squares")) / 2)).first()
    return found[0] or 0, int(found[1] or 0)


def _tile_pairs(members: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) in a tile and in different components whose bitmaps allow enough overlap.

    A tile of several blocks is compared block by block, each pair of blocks being a group of its own. Each set knows
    its ``EARLIER`` tiles before this one: two sets that have one of them in common were compared there, so similar sets
    are not listed again in every tile they share.
    """
    before = Window.partitionBy("id").orderBy("tile").rowsBetween(-EARLIER, -1)
    members = members.withColumn("earlier", F.collect_list("tile").over(before))
    blocks = members.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    rows = members.select("tile", "id", "root", "earlier").join(blocks, "tile").join(bits, "id")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = ["tile", "x", "y"]
    dealt = rows.select(
        "tile", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "id", "root", "own", "n", "bits", "earlier"
    )
    dealt = dealt.repartition(*group).sortWithinPartitions(*group, "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, held, key = None, [], None
        for batch in batches:
            kind = batch.schema.field("id").type
            for tile, x, y, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (tile, x, y) != key:
                    if len(held) > 1:
                        yield _pairs_batch(held, key[1] != key[2], percent, kind)
                    key, held = (tile, x, y), []
                held.append(row)
        if len(held) > 1:
            yield _pairs_batch(held, key[1] != key[2], percent, kind)

    kind = members.schema["id"].dataType.simpleString()
    return dealt.mapInArrow(run, f"a {kind}, b {kind}")


def _pairs_batch(held: list[list], across: bool, percent: int, kind: pa.DataType) -> pa.RecordBatch:
    """Passing pairs of one group: rows of (id, root, block, size, bitmap, earlier tiles) in the order of size."""
    ids, roots, own, sizes, maps, earlier = zip(*held)
    tiles = np.zeros((len(earlier), EARLIER), np.int64)
    known = np.zeros((len(earlier), EARLIER), bool)
    for i, listed in enumerate(earlier):
        tiles[i, : len(listed)], known[i, : len(listed)] = listed, True
    roots, own, n = np.array(roots), np.array(own), np.array(sizes, dtype=np.int64)
    last = np.searchsorted(n, n * 100 // percent, side="right")  # larger sets cannot link
    by_words: dict[int, np.ndarray] = {}
    words = np.array([len(m) // 8 for m in maps])
    for w in set(words.tolist()):  # all sets at this width; wider bitmaps folded, narrower ones left empty
        table = np.zeros((len(maps), w), np.uint64)
        for i in np.flatnonzero(words >= w):
            if words[i] <= 4 * w:
                table[i] = np.bitwise_or.reduce(np.frombuffer(maps[i], np.uint64).reshape(-1, w), axis=0)
        by_words[w] = table
    a, b = [], []
    for i in range(len(ids)):
        j = slice(i + 1, last[i])
        table = by_words[words[i]]
        x, y = table[i], table[j]
        bound = np.minimum(
            n[i] - np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64), n[j] - np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64)
        )
        fits = (100 * bound >= percent * (n[i] + n[j] - bound)) & (roots[j] != roots[i])
        if across:
            fits &= own[j] != own[i]
        passing = np.flatnonzero(fits) + i + 1
        if len(passing) and known[i].any():
            shared = (tiles[passing][:, :, None] == tiles[i, known[i]]) & known[passing][:, :, None]
            passing = passing[~shared.any(axis=(1, 2))]
        for k in passing:
            a.append(min(ids[i], ids[k]))
            b.append(max(ids[i], ids[k]))
    return pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], ["a", "b"])

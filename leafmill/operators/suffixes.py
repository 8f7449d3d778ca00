"""Suffix order, shared prefixes and repeated substrings of texts of any size, by prefix multiplying over the cluster.

Suffixes are rows (text, position, rank); no text is held in one task. At first a suffix is ranked by its block of
``BLOCK`` characters. A round looks up the ranks ``1, 2, 3`` block lengths further on and ranks the suffixes that
are still tied by them, so the block grows by ``GROWTH`` and the rounds follow the logarithm of the longest repeat.
Equal rank means equal block; only tied rows of a round are kept, and from them the length that two neighbours share
is put together, longest blocks first.

Inner nodes of the suffix tree are intervals of shared lengths. Slices of consecutive suffixes close what begins and
ends inside; what stays open are the smallest values so far from either end, which go on to slices of many slices.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators.ordering import GROUP_ROWS, SLICE_ROWS, Arranged, arrange, has_large_group, match
from leafmill.session import keep

BLOCK = 16  # characters of the first rank
GROWTH = 4  # block lengths that a round puts together
PIECE = 256  # characters a text is cut into
SLICE = 65_536  # suffixes whose shared lengths are read by one task at a time
SLICES = 64  # slices whose open rows go on together


def pieces(texts: DataFrame, text: str, reach: int) -> DataFrame:
    """Overlapping pieces (``_from``, ``_piece``, ``_here`` own characters) of each row's text.

    Taking a substring costs time in its distance from the start, so long texts are cut before characters are asked for.
    """
    size = F.char_length(F.col(text))
    rest = [F.col(c) for c in texts.columns if c != text]
    starts = F.explode(F.sequence(F.lit(0), size - 1, F.lit(PIECE))).alias("_from")
    found = texts.where(size > 0).select(*rest, F.col(text), size.alias("_n"), starts)
    return found.select(
        *rest, "_n", "_from",
        F.substring(F.col(text), F.col("_from") + 1, F.lit(PIECE + reach)).alias("_piece"),
        F.least(F.col("_n") - F.col("_from"), F.lit(PIECE)).alias("_here"),
    )


class Ranked:
    """Suffixes (``_g`` group, ``_t`` text, ``_n`` its length, ``pos``, ``block``, ``rank`` from 0 within the group).

    ``levels`` holds per round the block length and the tied rows with their rank at that length.
    """

    def __init__(self, rows: DataFrame, levels: list[tuple[int, DataFrame]], large: bool):
        self.rows, self.levels, self.large = rows, levels, large


def rank(texts: DataFrame, group_rows: int = GROUP_ROWS, slice_rows: int = SLICE_ROWS) -> Ranked:
    """Suffixes of ``texts`` (``_g``, ``_t``, ``_text``; one row per ``_t``) in order within their group.

    A text that ends comes before one that goes on; equal suffixes of several texts are ordered by ``_t``, as if every
    text ended with a symbol of its own. Null and empty texts have no suffixes.
    """
    placed = pieces(texts, "_text", BLOCK).withColumn("_i", F.explode(F.sequence(F.lit(1), "_here")))
    suffixes = keep(
        placed.select(
            "_g", "_t", "_n", (F.col("_from") + F.col("_i") - 1).alias("pos"),
            F.substring("_piece", F.col("_i"), F.lit(BLOCK)).alias("block"),
        )
    )
    large = has_large_group(suffixes, ["_g"], group_rows)
    tied = _renumbered(suffixes, ["_g"], ["block"], F.lit(0), group_rows, slice_rows)
    length, levels, settled = BLOCK, [], []
    while True:
        tied = keep(tied)
        settled.append(tied.where("_size = 1").drop("_size"))
        same = tied.where("_size > 1")
        if same.isEmpty():
            break
        levels.append((length, same.select("_t", "pos", "rank")))
        whole = F.col("pos") + length > F.col("_n")  # tied with all there is of it
        ends = same.where(whole)
        going = same.where(~whole).drop("_size")
        known = same.select("_t", "pos", "rank")
        for part in settled:
            known = known.unionByName(part.select("_t", "pos", "rank"))
        if not ends.isEmpty():
            settled.append(keep(_by_text(ends.drop("_size"), group_rows, slice_rows)))
        if going.isEmpty():
            break
        names = [f"_r{k}" for k in range(1, GROWTH)]
        # One join: a rank is asked for by the suffixes 1, 2, 3 block lengths before it.
        asked = going.select("_t", F.col("pos").alias("_of"), F.posexplode(F.array(*[F.col("pos") + k * length for k in range(1, GROWTH)])).alias("_k", "pos"))
        ahead = asked.join(known, ["_t", "pos"]).groupBy("_t", "_of").agg(
            *[F.max(F.when(F.col("_k") == k - 1, F.col("rank"))).alias(f"_r{k}") for k in range(1, GROWTH)]
        )
        going = going.join(ahead.withColumnRenamed("_of", "pos"), ["_t", "pos"], "left")
        going = going.withColumns({n: F.coalesce(n, F.lit(-1)) for n in names})
        tied = _renumbered(going, ["_g", "rank"], names, F.col("rank"), group_rows, slice_rows).drop(*names)
        length *= GROWTH
    rows = settled[0]
    for part in settled[1:]:
        rows = rows.unionByName(part.select(rows.columns))
    return Ranked(keep(rows), levels, large)


def _renumbered(rows: DataFrame, keys: list[str], by: list[str], base: Column, group_rows: int, slice_rows: int) -> DataFrame:
    """``rank`` as ``base`` plus the rows of ``keys`` that are smaller in ``by``, and the number of equal ones, ``_size``.

    Equal rows are counted before anything is ordered, so a block of very many suffixes is one row.
    """
    sizes = keep(rows.groupBy(*keys, *by).agg(F.count(F.lit(1)).alias("_size")))
    ordered = arrange(sizes, keys, [F.col(c) for c in by], "_nr", group_rows, slice_rows)
    totals = ordered.running_total(F.col("_size"), "_upto").df
    new = totals.select(*keys, *by, "_size", (base + F.col("_upto") - F.col("_size")).alias("_new"))
    joined = rows.join(new, [*keys, *by])  # no key is null
    return joined.drop("rank").withColumnRenamed("_new", "rank")


def _by_text(ends: DataFrame, group_rows: int, slice_rows: int) -> DataFrame:
    """Equal whole suffixes, numbered by their text."""
    ordered = arrange(ends, ["_g", "rank"], [F.col("_t")], "_nr", group_rows, slice_rows).df
    return ordered.withColumn("rank", F.col("rank") + F.col("_nr") - 1).drop("_nr")


def neighbours(ranked: Ranked, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Adds ``shared``, the characters a suffix has in common with the one before it in its group (0 for the first)."""
    placed = Arranged(ranked.rows.withColumn("_nr", F.col("rank") + 1), ("_g",), "_nr", ranked.large, slice_rows)
    rows = placed.lag({"_t0": "_t", "_n0": "_n", "_pos0": "pos", "_block0": "block"}).df.drop("_nr")
    first = F.col("_t0").isNull()
    rows = keep(rows.withColumn("shared", F.when(first, 0).otherwise(_common("block", "_block0"))))
    far = rows.where(F.col("shared") == BLOCK)
    near = rows.where(F.col("shared") < BLOCK)
    if not ranked.levels:
        return near.select("_g", "_t", "pos", "rank", "shared")
    far = far.withColumn("_done", F.lit(0))
    for length, tied in reversed(ranked.levels):
        for _ in range(GROWTH - 1):
            far = _further(far, tied, length)
        far = keep(far)
    blocks = ranked.rows.select("_t", "pos", "block")
    far = _beside(far.drop("block", "_block0"), blocks, "block", "left")
    done = F.col("_done") + F.coalesce(_common("block", "_block0"), F.lit(0))
    far = far.withColumn("shared", F.least(done, F.col("_n") - F.col("pos"), F.col("_n0") - F.col("_pos0")))
    columns = ["_g", "_t", "pos", "rank", "shared"]
    return near.select(columns).unionByName(far.select(columns))


def _beside(pairs: DataFrame, table: DataFrame, value: str, how: str) -> DataFrame:
    """``value`` of ``table`` at the place that either side of a pair has come to, the other one's under ``_value0``."""
    for t, pos, name in (("_t", "pos", value), ("_t0", "_pos0", f"_{value}0")):
        side = table.select(F.col("_t").alias("_x"), F.col("pos").alias("_y"), F.col(value).alias(name))
        at = (F.col(t) == F.col("_x")) & (F.col(pos) + F.col("_done") == F.col("_y"))
        pairs = pairs.join(side, at, how).drop("_x", "_y")
    return pairs


def _further(pairs: DataFrame, tied: DataFrame, length: int) -> DataFrame:
    """Pairs go on by ``length`` where the blocks of that length are the same."""
    found = _beside(pairs, tied.withColumnRenamed("rank", "_rank"), "_rank", "left")
    same = F.coalesce(F.col("_rank") == F.col("__rank0"), F.lit(False))
    return found.withColumn("_done", F.col("_done") + F.when(same, length).otherwise(0)).drop("_rank", "__rank0")


def _common(a: str, b: str) -> Column:
    """Characters that two blocks share at their start."""
    n = F.sequence(F.lit(1), F.lit(BLOCK + 1))
    past = lambda i: (i > F.char_length(a)) | (i > F.char_length(b))
    differs = F.transform(n, lambda i: past(i) | (F.substring(F.col(a), i, F.lit(1)) != F.substring(F.col(b), i, F.lit(1))))
    return (F.array_position(differs, F.lit(True)) - 1).cast("int")


def nodes(placed: DataFrame, slice_rows: int = SLICE, slices: int = SLICES) -> DataFrame:
    """Inner nodes of each group's suffix tree but the root: (``_g``, ``_t``, ``pos``, ``rank``, ``length``, ``freq``).

    ``placed`` is what ``neighbours`` gives. A node is where its substring stands, how long it is, and how often it
    occurs; ``rank`` tells nodes of a group apart. Long stretches of one repeated character keep a row open each.
    """
    ends = placed.groupBy("_g").agg((F.max("rank") + 1).alias("rank"))
    none = F.lit(None).cast("long")
    closing = ends.select("_g", none.alias("_t"), F.lit(-1).alias("pos"), "rank", F.lit(0).alias("shared"))
    rows = placed.select("_g", "_t", F.col("pos").cast("int").alias("pos"), "rank", F.col("shared").cast("int").alias("shared"))
    rows = rows.unionByName(closing.withColumn("pos", F.col("pos").cast("int")))
    size, found = slice_rows, None
    while True:
        sliced = rows.withColumn("_slice", F.floor(F.col("rank") / size).cast("long"))
        read = keep(_slices_read(sliced.repartition("_g", "_slice").sortWithinPartitions("_g", "_slice", "rank")))
        closed = read.where("freq is not null").select("_g", "_t", "pos", "rank", F.col("shared").alias("length"), "freq")
        found = closed if found is None else found.unionByName(closed)
        # A group whose open rows are only the borders of its tree is done.
        rows = read.where("freq is null").drop("freq")
        open_groups = rows.where("shared > 0").select("_g").distinct()
        if open_groups.isEmpty():
            return found
        rows = rows.join(open_groups, "_g", "left_semi")
        size *= slices


def _slices_read(rows: DataFrame) -> DataFrame:
    """Closed nodes of each slice, with ``freq``, and its open rows, without."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, stack, out, lefts = None, [], [], 0

        def finish() -> None:
            """What is still on the stack has no smaller value to its right."""
            for value, _, row, last in stack:
                out.append((*row, None))
                if last[3] != row[3]:
                    out.append((*last, None))
            stack.clear()

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["_g", "_t", "pos", "rank", "shared", "freq"])
            out.clear()
            return made

        for batch in batches:
            for slice_, *row in zip(*(batch.column(c).to_pylist() for c in ("_slice", "_g", "_t", "pos", "rank", "shared"))):
                row = tuple(row)
                if (row[0], slice_) != key:
                    finish()
                    key = (row[0], slice_)
                value, here = row[4], row[3]
                # An entry: value, where it began (None: before this slice), its first row, its last row.
                while stack and stack[-1][0] > value:
                    was, began, first, _ = stack.pop()
                    out.append((*first, None if began is None else here - began))
                if stack and stack[-1][0] == value:
                    stack[-1][3] = row
                else:
                    stack.append([value, stack[-1][3][3] if stack else None, row, row])
            if len(out) > 20_000:
                yield batch_of()
        finish()
        if out:
            yield batch_of()

    return rows.mapInArrow(run, "_g long, _t long, pos int, rank long, shared int, freq long")


def substrings(found: DataFrame, texts: DataFrame) -> DataFrame:
    """``found`` with ``gram``, the characters of each node, from ``texts`` (``_t``, ``_text``).

    A node within the reach of one piece is cut out of it; a longer one is put together from the pieces it covers.
    """
    cut = pieces(texts.select("_t", "_text"), "_text", PIECE).withColumn("_nr", (F.col("_from") / PIECE).cast("int"))
    start = (F.col("pos") / PIECE).cast("int")
    offset = F.col("pos") % PIECE
    short = found.where(F.col("length") <= PIECE).withColumn("_nr", start).join(cut.select("_t", "_nr", "_piece"), ["_t", "_nr"])
    short = short.withColumn("gram", F.substring("_piece", offset + 1, F.col("length"))).drop("_nr", "_piece")
    long = found.where(F.col("length") > PIECE)
    last = ((F.col("pos") + F.col("length") - 1) / PIECE).cast("int")
    spread = long.withColumn("_nr", F.explode(F.sequence(start, last))).join(cut.select("_t", "_nr", "_piece"), ["_t", "_nr"])
    begin = F.greatest(F.col("pos") - F.col("_nr") * PIECE, F.lit(0))
    end = F.least(F.col("pos") + F.col("length") - F.col("_nr") * PIECE, F.lit(PIECE))
    parts = spread.withColumn("_part", F.substring("_piece", begin + 1, end - begin))
    whole = parts.groupBy(*found.columns).agg(F.sort_array(F.collect_list(F.struct("_nr", "_part"))).alias("_parts"))
    whole = whole.withColumn("gram", F.array_join(F.col("_parts._part"), "")).drop("_parts")
    return short.unionByName(whole.select(short.columns))


def numbered(texts: DataFrame, text: str, keys: Sequence[str] | None) -> tuple[DataFrame, DataFrame]:
    """Texts as (``_g``, ``_t``, ``_text``), and the ``keys`` of each group; ``None`` makes each row a group."""
    rows = texts.select(*(keys or []), F.col(text).alias("_text")) if keys is not None else texts.withColumnRenamed(text, "_text")
    rows = keep(rows.withColumn("_t", F.monotonically_increasing_id()))
    if keys is None:
        return rows.select(F.col("_t").alias("_g"), "_t", "_text"), rows.drop("_text").withColumnRenamed("_t", "_g")
    if not keys:
        return rows.select(F.lit(0).cast("long").alias("_g"), "_t", "_text"), rows.sparkSession.range(1).withColumnRenamed("id", "_g")
    groups = keep(rows.groupBy(*keys).agg(F.min("_t").alias("_g")))
    return match(rows, groups, list(keys), "inner").select("_g", "_t", "_text"), groups

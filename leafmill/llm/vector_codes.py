"""Product quantisation of integer vectors, with nearest entries found by Orchard's search.

A codebook is bounded (256 entries of a quarter of a vector), so it travels with the tasks; vectors stay where they
are. Every round sums the parts of an entry inside a task and then over the tasks. All arithmetic is on integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.operators.joins import broadcast_if_small
from leafmill.session import keep

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LIMIT = 1 << 26  # components are held within it, so that squared distances fit 64 bits
AHEAD = 16  # places of a neighbour list that are looked at in one step


class Orchard:
    """Nearest entry of a codebook, by neighbour lists.

    A vector stands at one entry and walks that entry's list of all others, nearest first. At an entry that is nearer
    to the vector it moves there and goes on with the list of that one; entries it has measured are marked and not
    measured again. Beyond twice the distance to the present entry nothing in the list can be nearer, or as near. Many
    vectors walk at once, each looking ``AHEAD`` places ahead and moving to the best of them.
    """

    def __init__(self, entries):
        import numpy as np

        self.entries = entries
        apart = np.square(entries[:, None, :] - entries[None, :, :]).sum(2)
        np.fill_diagonal(apart, -1)
        near = np.argsort(apart, axis=1, kind="stable")[:, 1:]
        # Lists one after the other, each of all other entries.
        self.gaps = np.take_along_axis(apart, near, axis=1).ravel()
        self.near = near.ravel()
        sums = entries.sum(1)
        self.by_sum = np.argsort(sums, kind="stable")
        self.sums = sums[self.by_sum]

    def nearest(self, vectors):
        """Index of the nearest entry (the lowest among equals) and the squared distance, for each vector."""
        import numpy as np

        n, k = len(vectors), len(self.entries)
        start = np.minimum(np.searchsorted(self.sums, vectors.sum(1)), k - 1)
        at_entry = self.by_sum[start]
        distance = np.square(vectors - self.entries[at_entry]).sum(1)
        marked = np.zeros(n * k, bool)
        marked[np.arange(n) * k + at_entry] = True
        place = np.zeros(n, "int64")
        walking = np.arange(n) if k > 1 else np.arange(0)
        while walking.size:
            here = distance.take(walking)
            columns = place.take(walking)[:, None] + np.arange(AHEAD)
            inside = columns < k - 1
            listed_at = at_entry.take(walking)[:, None] * (k - 1) + np.minimum(columns, k - 2)
            listed = self.near.take(listed_at)
            within = inside & (self.gaps.take(listed_at) <= 4 * here[:, None])
            mark = walking[:, None] * k + listed
            todo = np.flatnonzero(within & ~marked.take(mark))
            entry, vector = listed.ravel().take(todo), walking.take(todo // AHEAD)
            apart = vectors.take(vector, axis=0) - self.entries.take(entry, axis=0)
            found = np.full(listed.size, np.iinfo("int64").max)
            found[todo] = np.einsum("ij,ij->i", apart, apart)
            found = found.reshape(listed.shape)
            marked[mark.ravel().take(todo)] = True
            best = found.min(1)
            which = np.where(found == best[:, None], listed, k).min(1)
            moved = (best < here) | ((best == here) & (which < at_entry.take(walking)))
            movers = walking[moved]
            at_entry[movers], distance[movers], place[movers] = which[moved], best[moved], 0
            place[walking[~moved]] += AHEAD
            walking = walking[moved | within[:, -1]]
        return at_entry, distance


def usable(vectors: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector is there and holds numbers only."""
    vector = F.col(f"`{vector_col}`")
    real = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(vector.isNotNull() & real)


def compress(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """``vec_id``, ``code`` (two hex digits a part), ``error``, ``label_error`` and ``codebooks_sha256`` per usable row.

    Vectors that are null or hold nulls, NaN or infinities are dropped. A component x is floor(1024 x), held within
    ``LIMIT``. Codebooks start from the smallest ids (null last, ties by vector); rows that repeat an id take part each.
    Vectors of different lengths are filled with zeros up to the longest, rounded up to four equal parts. Fewer rows
    than ``entries`` make a smaller codebook; an empty table gives no rows. Null labels are one label. Other columns are
    dropped. What reaches the driver is bounded by ``entries`` times the length of a vector.
    """
    import numpy as np

    rows = usable(vectors, vector_col).select(
        F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"),
        F.col(f"`{vector_col}`").cast("array<double>").alias("vector"),
    )
    longest = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    width = max(1, -(-longest // PARTS))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    books = _whole_numbers(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), width)
    books = books.reshape(len(first), PARTS, width).transpose(1, 0, 2).copy()
    for _ in range(rounds if len(first) else 0):
        books = _moved(rows, books)
    coded = keep(_codes(rows, books))
    sums = keep(coded.groupBy("label").agg(F.sum("error").alias("label_error")))
    shared = broadcast_if_small(sums.withColumnRenamed("label", "of_label"))
    text = ",".join(map(str, books.ravel().tolist()))
    return coded.join(shared, F.col("label").eqNullSafe(F.col("of_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256")
    )


def _whole_numbers(vectors: pa.Array, width: int):
    """Rows of PARTS * width integers, short vectors filled with zeros."""
    import numpy as np

    ends = np.asarray(vectors.offsets, "int64")
    sizes = np.diff(ends)
    values = vectors.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
    numbers = np.clip(np.floor(values * SCALE), -LIMIT, LIMIT).astype("int64")
    out = np.zeros((len(sizes), PARTS * width), "int64")
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(numbers)) - np.repeat(ends[:-1] - ends[0], sizes)] = numbers
    return out


def _assigned(batch: pa.RecordBatch, search: list[Orchard], width: int):
    """Integer vectors of a batch, their entries and distances per part."""
    import numpy as np

    numbers = _whole_numbers(batch.column("vector"), width)
    found = [s.nearest(numbers[:, p * width : (p + 1) * width]) for p, s in enumerate(search)]
    return numbers, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _moved(rows: DataFrame, books):
    """The codebooks with each entry at the floored mean of its parts; entries without parts stay."""
    import numpy as np

    parts, size, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Orchard(book) for book in books]
        total, count = np.zeros_like(books), np.zeros((parts, size), "int64")
        for batch in batches:
            numbers, entry, _ = _assigned(batch, search, width)
            for p in range(parts):
                np.add.at(total[p], entry[:, p], numbers[:, p * width : (p + 1) * width])
                count[p] += np.bincount(entry[:, p], minlength=size)
        part, at = np.nonzero(count)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * width, pa.int32()), pa.array(total[part, at].ravel()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(part * size + at, pa.int32()), pa.array(count[part, at]), lists], ["cell", "n", "total"]
        )

    found = rows.select("vector").mapInArrow(sums, "cell int, n long, total array<long>")
    each = found.select("cell", "n", F.posexplode("total").alias("at", "value"))
    moved = books.copy().reshape(parts * size, width)
    for cell, at, value, n in each.groupBy("cell", "at").agg(F.sum("value"), F.sum("n")).collect():
        moved[cell, at] = value // n
    return moved.reshape(books.shape)


def _codes(rows: DataFrame, books) -> DataFrame:
    _, _, width = books.shape
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Orchard(book) for book in books]
        for batch in batches:
            _, entry, distance = _assigned(batch, search, width)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array([bytes(e).hex() for e in entry.astype("u1")]), pa.array(distance.sum(1))],
                ["vec_id", "label", "code", "error"],
            )

    return rows.mapInArrow(run, f"vec_id {types['vec_id']}, label {types['label']}, code string, error long")

"""Hierarchical packing of documents into context windows of several lengths.

Every document (its ids, then the separator) is routed to the shortest tier that holds it; longer ones are cut
at the longest window. A window opens with one item of its own tier, its gap is filled with whole items of the
shorter tiers, largest first, and only what then is left is filled by cutting one more item. So windows are
full. What a task has left at its end goes into windows whose lengths are powers of two. Windows are dealt out
to step groups so that every group gets its even share of each tier.

No document text is shuffled: a task packs the rows of its own input split and holds a bounded pool. The pieces
are kept in the checkpoint folder, because their numbering must not change once step groups were counted.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.words import Memo, narrow, pieces
from leafmill.session import keep

TIERS = (128, 256, 512, 1024)
STEP_TOKENS = 65_536
POOL_TOKENS = 131_072
# Tasks number their windows below this bound, so that a window's id is task * SPAN + number.
SPAN = 1 << 40

Encode = Callable[[str], bytes]

_NOT_LATIN = re.compile(r"[^\x00-\u024F]")


class _Packer:
    """Packs items (document number, start, ids as bytes) and gives finished pieces as rows."""

    def __init__(self, tiers: tuple[int, ...], pool_tokens: int):
        self.tiers, self.pool_tokens = tiers, pool_tokens
        self.by_length: dict[int, deque] = {}
        self.lengths: list[int] = []  # sorted, those with items
        self.tokens = self.windows = 0
        self.of_tier: dict[int, int] = {}
        self.rows: list[tuple] = []

    def put(self, item: tuple) -> None:
        n = len(item[3]) // 4
        if n not in self.by_length:
            self.by_length[n] = deque()
            bisect.insort(self.lengths, n)
        self.by_length[n].append(item)
        self.tokens += n

    def _take(self, at: int) -> tuple:
        n = self.lengths[at]
        item = self.by_length[n].popleft()
        if not self.by_length[n]:
            del self.by_length[n], self.lengths[at]
        self.tokens -= n
        return item

    def _cut(self, item: tuple, n: int) -> tuple[tuple, tuple]:
        doc, total, start, ids = item
        return (doc, total, start, ids[: 4 * n]), (doc, total, start + n, ids[4 * n :])

    def add(self, doc, ids: bytes) -> None:
        total, longest = len(ids) // 4, self.tiers[-1]
        item = (doc, total, 0, ids)
        while len(item[3]) // 4 > longest:
            head, item = self._cut(item, longest)
            self._close(longest, [head])
        self.put(item)
        while self.tokens > self.pool_tokens:
            self._window()

    def _close(self, tier: int, items: list[tuple]) -> None:
        offset, nth = 0, self.of_tier.get(tier, 0)
        for doc, total, start, ids in items:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.windows, offset, tier, nth))
            offset += n
        self.windows += 1
        self.of_tier[tier] = nth + 1

    def _window(self) -> None:
        """Closes one full window, opened by the longest item that waits."""
        items = [self._take(len(self.lengths) - 1)]
        used = len(items[0][3]) // 4
        tier = next(t for t in self.tiers if t >= used)
        while used < tier and self.lengths:
            at = bisect.bisect_right(self.lengths, tier - used) - 1
            if at >= 0:
                items.append(self._take(at))
            else:
                head, rest = self._cut(self._take(0), tier - used)
                items.append(head)
                self.put(rest)
            used += len(items[-1][3]) // 4
        if used == tier:
            self._close(tier, items)
        else:
            self._tail(items, used)

    def _tail(self, items: list[tuple], used: int) -> None:
        """The last, unfilled window as windows whose lengths are powers of two."""
        waiting = deque(items)
        while used:
            size = 1 << (used.bit_length() - 1)
            room, own = size, []
            while room:
                item = waiting.popleft()
                if len(item[3]) // 4 > room:
                    item, rest = self._cut(item, room)
                    waiting.appendleft(rest)
                own.append(item)
                room -= len(item[3]) // 4
            self._close(size, own)
            used -= size

    def finish(self) -> None:
        while self.lengths:
            self._window()

    def take_rows(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


@lru_cache(maxsize=1)
def encoder(ranks_path: str, json_path: str, pattern: str) -> Encode:
    """Ids of a text by a byte-level vocabulary, as little-endian unsigned 32-bit numbers. The tasks of a worker share it.

    ``ranks_path`` holds the vocabulary of ``json_path`` as ranks. Texts of Latin letters are encoded whole by the
    ranks, which is several times faster. Others go piece by piece, Latin pieces by the ranks and the rest by the
    tokenizer itself, as two libraries may follow different versions of Unicode.
    """
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    slow = Tokenizer.from_file(json_path)
    slow.encode_special_tokens = True

    def ids(text: str) -> bytes:
        other = _NOT_LATIN.search(text)
        found = slow.encode(text, add_special_tokens=False).ids if other else fast.encode_ordinary(text)
        return struct.pack(f"<{len(found)}I", *found)

    after_space = Memo(lambda piece: ids(" " + piece))

    def encode(text: str) -> bytes:
        # Cutting a text and looking its pieces up takes longer than its ranks do.
        parts = pieces(text) if _NOT_LATIN.search(text) else None
        if parts is None:
            return ids(text)
        return ids(parts[0]) + b"".join(map(after_space.__getitem__, parts[1:]))

    return encode


_SCHEMA = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, nth long"


def pack(
    docs: DataFrame,
    make_encoder: Callable[[], Encode],
    id_col: str = "doc_id",
    text_col: str = "text",
    separator: int = 0,
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = STEP_TOKENS,
    pool_tokens: int = POOL_TOKENS,
) -> DataFrame:
    """One row per piece: where it starts in its document and where it lies in its window, with its step group.

    A null or empty text is the separator alone. Rows that repeat an id are packed each on their own. An empty
    table gives no rows. Other columns are dropped.
    """
    rows = narrow(docs, id_col, text_col)
    id_type = rows.schema["id"].dataType
    end = separator.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = make_encoder(), _Packer(tiers, pool_tokens)
        first = TaskContext.get().partitionId() * SPAN

        def out(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found))
            columns[5] = [first + x for x in columns[5]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow)], names)

        arrow = [None, *[pa.int64()] * 6, pa.int32(), pa.int64()]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "nth"]
        for batch in batches:
            arrow[0] = batch.schema.field("id").type
            for doc, text in zip(batch.column("id"), batch.column("text")):
                packer.add(doc.as_py(), encode(text.as_py()) + end)
                if len(packer.rows) >= 10_000:
                    yield out(packer.take_rows())
        packer.finish()
        if packer.rows:
            yield out(packer.take_rows())

    found = keep(rows.mapInArrow(run, _SCHEMA.format(id=id_type.simpleString())))
    return _step_groups(found, step_tokens)


def _step_groups(found: DataFrame, step_tokens: int) -> DataFrame:
    """Adds ``step_group``: windows are numbered within their tier over all tasks and dealt out evenly.

    A window knows its number among those of its tier and task (``nth``); how many came before that task is a
    table of one row per task and tier, far smaller than the pieces.
    """
    task = F.floor(F.col("sequence_id") / F.lit(SPAN)).cast("long")
    counts = found.groupBy(task.alias("task"), "tier").agg((F.max("nth") + 1).alias("n"))
    before = Window.partitionBy("tier").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    every_tier = Window.partitionBy(F.lit(1))  # as many rows as there are tiers
    sizes = counts.groupBy("tier").agg(F.sum("n").alias("of_tier")).withColumn(
        "steps", F.ceil(F.sum(F.col("tier") * F.col("of_tier")).over(every_tier) / F.lit(step_tokens))
    )
    starts = counts.select("task", "tier", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier")).join(sizes, "tier")
    group = F.floor((F.col("earlier") + F.col("nth")) * F.col("steps") / F.col("of_tier"))
    return (
        found.withColumn("task", task)
        .join(starts, ["task", "tier"])
        .withColumn("step_group", group)
        .drop("task", "nth", "earlier", "of_tier", "steps")
    )

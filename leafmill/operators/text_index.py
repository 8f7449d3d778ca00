"""A stored full-text index that follows inserts, updates and deletes.

Below a root folder an index has generations of segments, and each segment three Parquet tables:

* ``blocks``: postings of one term in one range of document ids, packed into a row, with the number of documents, the
  highest count and the least length in it. Partitioned by the bucket of the term's head and sorted by term, so a term
  or a prefix is read from one folder, and in it from the row groups that can hold it. Documents are dealt out by their
  range before they are cut into tokens, so only text moves, and a task packs, sorts and writes its ranges.
  Its documents with their numbers of tokens are a row without a term, in a bucket of their own;
* ``documents``: the documents themselves;
* ``touched``: ids that the segment changes or deletes, its tombstones for all segments before it.

A batch of changes is one segment. Readers take a row of a segment unless a later one touched its id. Compaction writes
the live rows as the first segment of a new generation. The manifest names the segments that are there; a segment
without its line is not read, so a batch that failed half way leaves nothing, and repeated it replaces itself.
One writer at a time. Ids are integers; a document without one is not indexed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.operators import search
from leafmill.operators.joins import broadcast_if_small
from leafmill.sources.tables import read_if_there

BUCKETS = 64
HEAD = 2  # characters of a term that choose its bucket
BLOCK_IDS = 4096  # ids in the range of a block
BLOCK_TOKENS = 1 << 22  # tokens after which a range goes on in further rows of the same block
LENGTHS = -1  # bucket of the rows without a term
TASK_BYTES = 16 << 20  # text that one task packs, sorts and writes
LEADING = 8  # blocks with the highest bounds, scored first for a threshold
SLACK = 1e-9  # of a score, for the order in which parts are summed

MANIFEST = T.StructType([T.StructField(n, T.LongType()) for n in ("generation", "segment", "documents", "tokens")])


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(term, 1, HEAD)), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class StoredIndex:
    """An index over ``columns`` of documents with the integer id ``key``, below ``root``."""

    spark: SparkSession
    root: str
    key: str
    columns: tuple[str, ...]

    # Writing

    def create(self, documents: DataFrame) -> StoredIndex:
        """Stores ``documents`` as the first segment of a new generation."""
        self._write(documents.where(F.col(self.key).isNotNull()), self._next_generation(), 0, None)
        return self

    def apply(self, changes: DataFrame, segment: int, deleted: str = "deleted") -> None:
        """Stores ``changes`` as a segment: rows with a true ``deleted`` go, others are new or take an old one's place.

        ``changes`` has one row per id (fold a log first). ``segment`` is above those before; a repeated batch gives the
        number it had. An empty batch changes nothing.
        """
        held = self._manifest()
        if any(row.segment > segment for row in held):
            raise ValueError("a later segment is there already")
        named = changes.where(F.col(self.key).isNotNull())
        alive = named.where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted)
        generation = held[0].generation if held else 0
        self._write(alive, generation, segment, named.select(F.col(self.key).alias("id")), listed=any(r.segment == segment for r in held))

    def compact(self) -> None:
        """Writes the live rows as one segment of a new generation; later segments go on from its number."""
        held = self._manifest()
        self._write(self.documents(), self._next_generation(), max(r.segment for r in held), None)

    def _next_generation(self) -> int:
        held = self._manifest()
        return held[0].generation + 1 if held else 0

    def _write(self, documents: DataFrame, generation: int, segment: int, touched: DataFrame | None, listed: bool = False) -> None:
        place = lambda name: f"{self.root}/generation={generation}/{name}/segment={segment}"
        documents.write.mode("overwrite").parquet(place("documents"))
        stored = self.spark.read.schema(documents.schema).parquet(place("documents"))
        blocks = _blocks(stored, self.key, self.columns)
        blocks.sortWithinPartitions("bucket", "term", "block").write.mode("overwrite").partitionBy("bucket").parquet(place("blocks"))
        if touched is not None:
            touched.write.mode("overwrite").parquet(place("touched"))
        if listed:
            return
        packed = self.spark.read.schema(BLOCKS).parquet(place("blocks")).where(F.col("bucket") == LENGTHS)
        sizes = packed.select(F.explode("lengths").alias("length"))
        line = sizes.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"))
        line = line.select(F.lit(generation).cast("long").alias("generation"), F.lit(segment).cast("long").alias("segment"), "documents", "tokens")
        line.coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")

    # Reading

    def _manifest(self) -> list:
        """Lines of the newest generation; one per segment."""
        lines = read_if_there(self.spark, f"{self.root}/manifest", MANIFEST)
        newest = lines.agg(F.max("generation").alias("g")).first().g
        return lines.where(F.col("generation") == newest).orderBy("segment").collect()

    def _table(self, name: str, schema: T.StructType | str) -> DataFrame:
        """Rows of the listed segments, with ``segment``."""
        held = self._manifest()
        if not held:
            raise ValueError("no index is stored here")
        listed = [row.segment for row in held]
        if name == "touched":
            listed = listed[1:]  # nothing comes before the first
        path = f"{self.root}/generation={held[0].generation}/{name}"
        if not listed:
            return self.spark.createDataFrame([], T._parse_datatype_string(schema) if isinstance(schema, str) else schema)
        return self.spark.read.schema(schema).parquet(path).where(F.col("segment").isin(*listed))

    def _live(self, rows: DataFrame, key: str = "id") -> DataFrame:
        """Rows that no later segment touched."""
        if len(self._manifest()) > 1:
            touched = self._table("touched", "id long, segment long")
            newest = touched.groupBy("id").agg(F.max("segment").alias("_newest")).withColumnRenamed("id", "_touched")
            newest = broadcast_if_small(newest)
            rows = rows.join(newest, F.col(key) == F.col("_touched"), "left").where(
                F.col("_newest").isNull() | (F.col("_newest") == F.col("segment"))
            )
            rows = rows.drop("_touched", "_newest")
        return rows.drop("segment")

    def documents(self) -> DataFrame:
        """The newest version of every document that is not deleted."""
        held = self._manifest()
        stored = self.spark.read.parquet(f"{self.root}/generation={held[0].generation}/documents/segment={held[0].segment}")
        schema = T.StructType([*stored.schema.fields, T.StructField("segment", T.LongType())])
        return self._live(self._table("documents", schema), self.key)

    def lengths(self) -> DataFrame:
        rows = self._table("blocks", BLOCKS).where(F.col("bucket") == LENGTHS)
        rows = rows.select("segment", F.inline(F.arrays_zip("ids", "lengths")))
        return self._live(rows.select(F.col("ids").alias("id"), F.col("lengths").alias("length"), "segment"))

    def _read(self, terms: Sequence[str] | None, prefixes: Sequence[str] | None) -> DataFrame:
        """Blocks of terms and prefixes (all, if neither is given): by partition, then by the range of terms in a file."""
        rows = self._table("blocks", BLOCKS).where(F.col("bucket") != LENGTHS)
        if terms is None and prefixes is None:
            return rows
        asked, buckets, all_buckets = F.lit(False), [], False
        if terms:
            asked = F.col("term").isin(*terms)
            buckets += list(terms)
        for prefix in prefixes or ():
            asked = asked | F.col("term").startswith(prefix)
            buckets.append(prefix)
            all_buckets |= len(prefix) < HEAD
        if not all_buckets:
            heads = self.spark.createDataFrame([(b,) for b in buckets], "h string").select(_bucket(F.col("h")).alias("b"))
            numbers = sorted({r.b for r in heads.collect()})
            rows = rows.where(F.col("bucket").isin(*numbers)) if numbers else rows.limit(0)
        return rows.where(asked)

    def postings(self, terms: Sequence[str] | None = None, prefixes: Sequence[str] | None = None) -> DataFrame:
        """Live postings ``(term, id, col, pos, length)``, as ``search.postings`` gives them."""
        places = F.inline(F.arrays_zip("at", "cols", "positions"))
        rows = self._read(terms, prefixes).select("term", "segment", "ids", "lengths", places)
        names = F.array(*[F.lit(c) for c in self.columns])
        return self._live(rows.select(
            "term", F.get("ids", "at").alias("id"), F.get(names, "cols").alias("col"), F.col("positions").alias("pos"),
            F.get("lengths", "at").alias("length"), "segment",
        ))

    def counts(self, terms: Sequence[str] | None = None) -> DataFrame:
        """Live ``(term, id, tf, length)``, one row per term and document, without reading the places."""
        rows = self._read(terms, None).select("term", "segment", F.inline(F.arrays_zip("ids", "counts", "lengths")))
        return self._live(rows.select("term", F.col("ids").alias("id"), F.col("counts").alias("tf"), F.col("lengths").alias("length"), "segment"))

    def best(self, terms: Sequence[str], limit: int) -> DataFrame:
        """``(id, score)`` of the ``limit`` best documents with any of the terms (BM25), equal scores by id.

        No document of a block scores above the block's bound, which its row gives without its postings. The blocks
        with the highest bounds are scored first; their ``limit``-th score is the threshold below which others are not
        read. Over several segments bounds do not know which rows are live, and every block of the terms is read.
        """
        held = self._manifest()
        if len(held) > 1:
            scores = search.bm25(self.postings(terms), self.lengths(), terms)
            return _top(scores, limit)
        blocks = self._read(terms, None)
        n, mean = held[0].documents, held[0].tokens / max(held[0].documents, 1)
        df = dict(blocks.groupBy("term").agg(F.sum("docs")).collect())  # a row per term asked for
        if not df:
            return _top(search.bm25(self.postings(terms), self.lengths(), terms), limit)
        ratio = F.create_map(*[F.lit(x) for t, k in df.items() for x in (t, (n - k + 0.5) / (k + 0.5))])
        idf = F.greatest(F.log(ratio[F.col("term")]), F.lit(search.LEAST_IDF))

        def part(tf: Column, length: Column) -> Column:
            norm = F.lit(search.K1) * (F.lit(1 - search.B) + F.lit(search.B) * length / F.lit(mean))
            return idf * tf * F.lit(search.K1 + 1) / (tf + norm)

        bounds = blocks.groupBy("block").agg(F.sum(part(F.col("most"), F.col("least"))).alias("bound"))
        entries = blocks.select("term", "block", F.inline(F.arrays_zip("ids", "counts", "lengths")))
        scored = entries.select("block", F.col("ids").alias("id"), part(F.col("counts"), F.col("lengths")).alias("part"))
        scores = lambda rows: rows.groupBy("id").agg(F.sum("part").alias("score"))
        leading = [r.block for r in bounds.orderBy(F.desc("bound"), "block").limit(LEADING).collect()]
        first = _top(scores(scored.where(F.col("block").isin(*leading))), limit).collect()
        if len(first) < limit:
            return _top(scores(scored), limit)
        least = first[-1].score
        wanted = bounds.where(F.col("bound") >= least - abs(least) * SLACK).select("block")
        return _top(scores(scored.join(broadcast_if_small(wanted), "block", "left_semi")), limit)


# A document of a block is an entry of ``ids``, ``lengths`` and ``counts``; a place is an entry of ``at`` (which document),
# ``cols`` (which column) and ``positions``.
PACKED = (
    "term string, block long, docs long, most int, least long, ids array<long>, lengths array<long>, counts array<int>, "
    "at array<int>, cols array<tinyint>, positions array<int>"
)
BLOCKS = f"bucket int, {PACKED}, segment long"


def _blocks(documents: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Postings packed by term and range of ids. A frequent term is many blocks, so no task holds all of it."""
    ranged = documents.withColumn("block", F.floor(F.col(key) / BLOCK_IDS).cast("long"))
    tasks = search.tasks_for(documents, columns, TASK_BYTES)
    # Neighbouring ranges go to different tasks, so these get even shares.
    ranged = ranged.repartitionById(tasks, F.pmod("block", F.lit(tasks)).cast("int")).sortWithinPartitions("block", key)
    tokens = ranged.select("block", F.col(key).cast("long").alias("id"), *[search.tokens(c).alias(f"_{i}") for i, c in enumerate(columns)])
    limit = BLOCK_TOKENS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            start = 0
            for end in _ends(rows, limit):
                yield from _packed(rows.slice(start, end - start))
                start = end
            held = rows.slice(start)
        if held is not None:
            yield from _packed(held)

    bucket = F.when(F.col("term").isNull(), F.lit(LENGTHS)).otherwise(_bucket(F.col("term")))
    return tokens.mapInArrow(run, PACKED).withColumn("bucket", bucket)


def _sizes(lists: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([np.asarray(c.value_lengths()) for c in lists.chunks] or [np.empty(0)]).astype(np.int64)


def _ends(rows: pa.Table, limit: int) -> list[int]:
    """Where one range ends and another begins, or where a range has had more than ``limit`` tokens."""
    blocks, ids = rows["block"].to_numpy(), rows["id"].to_numpy()
    sizes = sum(_sizes(rows[c]) for c in rows.column_names[2:])
    ends, held = [], 0
    for i in range(1, len(blocks)):
        held += sizes[i - 1]
        if blocks[i] != blocks[i - 1] or (held > limit and ids[i] != ids[i - 1]):
            ends.append(i)
            held = 0
    return ends


def _packed(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """The rows of one block: its documents' lengths, and its tokens ordered by term, document, column and position."""
    names = rows.column_names[2:]
    sizes = [_sizes(rows[c]) for c in names]
    ids, length, size = rows["id"].to_numpy(), sum(sizes), np.concatenate(sizes)
    none, everything = np.empty(0, np.int32), np.array([0, len(ids)], np.int32)
    nothing = np.zeros(2, np.int32)
    yield _batch(rows, pa.array([None], pa.string()), [len(ids)], [0], [0], everything, ids, length, None, nothing, none, none, none)
    if not size.sum():
        return
    words = pa.concat_arrays([chunk.flatten() for c in names for chunk in rows[c].chunks]).dictionary_encode()
    code = np.asarray(words.indices)
    row = np.repeat(np.tile(np.arange(len(ids), dtype=np.int32), len(names)), size)
    column = np.repeat(np.arange(len(names), dtype=np.int8), [s.sum() for s in sizes])
    position = np.arange(len(code), dtype=np.int32) - np.repeat((np.cumsum(size) - size).astype(np.int32), size)
    order = np.lexsort((row, code))  # stable, so columns and positions stay in order
    code, row, column, position = code[order], row[order], column[order], position[order]
    term_from = np.flatnonzero(np.r_[True, np.diff(code) != 0])
    new = np.r_[True, (np.diff(code) != 0) | (np.diff(ids[row]) != 0)]
    doc_from = np.flatnonzero(new)
    count = np.diff(np.r_[doc_from, len(code)])
    longest = np.maximum.reduceat(length[row], doc_from)
    docs_from = np.searchsorted(doc_from, term_from)
    at = np.cumsum(new) - 1 - docs_from[code]
    docs, places = np.r_[docs_from, len(doc_from)], np.r_[term_from, len(code)]
    most, least = np.maximum.reduceat(count, docs_from), np.minimum.reduceat(longest, docs_from)
    yield _batch(rows, words.dictionary, np.diff(docs), most, least, docs, ids[row[doc_from]], longest, count, places, at, column, position)


def _batch(rows: pa.Table, terms: pa.Array, number, most, least, docs, ids, lengths, counts, places, at, columns, positions) -> pa.RecordBatch:
    """``docs`` and ``places`` say where the entries of a term begin and end."""
    block = np.full(len(terms), rows["block"][0].as_py(), np.int64)
    counts = np.zeros(len(ids)) if counts is None else counts

    def listed(offsets: np.ndarray, values: np.ndarray, kind: type) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(kind)))

    columns_of = {
        "term": terms, "block": pa.array(block),
        "docs": pa.array(number, pa.int64()), "most": pa.array(most, pa.int32()), "least": pa.array(least, pa.int64()),
        "ids": listed(docs, ids, np.int64), "lengths": listed(docs, lengths, np.int64), "counts": listed(docs, counts, np.int32),
        "at": listed(places, at, np.int32), "cols": listed(places, columns, np.int8), "positions": listed(places, positions, np.int32),
    }
    return pa.RecordBatch.from_arrays(list(columns_of.values()), list(columns_of))


def _top(scores: DataFrame, limit: int) -> DataFrame:
    return scores.orderBy(F.desc("score"), "id").limit(limit)

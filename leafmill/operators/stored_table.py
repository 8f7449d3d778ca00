"""A stored table that changes are merged into, bucket by bucket.

Rows are dealt by a hash of their key to a fixed number of buckets, each a folder per version. A change rewrites only
the buckets it touches, as a new version of them; the manifest says which version of a bucket counts. Readers that have
planned on older versions keep their files, and a change that fails half way leaves nothing that is read. A change is
numbered, and repeated with its number it starts from the same rows again and replaces itself, so it can be the batch of
a stream. One writer at a time. A null key is a key like others for upserts and deletes, as equality of keys is null-safe.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.operators import merge
from leafmill.operators.ordering import match
from leafmill.sources.tables import read_if_there

MANIFEST = T.StructType([T.StructField("change", T.LongType()), T.StructField("bucket", T.IntegerType())])


@dataclass(frozen=True)
class StoredTable:
    spark: SparkSession
    root: str
    schema: T.StructType
    key: str
    buckets: int = 64

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def create(self, rows: DataFrame) -> StoredTable:
        """Stores ``rows`` (one per key) as change 0."""
        self._write(rows, 0, list(range(self.buckets)))
        return self

    def upsert(self, rows: DataFrame, change: int) -> list[int]:
        """Rows (one per key) replace those with their key or are added. Returns the buckets that were rewritten."""
        given = rows.select(self.schema.names)
        return self._change(given, change, lambda before: match(before, given.select(self.key), [self.key], "left_anti").unionByName(given))

    def patch(self, patches: DataFrame, columns: Sequence[str], change: int, touch: tuple[str, Column] | None = None) -> list[int]:
        """Non-null values of ``patches`` (one per key) win; unknown keys change nothing."""
        return self._change(patches, change, lambda before: merge.apply_patches(before, patches, self.key, columns, touch))

    def delete(self, keys: DataFrame, change: int) -> list[int]:
        asked = keys.select(self.key).distinct()
        return self._change(asked, change, lambda before: match(before, asked, [self.key], "left_anti"))

    def read(self, keys: Sequence | None = None) -> DataFrame:
        """The table; with ``keys`` (a few) only their rows, from their buckets."""
        if keys is None:
            return self._version(None)
        kind = self.schema[self.key].dataType
        asked = self.spark.createDataFrame([(k,) for k in keys], T.StructType([T.StructField(self.key, kind)]))
        touched = sorted({r.b for r in asked.select(self._bucket().alias("b")).collect()})
        return self._version(None, touched).where(F.col(self.key).isin(*keys))

    def _change(self, changes: DataFrame, change: int, apply: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Rewrites the buckets of the changed keys; at most ``buckets`` numbers reach the driver."""
        if any(c > change for c, _ in self._current(None)):
            raise ValueError("a later change is there already")
        touched = sorted(r.b for r in changes.select(self._bucket().alias("b")).distinct().collect())
        if touched:
            self._write(apply(self._version(change, touched)), change, touched)
        return touched

    def _current(self, before: int | None) -> list[tuple[int, int]]:
        """(change, bucket) of the newest version of each bucket, below change ``before``."""
        lines = read_if_there(self.spark, f"{self.root}/manifest", MANIFEST)
        if before is not None:
            lines = lines.where(F.col("change") < before)
        return [(r.change, r.bucket) for r in lines.groupBy("bucket").agg(F.max("change").alias("change")).collect()]

    def _version(self, before: int | None, buckets: Sequence[int] | None = None) -> DataFrame:
        """Rows of the newest versions below change ``before``; folders of others are pruned."""
        chosen: dict[int, list[int]] = {}
        for change, bucket in self._current(before):
            if buckets is None or bucket in buckets:
                chosen.setdefault(change, []).append(bucket)
        placed = T.StructType([*self.schema.fields, T.StructField("change", T.LongType()), T.StructField("bucket", T.IntegerType())])
        rows = read_if_there(self.spark, f"{self.root}/data", placed)
        wanted = F.lit(False)
        for change, listed in sorted(chosen.items()):
            wanted = wanted | ((F.col("change") == change) & F.col("bucket").isin(*listed))
        return rows.where(wanted).select(self.schema.names)

    def _write(self, rows: DataFrame, change: int, touched: list[int]) -> None:
        # By key too, so that a large bucket is several files.
        dealt = rows.select(self.schema.names).withColumn("bucket", self._bucket()).repartitionByRange("bucket", self.key)
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/data/change={change}")
        lines = self.spark.createDataFrame([(change, b) for b in touched], MANIFEST)
        lines.coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")

"""Ordered work inside groups of any size.

A plain window puts a whole group into one task. ``arrange`` checks the group
sizes first (one aggregate over the key columns): if every group is small it
uses plain windows, all sharing one shuffle. If a group is large, the rows are
range-partitioned by key *and* order, so one group spreads over many tasks, and
lags, totals and texts are computed per slice of ranks and stitched together.
Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from leafmill.session import keep

GROUP_ROWS = 1_000_000
TEXT_GROUP_ROWS = 20_000  # for rows that carry whole texts
SLICE_ROWS = 65_536


def has_large_group(df: DataFrame, keys: Sequence[str], rows: int = GROUP_ROWS) -> bool:
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return not sizes.filter(F.col("n") > rows).isEmpty()


def match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on ``keys``, treating null keys as equal, keeping the left key columns."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(renamed[f"_r_{k}"])
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def number_by_range(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, first: int = 1
) -> DataFrame:
    """Consecutive numbers in ``order`` within ``keys`` without gathering a group.

    Rows are range-partitioned and sorted, which spreads a large group over
    tasks, and kept so that positions are stable. Each (key, partition) then
    only needs the count of its key's rows in earlier partitions.
    """
    bounds = [*[F.col(k) for k in keys], *order]
    placed = keep(
        df.repartitionByRange(*bounds)
        .sortWithinPartitions(*bounds)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.spark_partition_id())
    )
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = (
        placed.groupBy(*keys, "_part")
        .agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    if not keys:
        starts = F.broadcast(starts)  # one row per partition
    numbered = match(placed, starts, [*keys, "_part"], "inner")
    number = F.col("_at") - F.col("_from") + F.col("_before") + F.lit(first)
    return numbered.withColumn(name, number.cast("long")).drop(
        "_at", "_part", "_from", "_before"
    )


@dataclass(frozen=True)
class Arranged:
    """Rows with a dense rank (from 1) in column ``rank`` within ``keys``.

    Plain windows use the ``order`` the rank came from, so rows that are sorted
    already are not sorted again.
    """

    df: DataFrame
    keys: tuple[str, ...]
    rank: str
    large: bool
    slice_rows: int = SLICE_ROWS
    order: tuple[Column, ...] = ()

    def with_df(self, df: DataFrame) -> Arranged:
        return replace(self, df=df)

    def _window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*(self.order or (self.rank,)))

    def _slice(self) -> Column:
        return F.floor((F.col(self.rank) - 1) / self.slice_rows)

    def lag(self, columns: dict[str, str]) -> Arranged:
        """Add ``new: old`` columns holding the value of the row one rank before."""
        if not self.large:
            w = self._window()
            return self.with_df(
                self.df.withColumns({new: F.lag(old).over(w) for new, old in columns.items()})
            )
        # The last row of a slice is copied into the next one as its left edge.
        home = self._slice()
        last = F.col(self.rank) % self.slice_rows == 0
        homes = F.when(last, F.array(home, home + 1)).otherwise(F.array(home))
        w = Window.partitionBy(*self.keys, "_slice").orderBy(self.rank)
        spread = self.df.withColumn("_slice", F.explode(homes))
        lagged = spread.withColumns({new: F.lag(old).over(w) for new, old in columns.items()})
        return self.with_df(lagged.filter(F.col("_slice") == home).drop("_slice"))

    def running_total(self, value: Column, name: str) -> Arranged:
        """Add the sum of ``value`` over all rows up to and including this one.

        Nulls add nothing; the sum is null until the first value.
        """
        frame = (Window.unboundedPreceding, Window.currentRow)
        if not self.large:
            w = self._window().rowsBetween(*frame)
            return self.with_df(self.df.withColumn(name, F.sum(value).over(w)))
        sliced = keep(self.df.withColumns({"_slice": self._slice(), "_value": value}))
        w = Window.partitionBy(*self.keys, "_slice").orderBy(self.rank).rowsBetween(*frame)
        earlier = Window.partitionBy(*self.keys).orderBy("_slice").rowsBetween(
            Window.unboundedPreceding, -1
        )
        carried = (
            sliced.groupBy(*self.keys, "_slice")
            .agg(F.sum("_value").alias("_sum"))
            .withColumn("_carry", F.sum("_sum").over(earlier))
            .drop("_sum")
        )
        local = sliced.withColumn("_local", F.sum("_value").over(w))
        total = match(local, carried, [*self.keys, "_slice"], "inner")
        return self.with_df(
            total.withColumn(name, F.coalesce(F.col("_local") + F.col("_carry"), "_local", "_carry")).drop(
                "_slice", "_value", "_local", "_carry"
            )
        )

    def texts(
        self,
        pieces: dict[str, Column],
        part_rows: int = SLICE_ROWS,
        sums: dict[str, Column] | None = None,
    ) -> DataFrame:
        """Concatenate each piece in rank order; ``sums`` are added up beside them.

        One output row holds at most ``part_rows`` rows of a group, counted in
        ``rows``. Joining a group's parts in order of ``part`` gives its whole text.
        """
        part = F.floor((F.col(self.rank) - 1) / part_rows).cast("int")
        row = F.struct(F.col(self.rank).alias("_rank"), *[c.alias(n) for n, c in pieces.items()])
        rows = F.sort_array(F.collect_list(row))
        totals = [F.sum(c).alias(n) for n, c in (sums or {}).items()]
        gathered = self.df.groupBy(*self.keys, part.alias("part")).agg(
            rows.alias("_rows"), *totals
        )
        return gathered.select(
            *self.keys,
            "part",
            F.size("_rows").alias("rows"),
            *[F.array_join(F.col(f"_rows.{n}"), "").alias(n) for n in pieces],
            *(sums or {}),
        )


def arrange(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    rank: str = "rank",
    group_rows: int = GROUP_ROWS,
    slice_rows: int = SLICE_ROWS,
    large: bool | None = None,
) -> Arranged:
    """Rank rows within ``keys``; ``order`` must be total within a group.

    Give plain columns as ``order`` where lags or totals follow.

    ``large`` skips the size check where the caller already made it. Without keys all
    rows are one group, which never goes into one task.
    """
    if large is None:
        large = not keys or has_large_group(df, keys, group_rows)
    if large:
        numbered = number_by_range(df, keys, order, rank)
    else:
        w = Window.partitionBy(*keys).orderBy(*order)
        numbered = df.withColumn(rank, F.row_number().over(w).cast("long"))
    return Arranged(numbered, tuple(keys), rank, large, slice_rows, tuple(order))

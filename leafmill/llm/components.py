"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.session import keep

FILE_ROWS = 250_000


def components(links: DataFrame) -> DataFrame:
    """``links`` has two ids per row (a, b). Returns (id, root) for every id that is not the smallest of its component.

    Each round points the neighbours of a node at the smallest of them, so the rounds grow with the logarithm of
    the longest path. Smallest neighbours come from aggregates with a map side; edges of a node with many
    neighbours are split by the join. Up to ``FILE_ROWS`` links are one file, whose rounds need no shuffles; more are spread
    over tasks. An empty table gives no rows; links of an id to itself do nothing. ``links`` should be kept, as it is read twice.
    """
    given = links.count()
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v")
    edges = _kept(_few(edges, given).distinct(), given)
    last = None
    while True:
        seen = _few(edges, given).agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(seen) == last or not seen[0]:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        last = tuple(seen)
        edges = _kept(_round(edges, given), given)


def _round(edges: DataFrame, rows: int) -> DataFrame:
    large = _few(_large_star(_few(edges, rows)), rows)
    return _few(_small_star(large), rows).distinct()


def _few(edges: DataFrame, rows: int) -> DataFrame:
    """``edges`` in one partition if that many rows fit into one file, so that Spark sees no need to deal them out."""
    return edges.coalesce(1) if rows <= FILE_ROWS else edges


def _kept(edges: DataFrame, rows: int) -> DataFrame:
    """``edges`` kept in as many files as that many rows are worth; a star has no more rows than it came from."""
    return keep(edges.coalesce(rows // FILE_ROWS + 1))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.inline(F.array(_edge("u", "v"), _edge("v", "u"))))
    smallest = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    # What comes twice goes with the small star.
    return both.where("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    smallest = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(smallest, "u")
    return joined.select(F.inline(F.array(_edge("u", "m"), _edge("v", "m")))).where("u > v")


def _edge(u: str, v: str) -> Column:
    return F.struct(F.col(u).alias("u"), F.col(v).alias("v"))

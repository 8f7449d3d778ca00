"""Exact duplicates by salted digest groups, in DataFrame operations only.

Copies meet in three stages, and each compares full content, because the text is part of the grouping key:

1. the map side of the first aggregate joins copies within a task;
2. groups of (digest, salt, text) join them over tasks, a hot text being spread over the salts;
3. the winners of the salts, at most one per salt and text, are joined per (digest, text).

Then documents learn their winner by digest alone, which ships no text: stage 3 has shown which digests stand
for a single text. Should one stand for several, its documents, and only those, are matched by text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.words import narrow, one_space
from leafmill.session import keep

SALTS = 16


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = one_space,
    digest: Callable[[Column], Column] = sha256,
    salts: int = SALTS,
) -> DataFrame:
    """One row per document: ``keep_id`` (smallest id with an equal text), ``group_size``, ``kept``, ``digest``.

    Texts are equal when their normalised forms are. Null counts as empty. Rows that repeat an id count towards
    ``group_size`` and share one verdict; a null id never wins over another and is kept if no other id is there.
    An empty table gives no rows. Other columns are dropped.
    """
    rows = narrow(docs, id_col, text_col).withColumn("text", normalise(F.col("text")))
    rows = rows.withColumn("digest", digest(F.col("text")))
    groups = keep(_groups(rows, salts))
    rows = rows.withColumnRenamed("text", "content")
    plain = groups.where("texts = 1").select("digest", "keep_id", "group_size")
    found = rows.select("id", "digest").join(plain, "digest", "left")
    if not groups.where("texts > 1").isEmpty():
        found = _with_mixed(rows, found, groups, salts)
    return found.select(
        F.col("id").alias("doc_id"),
        F.coalesce("keep_id", "id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce("keep_id", "id").eqNullSafe(F.col("id")).alias("kept"),
        "digest",
    )


def _winners(rows: DataFrame, salts: int) -> DataFrame:
    """One row per digest and text, with its smallest id and the number of its rows."""
    salt = F.pmod(F.xxhash64("id"), F.lit(salts)).cast("byte")
    salted = rows.groupBy("digest", salt.alias("salt"), "text").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    return salted.groupBy("digest", "text").agg(F.min("id").alias("keep_id"), F.sum("n").alias("group_size"))


def _groups(rows: DataFrame, salts: int) -> DataFrame:
    """Digests of several rows: winner and size if they stand for one text, else only the number of texts."""
    return (
        _winners(rows, salts)
        .groupBy("digest")
        .agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count(F.lit(1)).alias("texts"))
        .where("group_size > 1")
    )


def _with_mixed(rows: DataFrame, found: DataFrame, groups: DataFrame, salts: int) -> DataFrame:
    """Adds the documents whose digest stands for several texts, matched by text."""
    mixed = groups.where("texts > 1").select("digest")
    own = rows.withColumnRenamed("content", "text").join(mixed, "digest", "left_semi")
    by_text = own.join(_winners(own, salts), ["digest", "text"]).select("digest", "id", "keep_id", "group_size")
    return found.join(mixed, "digest", "left_anti").unionByName(by_text.select(found.columns))

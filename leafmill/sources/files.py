"""Files as rows: listings, import manifests, path layout, dictionaries, orphans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.text import title_or_stem


def find_files(spark: SparkSession, root: str, path_pattern: str) -> DataFrame:
    """``path``, ``length`` and ``modificationTime`` of files whose whole path matches; nothing is read from them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", "length", "modificationTime").where(F.col("path").rlike(path_pattern))


def read_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Files below ``root`` with content; drop ``content`` to list them only."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(root)
    )


def list_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    return read_files(spark, root, pattern).drop("content")


def hash_id(*parts: Column) -> Column:
    """A 16-digit hexadecimal id that is the same every time it is computed."""
    return F.substring(F.md5(F.concat_ws("\x1f", *[p.cast("string") for p in parts])), 1, 16)


def import_manifest(files: DataFrame, path: Column, title: Column) -> DataFrame:
    """Where each file goes and which title its book gets."""
    return files.select(
        path.alias("source_path"),
        F.concat(F.lit("pdfs/"), hash_id(path), F.lit(".pdf")).alias("target_path"),
        title_or_stem(title, path).alias("title"),
    )


def page_image_path(book_id: Column, epoch_seconds: Column, *identity: Column) -> Column:
    return F.format_string(
        "pages/%s/%d_%s.jpg", book_id, epoch_seconds, hash_id(book_id, epoch_seconds, *identity)
    )


def image_path(prefix: Column, *identity: Column) -> Column:
    return F.format_string("images/%s_%s.bin", prefix, hash_id(prefix, *identity))


def text_lines(texts: DataFrame, key: Sequence[str], text: Column) -> DataFrame:
    """Lines of whole texts, numbered from 0; a final line break adds no line."""
    lines = F.split(F.regexp_replace(text, "\r?\n\\z", ""), "\r?\n")
    numbered = texts.filter(text != "").select(*key, F.posexplode(lines).alias("line", "token"))
    return numbered


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A dictionary file as ``(line, token)``; the line number is the class id."""
    return text_lines(spark.read.text(path, wholetext=True), [], F.col("value"))


def reconcile(files: DataFrame, references: DataFrame) -> DataFrame:
    """Files no row names, and named files that do not exist.

    ``files`` has ``path``; ``references`` has ``path`` and ``origin``.
    """
    unreferenced = files.select("path").join(references, "path", "left_anti")
    missing = references.filter("path is not null").join(files, "path", "left_anti")
    return unreferenced.select(
        "path", F.lit("unreferenced file").alias("finding"), F.lit(None).cast("string").alias("origin")
    ).unionByName(missing.select("path", F.lit("missing file").alias("finding"), "origin"))

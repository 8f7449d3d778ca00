"""From raw documents to packed training windows: the stages in order, each an operator of ``leafmill.llm``.

A stage takes (spark, docs, sf_dir) and returns what is left of the documents with their own columns; the last one
returns the pieces of the packed windows. Between stages ``run`` writes Parquet and reads it again, so a lost
executor costs at most one stage. Decisions hold for a row, told by its id (null too) and its text, so rows that share
an id are judged each; of rows with the same id and text the exact stage leaves one. Null texts count as empty and end
at the quality rules. An empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import exact_dedup, ngram_join, packing, pii, quality
from leafmill.llm.queries import pack_encoder
from leafmill.llm.words import text_digest
from leafmill.session import fresh_path
from leafmill.sources.tables import sample_table


def _row_key(doc_id: Column, digest: Column) -> Column:
    """Id and text of a row in one value that is never null."""
    return F.concat_ws(":", F.lower(F.hex(digest)), doc_id.cast("string"))


def _keyed(docs: DataFrame, digest: Column) -> DataFrame:
    return docs.withColumn("__row", _row_key(F.col("doc_id"), digest))


def _only(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of ``docs`` (with their ``__row``) that ``decided`` (``doc_id``, ``digest``) names."""
    rows = decided.select(_row_key(F.col("doc_id"), F.col("digest")).alias("__row"))
    return docs.join(rows, "__row", "left_semi").drop("__row")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the risk-controlled cutoffs."""
    rated = quality.rate(docs, sample_table(spark, sf_dir, "labels"))
    return _only(_keyed(docs, text_digest(F.col("text"))), rated.where("kept"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id, once."""
    found = exact_dedup.duplicates(docs, digest=text_digest)
    once = _keyed(docs, text_digest(exact_dedup.one_space(F.col("text")))).dropDuplicates(["__row"])
    return _only(once, found.where("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar word sequences, over any path, the one with the smallest id."""
    found = ngram_join.link(docs, **NEAR)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "digest")).alias("row")
    winners = found.where("component is not null").groupBy("component").agg(first).select("row.doc_id", "row.digest")
    wordless = found.where("component is null").select("doc_id", "digest")
    return _only(_keyed(docs, text_digest(F.col("text"))), winners.unionByName(wordless))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; ``n_chars`` follows the text."""
    redacted = pii.redact(docs)
    if "n_chars" not in docs.columns:
        return redacted
    kind = docs.schema["n_chars"].dataType.simpleString()
    return redacted.selectExpr(*[f"cast(length(text) as {kind}) as n_chars" if c == "n_chars" else f"`{c}`" for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training windows."""
    return packing.pack(docs, pack_encoder)


# Near-duplicates of the corpus: shingles of five words, similarity of 0.8 or more.
NEAR = {"words": 5, "percent": 80, "pairs_per_member": 8}

STAGES = [
    ("quality_rules", quality_rules),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packed", packed),
]

# Exact binomial bounds, boosted trees and packing have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sample_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

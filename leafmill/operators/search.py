"""Full-text search over a table of postings.

Postings are rows ``(term, id, col, pos, length)``, ``length`` being the tokens of
the whole document. They can be written once, bucketed by term, and searched many
times, or built for one query from its terms only.
Every search form is a filter on terms and one aggregate per document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import search_tokens
from leafmill.operators.joins import broadcast_if_small
from leafmill.operators.ordering import number_by_range
from leafmill.session import keep

# Usual BM25 constants and the least weight of a term.
K1 = 1.2
B = 0.75
LEAST_IDF = 1e-6

TASK_PARTS = 4_000_000  # shares of a score (query, term, document) that one task adds up
TASK_BYTES = 16 << 20  # text whose postings one task gathers


def _tasks(df: DataFrame, total: int, each: int) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-total // each))


def by_document(documents: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Documents dealt out by id, so that what is counted per document needs no shuffle of its postings."""
    return documents.repartition(tasks_for(documents, columns, TASK_BYTES), key)


def tasks_for(documents: DataFrame, columns: Sequence[str], each: int) -> int:
    """Tasks that get ``each`` bytes of text on average."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(0).cast("long"))
    return _tasks(documents, documents.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0], each)


def postings(
    documents: DataFrame,
    key: str,
    columns: Sequence[str],
    terms: Sequence[str] | None = None,
    prefixes: Sequence[str] | None = None,
) -> DataFrame:
    """One row per token; with ``terms`` or ``prefixes`` only of those that match."""
    cut = documents.select(
        F.col(key).alias("id"), *[tokens(c).alias(f"_{i}") for i, c in enumerate(columns)]
    )
    length = F.lit(0).cast("long")
    for i in range(len(columns)):
        length = length + F.size(f"_{i}")
    per_column = F.array(
        *[F.struct(F.lit(c).alias("col"), F.col(f"_{i}").alias("tokens")) for i, c in enumerate(columns)]
    )
    # The outer form keeps Spark from tokenising once more in a filter for empty arrays.
    rows = (
        cut.withColumn("length", length)
        .select("id", "length", F.inline(per_column))
        .select("id", "length", "col", F.posexplode_outer("tokens").alias("pos", "term"))
        .filter("term is not null")
    )
    if terms is not None or prefixes is not None:
        wanted = F.col("term").isin(*(terms or ()))
        for prefix in prefixes or ():
            wanted = wanted | F.col("term").startswith(prefix)
        rows = rows.filter(wanted)
    return rows.select("term", "id", "col", "pos", "length")


def tokens(column: str) -> Column:
    """Terms of a column in order; null has none."""
    return search_tokens(F.coalesce(F.col(column), F.lit("")))


def lengths(documents: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Tokens per document, over all indexed columns."""
    total = F.lit(0)
    for c in columns:
        total = total + F.size(tokens(c))
    return documents.select(F.col(key).alias("id"), total.cast("long").alias("length"))


def inverted_index(rows: DataFrame) -> DataFrame:
    """Postings gathered per (term, document, column): count and sorted positions."""
    return rows.groupBy("term", "id", "col").agg(
        F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions")
    )


def write_index(rows: DataFrame, table: str, buckets: int = 256) -> None:
    """Store postings bucketed and sorted by term: a term is read from one bucket."""
    rows.write.mode("overwrite").bucketBy(buckets, "term").sortBy("term", "id").saveAsTable(table)


def _in_columns(rows: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    return rows if columns is None else rows.filter(F.col("col").isin(*columns))


def match_all(rows: DataFrame, terms: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Ids of documents with every term. The set per id holds query terms only."""
    return match_terms(rows, every=terms, columns=columns)


def match_any(rows: DataFrame, terms: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    return _in_columns(rows, columns).filter(F.col("term").isin(*terms)).select("id").distinct()


def match_terms(
    rows: DataFrame,
    every: Sequence[str] = (),
    some: Sequence[str] = (),
    none: Sequence[str] = (),
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Ids with every term of ``every``, a term of ``some`` if given, and none of ``none``.

    One pass: the terms found per id are judged together. At least one term must
    be asked for with ``every`` or ``some``.
    """
    if not every and not some:
        raise ValueError("nothing is asked for")
    asked = [*every, *some, *none]
    hits = _in_columns(rows, columns).filter(F.col("term").isin(*asked))
    found = hits.groupBy("id").agg(F.collect_set("term").alias("_t"))

    def listed(terms: Sequence[str]) -> Column:
        return F.array(*[F.lit(t) for t in sorted(set(terms))]).cast("array<string>")

    keep = F.size(F.array_intersect("_t", listed(every))) == len(set(every))
    if some:
        keep = keep & F.arrays_overlap("_t", listed(some))
    if none:
        keep = keep & ~F.arrays_overlap("_t", listed(none))
    return found.filter(keep).select("id")


def match_none(ids: DataFrame, rows: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Those of ``ids`` whose document has none of the terms."""
    return ids.join(match_any(rows, terms), "id", "left_anti")


def match_prefix(rows: DataFrame, prefix: str, columns: Sequence[str] | None = None) -> DataFrame:
    return _in_columns(rows, columns).filter(F.col("term").startswith(prefix)).select("id").distinct()


def match_phrase(rows: DataFrame, phrase: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Ids of documents where the terms stand next to each other in order.

    A token that is the n-th term votes for a phrase starting n tokens earlier;
    a start with a vote from every place of the phrase is a match. One aggregate
    by (document, column, start), no self-join.
    """
    places = {}
    for n, term in enumerate(phrase):
        places.setdefault(term, []).append(n)
    pairs = [x for t, ns in places.items() for x in (F.lit(t), F.array(*[F.lit(n) for n in ns]))]
    votes = _in_columns(rows, columns).filter(F.col("term").isin(*places)).select(
        "id", "col", "pos", F.explode(F.create_map(*pairs)[F.col("term")]).alias("n")
    )
    starts = votes.groupBy("id", "col", (F.col("pos") - F.col("n")).alias("start")).agg(
        F.count(F.lit(1)).alias("votes")
    )
    return starts.filter(F.col("votes") == len(phrase)).select("id").distinct()


def _counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy("id", "term").agg(
        F.count(F.lit(1)).alias("tf"), F.max("length").alias("length")
    )


def _weights(tf: DataFrame, doc_lengths: DataFrame) -> DataFrame:
    """``(term, df, idf, mean)``: the weight of each term and the mean length in the corpus."""
    # Counting with the same columns as above lets Spark shuffle the hits only once.
    present = F.when((F.col("tf") > 0) & (F.col("length") > 0), 1)
    df = tf.groupBy("term").agg(F.count(present).alias("df"))
    corpus = doc_lengths.agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).alias("s")
    ).scalar()
    return df.withColumn("_corpus", corpus).select(
        "term", "df",
        F.greatest(
            F.log((F.col("_corpus.n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF)
        ).alias("idf"),
        F.col("_corpus.mean").alias("mean"),
    )


def _part() -> Column:
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("length") / F.col("mean"))
    return F.col("idf") * F.col("tf") * F.lit(K1 + 1) / (F.col("tf") + norm)


def _scored(hits: DataFrame, doc_lengths: DataFrame) -> DataFrame:
    """``(id, term, part)``: the BM25 share of each term in each document."""
    tf = _counts(hits)
    return tf.join(_weights(tf, doc_lengths), "term").select("id", "term", _part().alias("part"))


def bm25(
    rows: DataFrame, doc_lengths: DataFrame, terms: Sequence[str], ids: DataFrame | None = None
) -> DataFrame:
    """``(id, score)`` of documents with any of the terms, or of those in ``ids`` only.

    ``ids`` comes from one of the match forms, so that a whole query decides on its hits and the terms on their
    order. Weights are those of the whole corpus either way.
    """
    hits = rows.filter(F.col("term").isin(*terms))
    scores = _scored(hits, doc_lengths).groupBy("id").agg(F.sum("part").alias("score"))
    return scores if ids is None else scores.join(ids, "id", "left_semi")


def bm25_prefix(rows: DataFrame, doc_lengths: DataFrame, prefix: str) -> DataFrame:
    """``(id, score)`` of documents with a term that starts so; all such terms count as one."""
    hits = rows.filter(F.col("term").startswith(prefix)).withColumn("term", F.lit(prefix))
    return _scored(hits, doc_lengths).groupBy("id").agg(F.sum("part").alias("score"))


def with_rank(scores: DataFrame, digits: int = 6) -> DataFrame:
    """Rounded scores with ``rank``: best first, equal scores by id. No task sees all hits."""
    rounded = scores.withColumn("score", F.round("score", digits))
    return number_by_range(rounded, [], [F.desc("score"), F.col("id")], "rank")


def best_per_query(scores: DataFrame, limit: int, digits: int = 5) -> DataFrame:
    """The ``limit`` best documents of each query with their ``rank``; fewer leave each task before the shuffle."""
    rounded = scores.withColumn("score", F.round("score", digits))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return rounded.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)


def bm25_many(rows: DataFrame, doc_lengths: DataFrame, asked: DataFrame) -> DataFrame:
    """``(query_id, id, score)`` for a table ``(query_id, term)`` of queries.

    ``rows`` are postings, or counts ``(term, id, tf, length)`` where an index has them. They are dealt out by document
    before the queries multiply them, so a document's scores are summed where its terms are; weights and queries
    come to them by broadcast if there are few.
    """
    distinct_asked = keep(asked.select("query_id", "term").distinct())
    terms = broadcast_if_small(distinct_asked.select("term").distinct())
    hits = rows.join(terms, "term", "left_semi")
    if "tf" not in rows.columns:
        hits = _counts(hits)
    weighted = keep(distinct_asked.join(_weights(hits, doc_lengths), "term"))
    total = weighted.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    parts = hits.repartition(_tasks(hits, total, TASK_PARTS), "id").join(broadcast_if_small(weighted), "term")
    return parts.groupBy("query_id", "id").agg(F.sum(_part()).alias("score"))


def ranked_rows(scores: DataFrame, documents: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Documents of the hits, best first; with ``limit`` the top hits are taken
    before their documents are fetched."""
    best = scores.orderBy(F.desc("score"), "id")
    chosen = scores if limit is None else best.limit(limit)
    return chosen.join(documents.withColumnRenamed(key, "id"), "id").orderBy(F.desc("score"), "id")

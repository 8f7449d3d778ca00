"""Queries over repeated substrings and passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.operators import repeats
from leafmill.plans import fixtures as fx
from leafmill.plans.registry import query
from leafmill.sources.tables import sample_table


# Every substring with the symbol behind it; the empty one is taken before each character.
_GRAMS = """places AS (SELECT item_id, text, unnest(range(1, length(text) + 1)) AS i FROM benchmark),
    sized AS (SELECT item_id, text, i, unnest(range(0, length(text) - i + 2)) AS l FROM places),
    grams AS (SELECT item_id, substring(text, i, l) AS gram,
        CASE WHEN i + l > length(text) THEN 'end ' || item_id::VARCHAR ELSE substring(text, i + l, 1) END AS next FROM sized)"""


@query(
    f"""WITH {_GRAMS} SELECT item_id, gram, count(*) AS freq FROM grams
        GROUP BY item_id, gram HAVING count(DISTINCT next) > 1 OR gram = ''"""
)
def repeated_substrings(spark: SparkSession, d: str) -> DataFrame:
    return repeats.repeated_substrings(sample_table(spark, d, "benchmark"), ["item_id"], "text")


@query(
    f"""WITH {_GRAMS} SELECT gram, count(*) AS freq FROM grams GROUP BY gram
        HAVING count(DISTINCT next) > 1 OR gram = ''"""
)
def repeated_substrings_corpus(spark: SparkSession, d: str) -> DataFrame:
    return repeats.repeated_substrings(sample_table(spark, d, "benchmark"), [], "text")


@query(
    """WITH places AS (SELECT item_id, text, unnest(range(1, length(text) + 1)) AS i FROM benchmark),
       ordered AS (SELECT item_id, i - 1 AS pos, substring(text, i) AS suffix,
           row_number() OVER (PARTITION BY item_id ORDER BY substring(text, i)) - 1 AS rank FROM places),
       lagged AS (SELECT *, lag(suffix) OVER (PARTITION BY item_id ORDER BY rank) AS before FROM ordered)
       SELECT item_id, rank::INTEGER AS rank, pos::INTEGER AS pos, CASE WHEN before IS NULL THEN 0 ELSE
           list_filter(range(1, length(before) + 2), lambda n: substring(before, n, 1) <> substring(suffix, n, 1)
               OR n > length(before))[1] - 1 END::INTEGER AS shared FROM lagged"""
)
def suffix_order(spark: SparkSession, d: str) -> DataFrame:
    return repeats.suffix_order(sample_table(spark, d, "benchmark"), "item_id", "text")


@query(
    """WITH split AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS w FROM documents),
       places AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM split WHERE len(w) >= 8),
       runs AS (SELECT doc_id, list_aggregate(w[i:i + 7], 'string_agg', ' ') AS passage FROM places)
       SELECT passage, count(*) AS occurrences, count(DISTINCT doc_id) AS documents FROM runs
       GROUP BY passage HAVING count(DISTINCT doc_id) > 1"""
)
def repeated_passages(spark: SparkSession, d: str) -> DataFrame:
    return repeats.repeated_passages(fx.documents(spark, d), "text", 8)


@query(
    """WITH split AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS w FROM documents),
       places AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM split WHERE len(w) >= 8),
       runs AS (SELECT doc_id, i, list_aggregate(w[i:i + 7], 'string_agg', ' ') AS passage FROM places),
       again AS (SELECT passage FROM runs GROUP BY passage HAVING count(DISTINCT doc_id) > 1),
       islands AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM runs JOIN again USING (passage))
       SELECT doc_id, (min(i) - 1)::INTEGER AS start, count(*) + 7 AS words FROM islands GROUP BY doc_id, island"""
)
def repeated_runs(spark: SparkSession, d: str) -> DataFrame:
    return repeats.repeated_runs(fx.documents(spark, d), "doc_id", "text", 8)

"""Full-text queries over pages and notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import search
from leafmill.plans import fixtures as fx
from leafmill.plans.registry import query
from leafmill.sources.tables import sample_table

TEXT = ["ocr_text_plain"]
NOTE_COLUMNS = ["ocr_text_plain", "user_memo", "book_title", "voice_transcript"]
BEST = 10  # documents that a search with many queries returns for each


def _tokens(column: str) -> str:
    plain = f"strip_accents(lower({column}))"
    return f"list_filter(regexp_split_to_array({plain}, '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


_DOCS = f"docs AS (SELECT doc_id AS id, {_tokens('text')} AS ts FROM documents)"
_POSTINGS = f"""{_DOCS}, postings AS (SELECT id, unnest(ts) AS term,
    (unnest(range(1, len(ts) + 1)) - 1)::INTEGER AS pos FROM docs)"""


@query(f"WITH {_POSTINGS} SELECT term, id, count(*) AS tf, min(pos) AS first, max(pos) AS last FROM postings GROUP BY term, id")
def inverted_index(spark: SparkSession, d: str) -> DataFrame:
    pages = search.by_document(fx.unnumbered_pages(spark, d), "id", TEXT)
    index = search.inverted_index(search.postings(pages, "id", TEXT))
    return index.select(
        "term", "id", "tf",
        F.array_min("positions").alias("first"), F.array_max("positions").alias("last"),
    )


@query(f"WITH {_DOCS} SELECT id FROM docs WHERE list_has_all(ts, ['tion', 'ble', 'thing'])")
def search_all_terms(spark: SparkSession, d: str) -> DataFrame:
    terms = ["tion", "ble", "thing"]
    return search.match_all(fx.page_index(spark, d).postings(terms), terms)


@query(f"WITH {_DOCS} SELECT id FROM docs WHERE list_has_any(ts, ['thing', 'thble', 'anea'])")
def search_any(spark: SparkSession, d: str) -> DataFrame:
    terms = ["thing", "thble", "anea"]
    return search.match_any(fx.page_index(spark, d).postings(terms), terms)


@query(f"WITH {_DOCS} SELECT id FROM docs WHERE list_contains(ts, 'with') AND NOT list_has_any(ts, ['tion', 'are'])")
def search_none(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.page_index(spark, d).postings(["with", "tion", "are"])
    return search.match_terms(rows, every=["with"], none=["tion", "are"])


@query(f"WITH {_DOCS} SELECT id FROM docs WHERE contains(' ' || list_aggregate(ts, 'string_agg', ' ') || ' ', ' the and the ')")
def search_phrase(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.page_index(spark, d).postings(["the", "and"])
    return search.match_phrase(rows, ["the", "and", "the"])


@query(f"WITH {_DOCS} SELECT id FROM docs WHERE len(list_filter(ts, lambda t: starts_with(t, 'retition'))) > 0")
def search_prefix(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.page_index(spark, d).postings(prefixes=["retition"])
    return search.match_prefix(rows, "retition")


def _bm25(asked: str, extra: str = "") -> str:
    return f"""tf AS (SELECT id, term, count(*) AS tf FROM postings WHERE term IN ({asked}) GROUP BY id, term),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        lens AS (SELECT id, len(ts) AS length FROM docs),
        corpus AS (SELECT count(*) AS n, avg(length) AS mean FROM lens),
        parts AS (SELECT tf.id, tf.term, greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 0.000001::DOUBLE)
              * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean)) AS part
              FROM tf JOIN df ON df.term = tf.term JOIN lens ON lens.id = tf.id CROSS JOIN corpus){extra}"""


@query(f"WITH {_POSTINGS}, {_bm25(chr(39) + 'thing' + chr(39) + ', ' + chr(39) + 'thble' + chr(39) + ', ' + chr(39) + 'anea' + chr(39))} SELECT id, round(sum(part), 6) AS score FROM parts GROUP BY id")
def search_bm25(spark: SparkSession, d: str) -> DataFrame:
    terms = ["thing", "thble", "anea"]
    pages = fx.page_index(spark, d)
    scores = search.bm25(pages.postings(terms), pages.lengths(), terms)
    return scores.withColumn("score", F.round("score", 6))


@query(
    f"""WITH {_POSTINGS}, {_bm25("'thing', 'thble', 'anea'")}, sums AS (SELECT id, sum(part) AS score FROM parts GROUP BY id ORDER BY score DESC, id LIMIT {BEST})
        SELECT id, round(score, 6) AS score FROM sums"""
)
def search_top_pages(spark: SparkSession, d: str) -> DataFrame:
    """The best pages for three terms; blocks of the index that cannot hold one are not read."""
    return fx.page_index(spark, d).best(["thing", "thble", "anea"], BEST).withColumn("score", F.round("score", 6))


_ASKED = f"""asked AS (SELECT DISTINCT item_id AS query_id, unnest({_tokens('text')}) AS term FROM benchmark)"""


@query(
    f"""WITH {_POSTINGS}, {_ASKED}, {_bm25('SELECT term FROM asked')}
        , scores AS (SELECT query_id, id, round(sum(part), 5) AS score FROM parts JOIN asked USING (term) GROUP BY query_id, id)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM scores)
        WHERE rank <= {BEST}"""
)
def search_many_queries(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark text as a query of its terms, against every page; the best pages of each."""
    pages = fx.page_index(spark, d)
    asked = search.postings(sample_table(spark, d, "benchmark"), "item_id", ["text"]).select(
        F.col("id").alias("query_id"), "term"
    )
    return search.best_per_query(search.bm25_many(pages.counts(), pages.lengths(), asked), BEST)


_NOTE_DOCS = f"""docs AS (SELECT id, {' || '.join(map(_tokens, NOTE_COLUMNS))} AS ts FROM fx_notes),
    postings AS (SELECT id, unnest(ts) AS term FROM docs)"""


@query(
    f"""WITH {_NOTE_DOCS}, {_bm25("'reaux', 'assistant', 'ment'")}
        SELECT s.id, n.book_title, n.page_number, s.score, row_number() OVER (ORDER BY s.score DESC, s.id) AS rank
        FROM (SELECT id, round(sum(part), 6) AS score FROM parts GROUP BY id HAVING count(DISTINCT term) = 3) s
        JOIN fx_notes n ON n.id = s.id""",
    "fx_notes",
)
def search_notes_ranked(spark: SparkSession, d: str) -> DataFrame:
    terms = ["reaux", "assistant", "ment"]
    notes = fx.notes(spark, d)
    rows = search.postings(notes, "id", NOTE_COLUMNS, terms)
    scores = search.bm25(rows, search.lengths(notes, "id", NOTE_COLUMNS), terms, search.match_all(rows, terms))
    found = search.ranked_rows(search.with_rank(scores), notes, "id")
    return found.select("id", "book_title", "page_number", "score", "rank")


def _ranked(accepted: str) -> str:
    return f"""SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (
        SELECT id, round(sum(part), 6) AS score FROM parts GROUP BY id) WHERE id IN (SELECT id FROM docs WHERE {accepted})"""


@query(
    f"""WITH {_POSTINGS}, {_bm25("'the', 'and'")}
        {_ranked("contains(' ' || list_aggregate(ts, 'string_agg', ' ') || ' ', ' the and the ')")}"""
)
def search_phrase_ranked(spark: SparkSession, d: str) -> DataFrame:
    pages = fx.page_index(spark, d)
    rows = pages.postings(["the", "and"])
    ids = search.match_phrase(rows, ["the", "and", "the"])
    return search.with_rank(search.bm25(rows, pages.lengths(), ["the", "and"], ids))


@query(f"""WITH {_POSTINGS}, {_bm25("'with'")} {_ranked("NOT list_has_any(ts, ['tion', 'are'])")}""")
def search_none_ranked(spark: SparkSession, d: str) -> DataFrame:
    pages = fx.page_index(spark, d)
    rows = pages.postings(["with", "tion", "are"])
    ids = search.match_terms(rows, every=["with"], none=["tion", "are"])
    return search.with_rank(search.bm25(rows, pages.lengths(), ["with"], ids))


@query(
    f"""WITH {_DOCS}, postings AS (SELECT id, 'retition' AS term FROM (SELECT id, unnest(ts) AS t FROM docs) WHERE starts_with(t, 'retition')),
        {_bm25("'retition'")} {_ranked("true")}"""
)
def search_prefix_ranked(spark: SparkSession, d: str) -> DataFrame:
    pages = fx.page_index(spark, d)
    rows = pages.postings(prefixes=["retition"])
    return search.with_rank(search.bm25_prefix(rows, pages.lengths(), "retition"))


@query(
    f"""WITH {_NOTE_DOCS}, {_bm25("'ment'")} {_ranked(f"id IN (SELECT id FROM fx_notes WHERE list_contains({_tokens('user_memo')}, 'ment'))")}""",
    "fx_notes",
)
def search_column_ranked(spark: SparkSession, d: str) -> DataFrame:
    notes = fx.notes(spark, d)
    rows = search.postings(notes, "id", NOTE_COLUMNS, ["ment"])
    ids = search.match_any(rows, ["ment"], ["user_memo"])
    return search.with_rank(search.bm25(rows, search.lengths(notes, "id", NOTE_COLUMNS), ["ment"], ids))


@query(
    f"SELECT id FROM (SELECT id, {_tokens('user_memo')} AS ts FROM fx_notes) WHERE list_contains(ts, 'ment')",
    "fx_notes",
)
def search_one_column(spark: SparkSession, d: str) -> DataFrame:
    """A term looked for in the memo only, although titles are indexed too."""
    rows = search.postings(fx.notes(spark, d), "id", NOTE_COLUMNS, ["ment"])
    return search.match_any(rows, ["ment"], ["user_memo"])

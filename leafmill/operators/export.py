"""Vocabulary exports: Markdown, CSV, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.session import keep

# Column order of the CSV export, title line of the Markdown one.
CSV_COLUMNS = ("word", "meaning", "example_sentence", "source_book", "source_page", "tags")
MARKDOWN_TITLE = "# Vocabulary List\n"


def _line(before: str, value: Column, after: Column | str = "\n") -> Column:
    end = F.lit(after) if isinstance(after, str) else after
    return F.when(value.isNotNull(), F.concat(F.lit(before), value, end)).otherwise(F.lit(""))


def markdown_entry() -> Column:
    """One entry: heading and the lines whose value is present."""
    page = F.coalesce(F.col("source_page"), F.lit(0)).cast("string")
    return F.concat(
        F.lit("## "), F.col("word"), F.lit("\n"),
        _line("**Meaning**: ", F.col("meaning")),
        _line("**Example**: ", F.col("example_sentence")),
        _line("**Source**: ", F.col("source_book"), F.concat(F.lit(" (p."), page, F.lit(")\n"))),
    )


def csv_line() -> Column:
    """One line with every field in quotes; quotes inside a field are not escaped."""
    values = [
        F.coalesce(F.col(c), F.lit(0 if c == "source_page" else "")).cast("string")
        for c in CSV_COLUMNS
    ]
    return F.concat(F.lit('"'), F.concat_ws('","', *values), F.lit('"'))


def json_entry(entries: DataFrame) -> Column:
    """One JSON object with every column; nulls are written as null."""
    return F.to_json(F.struct(*entries.columns), {"ignoreNullFields": "false"})


def markdown_lines(entries: DataFrame) -> DataFrame:
    """The Markdown document as rows in order: title first, then words.

    Entries are kept before the sort, which looks at its input twice.
    """
    body = keep(entries.select(F.lit(1).alias("_at"), "word", markdown_entry().alias("value")))
    title = entries.sparkSession.range(1).select(
        F.lit(0).alias("_at"), F.lit(None).cast("string").alias("word"), F.lit(MARKDOWN_TITLE).alias("value")
    )
    return title.unionByName(body).orderBy("_at", "word").select("value")


def export_vocabulary(entries: DataFrame, form: str, path: str) -> None:
    """Write entries to ``path`` as ``markdown``, ``csv`` or ``json``.

    The CSV writer escapes quotes inside fields, so that it can be read back.
    """
    if form == "markdown":
        markdown_lines(entries).write.mode("overwrite").text(path)
    elif form == "csv":
        filled = [
            F.coalesce(F.col(c), F.lit(0 if c == "source_page" else "")).alias(c)
            for c in CSV_COLUMNS
        ]
        (
            keep(entries.select(*filled)).orderBy("word").write.mode("overwrite")
            .option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
        )
    elif form == "json":
        entries.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    else:
        raise ValueError(f"unknown export format: {form}")

"""Small frames with odd rows, and brute-force answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LONG = "word" + " and more words" * 20_000


def docs(spark: SparkSession, texts: list[str | None]) -> DataFrame:
    """Documents 0, 1, 2, ... with columns whose names clash with those of the operators."""
    rows = [(i, t, "en", "src0", len(t or ""), "x", 5, b"y", True, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(
        rows,
        "doc_id long, text string, lang string, source string, n_chars long, id string, part int, digest binary, kept boolean, n int",
    )


def empty(spark: SparkSession) -> DataFrame:
    return docs(spark, []).limit(0)


def components(links: list[tuple[int, int]], ids: list[int]) -> dict[int, int]:
    root = {i: i for i in ids}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}

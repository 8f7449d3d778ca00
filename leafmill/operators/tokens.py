"""Characters as tokens, and decoding of per-step class scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.operators.joins import broadcast_if_small
from leafmill.operators.ordering import GROUP_ROWS, arrange

# The character vocabulary in id order.
CHARACTERS = (
    "<>"
    "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわをん"
    "がぎぐげござじずぜぞだぢづでどばびぶべぼぱぴぷぺぽ"
    "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワヲン"
)
END_TOKEN = 2
MAX_TOKENS = 512


def vocabulary(spark: SparkSession, characters: Sequence[str] = CHARACTERS) -> DataFrame:
    """``(id, token)``, one row per entry in order."""
    return spark.createDataFrame(list(enumerate(characters)), "id int, token string")


def encode(texts: DataFrame, key: str, text: str, tokens: DataFrame) -> DataFrame:
    """Token ids of each text as ``(key, pos, id)``; unknown characters are dropped.

    ``pos`` is the place of the character in the text.
    """
    characters = texts.select(key, F.posexplode(F.split(F.col(text), "")).alias("pos", "token"))
    return characters.join(broadcast_if_small(tokens), "token").select(key, "pos", "id")


def decode(
    ids: DataFrame, key: str, tokens: DataFrame, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Texts of ``(key, pos, id)`` rows; unknown ids are dropped."""
    known = ids.join(broadcast_if_small(tokens), "id")
    rows = arrange(known, [key], [F.col("pos")], "rank", group_rows)
    return rows.texts({"text": F.col("token")})


def vocabulary_size(tokens: DataFrame) -> DataFrame:
    return tokens.agg(F.count(F.lit(1)).alias("size"))


def ctc_decode(
    steps: DataFrame,
    dictionary: DataFrame,
    key: str = "line_id",
    standard: bool = False,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Greedy decoding of lines from rows ``(key, t, probs)``.

    Per step the first best class counts if its score is positive. Class 0 is
    blank; ids without a dictionary entry are dropped. A class equal to the last
    emitted one is dropped even if blanks lie between, unless ``standard``, where
    a blank separates repeats. Confidence is the emitted score per step of the
    line, 0 for an empty line. ``dictionary`` has ``(id, token)``.
    """
    best = F.array_max("probs")
    argmax = steps.select(
        key, "t", best.cast("double").alias("score"),
        F.when(best > 0, F.array_position("probs", best) - 1).otherwise(0).cast("int").alias("id"),
    )
    lengths = argmax.groupBy(key).agg(F.count(F.lit(1)).alias("steps"))
    named = argmax.join(broadcast_if_small(dictionary), "id", "left")
    emittable = (F.col("id") > 0) & F.col("token").isNotNull()
    usable = named if standard else named.filter(emittable)
    rows = arrange(usable, [key], [F.col("t")], "rank", group_rows).lag({"_last": "id"})
    changed = F.col("_last").isNull() | (F.col("_last") != F.col("id"))
    emitted = rows.df.filter(changed & emittable)
    texts = rows.with_df(emitted).texts({"text": F.col("token")}, sums={"_score": F.col("score")})
    # A line has one part unless it is very long, and few parts then.
    line = Window.partitionBy(key)
    written = F.max(F.length("text")).over(line) > 0
    confidence = F.when(written, F.sum("_score").over(line) / F.col("steps"))
    return lengths.join(texts, key, "left").select(
        key,
        F.coalesce("part", F.lit(0)).alias("part"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(confidence, F.lit(0.0)).alias("confidence"),
    )

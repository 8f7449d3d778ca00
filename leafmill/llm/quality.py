"""Quality rules whose cutoffs are chosen with a bound on false rejections.

Each document gets counts (words, symbols, repeated lines, ...). A rule rejects above a cutoff of one ratio. For
every stratum, rule and cutoff the labelled documents are a holdout: of its good ones, so many are rejected. A
cutoff is allowed where an exact binomial test shows, at a level corrected for all cutoffs tested (Bonferroni),
that the share of good documents it rejects is below the rule's part of the allowed risk. Of the allowed cutoffs
the one that catches the most bad documents is taken, looser ones first; without one the rule rests there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.words import text_digest
from leafmill.session import keep

# Base rule of the contract.
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5

# Symbols counted one by one, and the white space that separates words.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"

# Rule: numerator, denominator, cutoffs from strict to loose.
RULES = {
    "symbols": ("n_symbols", "n_words", (0.02, 0.05, 0.1, 0.2, 0.3, 0.5)),
    "capitals": ("n_capitals", "n_letters", (0.1, 0.2, 0.3, 0.5, 0.7)),
    "repeats": ("n_repeat_words", "n_words", (0.02, 0.05, 0.1, 0.15)),
    "lines": ("n_dup_lines", "n_lines", (0.1, 0.2, 0.3, 0.5)),
    "exclamations": ("n_exclamations", "n_words", (0.1, 0.2, 0.3, 0.5)),
}
RISK = 0.02  # share of good documents that all rules together may reject in a stratum
ERROR = 0.05  # chance that any of these bounds fails
GOOD_COST = 20  # a good document rejected weighs like so many bad ones caught

COUNTS = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_letters n_capitals n_exclamations".split()


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """One row per document: ``doc_id``, ``stratum``, ``digest`` (``text_digest``) and the counts of ``COUNTS``.

    A null text has no words; a null stratum is the empty string. Rows that repeat an id or have none are counted each;
    an empty table gives no rows. Other columns are dropped.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.coalesce(F.col(f"`{stratum_col}`").cast("string"), F.lit("")).alias("stratum"),
        text_digest(F.col(f"`{text_col}`")).alias("digest"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_counts(text.as_py()) for text in batch.column("text")]
            columns = [pa.array(c, pa.int64()) for c in (zip(*found) if found else [()] * len(COUNTS))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["doc_id", "stratum", "digest", *COUNTS])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_type}, stratum string, digest binary, " + ", ".join(f"{c} long" for c in COUNTS))


def _counts(text: str) -> tuple[int, ...]:
    words = text.encode().split()  # of bytes: cut at the six ASCII blanks only
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        _repeated(words),
        len(lines),
        sum(map(str.isalpha, text)),
        sum(map(str.isupper, text)),
        text.count("!"),
    )


def _repeated(words: list[bytes]) -> int:
    """Words that lie in a window of ``WINDOW`` words which occurs again in the text."""
    import numpy as np

    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    base = len(number)
    keys = ids[:n]
    for k in range(1, WINDOW):
        if int(keys.max()) >= (1 << 62) // base:  # renumber, so that keys stay exact
            keys = np.unique(keys, return_inverse=True)[1].astype(np.int64)
        keys = keys * base + ids[k : k + n]
    _, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.flatnonzero(count[inverse] > 1)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edges)))


def base_failed() -> Column:
    words, repeats = F.col("n_words"), F.col("n_repeat_words")
    return (words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * words)


def _ratio(rule: str) -> Column:
    top, bottom, _ = RULES[rule]
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))


def _tail(n: int, k: int, p: float) -> float:
    """Exact P(at most k of n) at rate p, for k below n * p; terms shrink from k downwards."""
    term = math.exp(
        math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    )
    total = term
    while k > 0 and term > total * 1e-15:
        term *= k * (1 - p) / ((n - k + 1) * p)
        k -= 1
        total += term
    return min(1.0, total)


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """One row per stratum: for each rule its cutoff, or null where none is allowed.

    ``labels`` has ``doc_id`` and ``quality`` (1 good, 0 bad, others ignored); a document labelled twice counts as
    good only if all its labels are. Documents that fail the base rule are left out, as no cutoff decides on them.
    Strata without labelled documents have no row.
    """
    quality = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    marked = measured.where(~base_failed()).join(quality, "doc_id")
    tests = F.array(
        *[
            F.struct(F.lit(rule).alias("rule"), F.lit(cutoff).alias("cutoff"), (_ratio(rule) > cutoff).alias("over"))
            for rule, (_, _, steps) in RULES.items()
            for cutoff in steps
        ]
    )
    counted = (
        marked.select("stratum", "quality", F.explode(tests).alias("t"))
        .groupBy("stratum", "t.rule", "t.cutoff")
        .agg(
            F.sum("quality").alias("good"),
            F.sum(F.when(F.col("t.over"), F.col("quality")).otherwise(0)).alias("good_over"),
            F.sum(F.when(F.col("t.over"), 1 - F.col("quality")).otherwise(0)).alias("bad_over"),
        )
    )
    every = counted.withColumn("tests", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))  # strata * cutoffs rows
    part = risk / len(RULES)

    @F.pandas_udf("boolean")
    def allowed(good: pd.Series, over: pd.Series, tests: pd.Series) -> pd.Series:
        return pd.Series(
            [k < n * part and _tail(int(n), int(k), part) <= error / m for n, k, m in zip(good, over, tests)], dtype=bool
        )

    # With doubled labels or none over, an unused cutoff must not win: it has to catch something.
    gain = F.col("bad_over") - GOOD_COST * F.col("good_over")
    best = every.where(allowed("good", "good_over", "tests")).where(gain > 0)
    chosen = best.groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct(gain, F.col("cutoff"))).alias("cutoff"))
    return chosen.groupBy("stratum").agg(
        *[F.max(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"max_{rule}") for rule in RULES]
    )


def judge(measured: DataFrame, chosen: DataFrame) -> DataFrame:
    """Adds ``base_failed`` and ``kept``; a stratum without cutoffs is judged by the base rule alone."""
    judged = measured.join(chosen, "stratum", "left")
    over = F.lit(False)
    for rule in RULES:
        over = over | F.coalesce(_ratio(rule) > F.col(f"max_{rule}"), F.lit(False))
    return judged.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~over)


def rate(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` per document of (doc_id, text, lang). The counts are kept.

    See :func:`measure` for odd rows; ``labels`` may be empty, then the base rule decides alone.
    """
    measured = keep(measure(docs))
    return judge(measured, cutoffs(measured, labels, risk, error))

"""Expressions over score and token arrays."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Channel means and deviations used to standardise pixels.
CHANNEL_MEAN = (0.485, 0.456, 0.406)
CHANNEL_STD = (0.229, 0.224, 0.225)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also inside its lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def last_argmax(scores: Column) -> Column:
    """0-based index of the largest score; the last one on ties."""
    from_end = F.array_position(F.reverse(scores), F.array_max(scores))
    return (F.size(scores) - from_end).cast("int")


def first_argmax(scores: Column) -> Column:
    """0-based index of the largest score; the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def ranked_tokens(scores: Column) -> Column:
    """Structs (neg, token) from the best score down, smaller token first on ties."""
    pairs = F.transform(scores, lambda s, i: F.struct((-s).alias("neg"), i.alias("token")))
    return F.sort_array(pairs)


def top_k(scores: Column, k: int) -> Column:
    return F.slice(ranked_tokens(scores), 1, k)


def top_p(scores: Column, p: float) -> Column:
    """The shortest best-first list of tokens whose softmax mass reaches ``p``.

    A token is in the list if the mass of the tokens before it is below ``p``.
    """
    start = F.struct(
        F.lit(0.0).alias("mass"),
        F.array().cast("array<struct<token:int,probability:double>>").alias("kept"),
    )

    def weight(pair: Column, best: Column) -> Column:
        return F.exp(-pair["neg"].cast("double") - best)

    def fold(once: Column) -> Column:
        def step(acc: Column, pair: Column) -> Column:
            probability = weight(pair, once["best"]) / once["total"]
            entry = F.struct(
                pair["token"].cast("int").alias("token"), probability.alias("probability")
            )
            longer = F.concat(acc["kept"], F.array(entry))
            kept = F.when(acc["mass"] < p, longer).otherwise(acc["kept"])
            return F.struct((acc["mass"] + probability).alias("mass"), kept.alias("kept"))

        return F.aggregate(once["pairs"], start, step, lambda acc: acc["kept"])

    def with_total(once: Column) -> Column:
        total = F.aggregate(
            once["pairs"], F.lit(0.0), lambda acc, pair: acc + weight(pair, once["best"])
        )
        return let(
            F.struct(once["pairs"].alias("pairs"), once["best"].alias("best"), total.alias("total")),
            fold,
        )

    best = F.array_max(scores).cast("double")
    return let(F.struct(ranked_tokens(scores).alias("pairs"), best.alias("best")), with_total)


def min_max(values: Column) -> Column:
    """Values scaled to [0, 1]; unchanged if all are equal."""

    def scaled(edge: Column) -> Column:
        moved = F.transform(values, lambda v: (v - edge["low"]) / (edge["high"] - edge["low"]))
        return F.when(edge["high"] == edge["low"], values).otherwise(moved)

    edges = F.struct(F.array_min(values).alias("low"), F.array_max(values).alias("high"))
    return let(edges, scaled)


def standardise_channel(
    value: Column,
    channel: Column,
    mean: Sequence[float] = CHANNEL_MEAN,
    std: Sequence[float] = CHANNEL_STD,
) -> Column:
    """A 0–255 value scaled to 0–1 and standardised with its channel's constants."""
    means = F.array(*[F.lit(m) for m in mean])
    stds = F.array(*[F.lit(s) for s in std])
    return (value / F.lit(255.0) - F.get(means, channel)) / F.get(stds, channel)


def until_end(tokens: Column, end: int, limit: int) -> Column:
    """Tokens up to and including the first ``end`` token, at most ``limit``."""
    at = F.array_position(tokens, F.lit(end).cast("int"))
    length = F.when(at == 0, F.size(tokens)).otherwise(at).cast("int")
    return F.slice(tokens, F.lit(1), F.least(length, F.lit(limit)))

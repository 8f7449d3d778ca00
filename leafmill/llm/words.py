"""Shared small pieces: columns of an operator's input, words, and chunks a tokenizer can take one by one."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space of the word rule: space and the five ASCII controls from tab to carriage return.
WHITE = r"[\x20\x09-\x0D]+"
NOT_WHITE = r"[^\x20\x09-\x0D]+"

_BLANK_RUN = re.compile(r"(?:^|\s) ")


def narrow(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text (null: empty), under fixed names, so other columns cannot clash."""
    return df.select(
        F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    )


def text_digest(text: Column) -> Column:
    """16 bytes that stand for a text (null: empty), where rows that share an id are told apart."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def one_space(text: Column) -> Column:
    """White space runs as one space each."""
    return F.regexp_replace(text, WHITE, " ")


def pieces(text: str) -> list[str] | None:
    """``text`` cut before each space, spaces dropped; None if a space follows white space or starts the text.

    A byte-level pre-tokenizer always cuts between a visible character and a space, so every piece with its
    space in front can be encoded on its own.
    """
    return None if _BLANK_RUN.search(text) else text.split(" ")


class Memo(dict):
    """Results by key, made when first asked for. It starts afresh at ``limit`` entries, so memory is bounded."""

    def __init__(self, make: Callable, limit: int = 300_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        made = self[key] = self.make(key)
        return made

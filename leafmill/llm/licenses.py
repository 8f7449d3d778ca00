"""Licence scan by the Dice coefficient over word bigrams, in DataFrame operations only.

A text is compared in units: each line, each paragraph and the whole. A licence that none of them names is looked for
in windows of words anywhere in the text, so it may stand in a running line or be wrapped over comment lines. A unit
of a bigrams can only reach the threshold t with a template of b bigrams if ``a * t / (2 - t) <= b <= a * (2 - t) / t``,
so its size names its candidate templates. It must also share at least two thirds (for t = 0.8) of a template's
bigrams; any larger choice of them therefore holds a shared one. Texts without a word of that choice, and texts that
as a whole lack too many bigrams of every template, are passed over unsplit.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import partial, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.words import narrow

THRESHOLD = 0.8

# Notices of public licences, by SPDX identifier.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def bigrams_of(text: str) -> list[str]:
    words = _words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def _least(own: list[str], threshold: float) -> int:
    """Bigrams of a template that must be shared."""
    return math.ceil(len(own) * threshold / (2 - threshold) - 1e-9)


def markers(templates: tuple[tuple[str, str], ...], threshold: float) -> list[str]:
    """Words of which every text that reaches the threshold holds one.

    Of each template so many bigrams are chosen that not all can be missing, those with the longest words first.
    """
    found = set()
    for _, text in templates:
        own = sorted(bigrams_of(text), key=lambda b: (-max(map(len, b.split())), b))
        found |= {max(b.split(), key=len) for b in own[: len(own) - _least(own, threshold) + 1]}
    return sorted(found)


def normalised(text: Column) -> Column:
    """Lower case, words of letters and digits, one space between them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _pairs(text: Column) -> Column:
    """The bigrams of a normalised text, in its order and as often as it has them."""

    def of(words: Column) -> Column:
        pairs = F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.concat_ws(" ", a, b))
        return F.slice(pairs, F.lit(1), F.size(words) - 1)

    return _once(F.split(text, " "), of)


def _listed(own: list[str]) -> Column:
    return F.array(*map(F.lit, own))


def _dice(bigrams: Column, n: Column, own: list[str]) -> Column:
    return 2 * F.size(F.array_intersect(bigrams, _listed(own))) / (n + len(own))


def _windows(pairs: Column, text: str, threshold: float) -> Column:
    """The best window for each start: (start, end, dice), in their order. It starts and ends with a shared bigram."""
    own, wide = bigrams_of(text), (2 - threshold) / threshold
    shortest = math.ceil(len(own) / wide - 1e-9)
    repeats = max(0, len(_words(text)) - 1 - len(own))
    longest = math.floor(len(own) * wide + 1e-9) + repeats
    shared = lambda pair: F.array_contains(_listed(own), pair)
    numbers = lambda array: F.sequence(F.lit(1), F.size(array))

    def best(start: Column, ahead: Column) -> Column:
        def scored(n: Column) -> Column:
            window = F.slice(ahead, F.lit(1), n)
            return F.struct(_dice(window, F.size(F.array_distinct(window)), own).alias("dice"), (-n).alias("n"))

        ends = F.filter(numbers(ahead), lambda n: (n >= shortest) & shared(F.element_at(ahead, n)))
        enough = F.size(F.array_intersect(ahead, _listed(own))) >= _least(own, threshold)
        top = F.when(enough, F.array_max(F.transform(ends, scored)))
        return _once(top, lambda t: F.struct(start.alias("start"), (start - t["n"] - 1).alias("end"), t["dice"].alias("dice")))

    starts = F.filter(numbers(pairs), lambda i: shared(F.element_at(pairs, i)))
    found = F.transform(starts, lambda i: _once(F.slice(pairs, i, F.lit(longest)), lambda ahead: best(i, ahead)))
    return F.filter(found, lambda w: w["dice"] >= threshold)


def _places(pairs: Column, texts: list[str], threshold: float) -> Column:
    """Highest Dice of all windows, and their number; windows that overlap are one place."""
    windows = F.array_sort(F.flatten(F.array(*[_windows(pairs, text, threshold) for text in texts])))
    none = F.struct(F.lit(0.0).alias("dice"), F.lit(0).alias("units"), F.lit(0).alias("end"))

    def further(so_far: Column, w: Column) -> Column:
        return F.struct(
            F.greatest(so_far["dice"], w["dice"]).alias("dice"),
            (so_far["units"] + (w["start"] > so_far["end"]).cast("int")).alias("units"),
            F.greatest(so_far["end"], w["end"]).alias("end"),
        )

    return F.aggregate(windows, none, further)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and licence it names: ``license``, best ``dice``, and ``units`` that reach the threshold.

    Where no line, paragraph or whole text of a document names a licence, the units are the places in running text.
    Null, empty or one-word texts have no bigrams and no rows. Rows that repeat an id add up. An empty table gives
    no rows. Other columns are dropped.
    """
    words = "|".join(map(re.escape, markers(templates, threshold)))
    texts = [(name, bigrams_of(text)) for name, text in templates]
    # Bigrams of a part are bigrams of the whole, so a text that lacks too many has no part that reaches the threshold.
    known = F.array_intersect(_pairs(normalised(F.col("text"))), _listed(sorted({b for _, own in texts for b in own})))
    enough = lambda here, own: F.size(F.array_intersect(here, _listed(own))) >= _least(own, threshold)
    some = F.exists(F.array(known), lambda here: reduce(or_, [enough(here, own) for _, own in texts]))
    rows = narrow(docs, id_col, text_col).where(F.lower("text").rlike(words)).where(some)
    # A text of one line is one unit, and so is a paragraph of one line.
    parts = F.array_distinct(
        F.concat(
            F.transform(F.split("text", "\n", -1), normalised),
            F.transform(F.split("text", r"\n[\x20\t\r]*\n", -1), normalised),
            F.array(normalised(F.col("text"))),
        )
    )
    marked = lambda unit, running: F.struct(unit.alias("unit"), F.lit(running).alias("running"))
    whole = F.array(marked(normalised(F.col("text")), True))
    units = rows.select("id", F.inline(F.concat(F.transform(parts, lambda p: marked(p, False)), whole)))
    sized = units.where(F.col("unit").rlike(words)).select("id", "running", _pairs(F.col("unit")).alias("pairs"))
    sized = sized.where(F.size("pairs") > 0).withColumn("bigrams", F.array_distinct("pairs"))
    wide = (2 - threshold) / threshold
    size, running = F.size("bigrams"), F.col("running")

    def hit(name: str, dice: Column, n: Column) -> Column:
        return F.struct(F.lit(name).alias("license"), dice.alias("dice"), n.alias("n"))

    scores = [
        F.when(
            ~running & (size <= math.floor(len(own) * wide + 1e-9)) & (size >= math.ceil(len(own) / wide - 1e-9)),
            hit(name, _dice(F.col("bigrams"), size, own), F.lit(1)),
        )
        for name, own in texts
    ]
    for name in dict.fromkeys(name for name, _ in templates):
        some = reduce(or_, [enough(F.col("bigrams"), own) for n, own in texts if n == name])
        places = _places(F.col("pairs"), [text for n, text in templates if n == name], threshold)
        scores.append(F.when(running & some, _once(places, partial(lambda name, p: hit(name, p["dice"], p["units"]), name))))
    hits = sized.select("id", "running", F.inline(F.array_compact(F.array(*scores)))).where(F.col("dice") >= threshold)
    own_unit = lambda value: F.when(~running, value)
    return hits.groupBy(F.col("id").alias("doc_id"), "license").agg(
        F.coalesce(F.max(own_unit(F.col("dice"))), F.max("dice")).alias("dice"),
        F.coalesce(F.sum(own_unit(F.col("n"))), F.sum("n")).alias("units"),
    )

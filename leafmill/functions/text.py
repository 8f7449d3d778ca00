"""String expressions: words, tokens, sentences, previews, HTML."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters with the Unicode White_Space property.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Part-of-speech code and its label.
PART_OF_SPEECH_LABELS = {
    "noun": "名詞",
    "verb": "動詞",
    "adjective": "形容詞",
    "adverb": "副詞",
    "particle": "助詞",
    "unknown": "不明",
}


def _accent_pairs() -> tuple[str, str]:
    """Lower-case Latin letters with one mark, and their base letters, by decomposition.

    Letters with two marks stay as they are, which is the usual default of search tokenizers.
    """
    marked, base = [], []
    for point in (*range(0x00DF, 0x0250), *range(0x1E00, 0x1F00)):
        letter = chr(point)
        parts = unicodedata.normalize("NFD", letter)
        if len(parts) == 2 and parts[0].isascii() and letter == letter.lower():
            marked.append(letter)
            base.append(parts[0])
    return "".join(marked), "".join(base)


ACCENTED, UNACCENTED = _accent_pairs()


def words(text: Column) -> Column:
    """Lower-cased words of a text, in order, repeats kept.

    A word is a whole whitespace-delimited token made of letters only and longer
    than two UTF-8 bytes. A text without any ASCII character has no words.
    """
    tokens = F.regexp_extract_all(text, F.lit(r"(?U)(?<!\S)\p{IsAlphabetic}++(?!\S)"), F.lit(0))
    long_enough = F.filter(tokens, lambda w: F.octet_length(w) > 2)
    lowered = F.transform(long_enough, lambda w: F.lower(w))
    nothing = F.array().cast("array<string>")
    return F.when(text.rlike(r"[\x00-\x7F]"), lowered).otherwise(nothing)


def search_tokens(text: Column) -> Column:
    """Index terms of a text: lower case, no accents or combining marks, runs of letters and digits."""
    plain = F.regexp_replace(F.translate(F.lower(text), ACCENTED, UNACCENTED), r"\p{Mn}+", "")
    return letter_runs(plain)


def letter_runs(text: Column) -> Column:
    """Runs of letters and digits, in order."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def sentences(text: Column) -> Column:
    return F.split(text, "[。.！!]")


def first_sentence(parts: Column, word: Column) -> Column:
    """The first of ``parts`` that contains ``word`` as written, trimmed; else null."""
    found = F.filter(parts, lambda s: F.contains(s, word))
    return F.btrim(F.get(found, F.lit(0)), F.lit(WHITE_SPACE))


def one_sentence_end(text: str) -> str:
    """``text`` with every sentence end written as a full stop."""
    return text.replace("。", ".").replace("！", ".").replace("!", ".")


def sentence_at(text: str, word: str) -> str | None:
    """What ``first_sentence`` gives for a ``word`` of letters, found without a search of all sentences.

    ``text`` has full stops as its only sentence ends. A word of letters reaches over none of them, so its first place in
    the text lies in that sentence.
    """
    place = text.find(word)
    if place < 0:
        return None
    end = text.find(".", place)
    return text[text.rfind(".", 0, place) + 1 : len(text) if end < 0 else end].strip(WHITE_SPACE)


def part_of_speech_label(code: Column) -> Column:
    pairs = [F.lit(x) for pair in PART_OF_SPEECH_LABELS.items() for x in pair]
    return F.create_map(*pairs)[F.lower(code)]


def preview(text: Column, characters: int = 100) -> Column:
    """The first characters and always an ellipsis; null stays null."""
    return F.concat(F.substring(text, 1, characters), F.lit("..."))


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def title_or_stem(title: Column, path: Column) -> Column:
    """The title, else the file name without extension, else ``Unknown``."""
    return F.coalesce(
        F.nullif(title, F.lit("")), F.nullif(file_stem(path), F.lit("")), F.lit("Unknown")
    )


# Literal replacements of the page renderer, in the order applied.
HTML_REPLACEMENTS = (
    ("\n# ", "\n<h1>"),
    ("\n", "</h1>\n"),
    ("\n## ", "\n<h2>"),
    ("\n", "</h2>\n"),
    ("\n### ", "\n<h3>"),
    ("\n", "</h3>\n"),
    ("**", "<strong>"),
    ("**", "</strong>"),
    ("\n\n", "</p><p>"),
    ("\n", "<br/>"),
)


def markdown_html(markdown: Column) -> Column:
    """HTML of a page by the fixed chain of replacements."""
    html = markdown
    for old, new in HTML_REPLACEMENTS:
        html = F.replace(html, F.lit(old), F.lit(new))
    return F.concat(F.lit("<p>"), html, F.lit("</p>"))

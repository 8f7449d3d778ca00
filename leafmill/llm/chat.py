"""Chat formatting with a round trip through its own grammar, in DataFrame operations only.

    conversation = turn*
    turn         = "### " role ": " text "</turn>" newline

A backslash takes the meaning from the character behind it. Texts are first rendered as they are; every turn is
parsed again, and where the parser does not give back the same role and text, the next level of escaping is taken,
until it does. The whole conversation is parsed once more and compared turn by turn; a difference stops the job.

The loss mask is a list of byte ranges in the UTF-8 form of the conversation, one per assistant text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
LEARNED = "assistant"

# What each level puts a backslash before: nothing, backslashes and control strings, all characters they start with.
LEVELS = (None, r"\\|<(?=/turn>)|#(?=## )", r"[\\<#]")

_ROLE = r"((?:[^\\:]|\\.)*+)"
_TEXT = r"((?:[^\\<#]|\\.|<(?!/turn>)|#(?!## ))*+)"
TURN = f"(?s){OPEN}{_ROLE}{MIDDLE}{_TEXT}{CLOSE}"
_ONE = rf"(?s)\A{OPEN}{_ROLE}{MIDDLE}{_TEXT}{CLOSE}\z"


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _escaped(text: Column, pattern: str | None) -> Column:
    return text if pattern is None else F.regexp_replace(text, pattern, r"\\$0")


def _role(role: Column) -> Column:
    return F.regexp_replace(role, r"[\\:#<]", r"\\$0")


def render(turns: DataFrame) -> DataFrame:
    """Adds to (role, text): ``level``, the least escaping that survives the parser, and ``body``, the escaped text."""
    body, level = None, None
    for n, pattern in reversed(list(enumerate(LEVELS))):
        tried = _escaped(F.col("text"), pattern)
        whole = F.concat(F.lit(OPEN), _role(F.col("role")), F.lit(MIDDLE), tried, F.lit(CLOSE))
        same = (
            whole.rlike(_ONE)
            & (unescape(F.regexp_extract(whole, _ONE, 1)) == F.col("role"))
            & (unescape(F.regexp_extract(whole, _ONE, 2)) == F.col("text"))
        )
        body = tried if body is None else F.when(same, tried).otherwise(body)
        level = F.lit(n) if level is None else F.when(same, n).otherwise(level)
    # A text without a special character needs no trial.
    plain = ~F.col("text").rlike(r"[\\<#]")
    return turns.withColumn("level", F.when(plain, 0).otherwise(level)).withColumn(
        "body", F.when(plain, F.col("text")).otherwise(body)
    )


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a conversation; null if anything in it is no turn."""
    part = lambda n: F.regexp_extract_all(formatted, F.lit(TURN), F.lit(n))
    turns = F.zip_with(part(1), part(2), lambda r, t: F.struct(unescape(r).alias("role"), unescape(t).alias("text")))
    return F.when(F.array_join(part(0), "") == formatted, turns)


def masked(formatted: Column, loss: Column) -> Column:
    """The texts under a loss mask, cut out of the formatted conversation by its byte ranges and unescaped."""
    raw = formatted.cast("binary")
    cut = lambda m: F.substring(raw, (m["start"] + 1).cast("int"), m["length"].cast("int")).cast("string")
    return F.transform(loss, lambda m: unescape(cut(m)))


def _digests(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.xxhash64(t["role"], t["text"]))


def format_conversations(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per conversation: ``formatted``, ``loss`` (byte ranges: start, length), ``turns`` as parsed, ``level``.

    Rows are ordered by turn (null first), equal turns by role and text. Null role or text counts as empty; rows
    without a conversation are one conversation. Repeated rows are turns of their own. An empty table gives no
    rows. Other columns are dropped. A conversation is one string, so it must fit into a row.
    """
    rows = conversations.select(
        F.col(f"`{conv_col}`").alias("conv_id"),
        F.col(f"`{turn_col}`").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    head = F.concat(F.lit(OPEN), _role(F.col("role")), F.lit(MIDDLE))
    pieces = render(rows).select(
        "conv_id", "turn", "role", "text", "level", "body", head.alias("head"),
        F.xxhash64("role", "text").alias("digest"),
        (F.octet_length(head) + F.octet_length("body") + F.octet_length(F.lit(CLOSE))).cast("long").alias("bytes"),
    )
    placed = pieces.select(
        "*", F.row_number().over(order).alias("nth"), (F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes")).alias("at")
    )
    mask = F.struct((F.col("at") + F.octet_length("head")).alias("start"), F.octet_length("body").cast("long").alias("length"))
    piece = F.struct(
        "nth", F.concat("head", "body", F.lit(CLOSE)).alias("piece"), "digest", F.when(F.col("role") == LEARNED, mask).alias("loss")
    )
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("pieces"), F.max("level").alias("level"))
    joined = whole.select(
        "conv_id", "level",
        F.array_join(F.col("pieces.piece"), "").alias("formatted"),
        F.array_compact(F.col("pieces.loss")).alias("loss"),
        F.col("pieces.digest").alias("digests"),
    )
    parsed = joined.withColumn("turns", parse(F.col("formatted")))
    same = F.coalesce(_digests(F.col("turns")) == F.col("digests"), F.lit(False))
    checked = F.when(same, F.col("turns")).otherwise(F.raise_error(F.lit("a conversation does not survive its grammar")))
    return parsed.select("conv_id", "formatted", "loss", "level", checked.alias("turns"))

"""One query per operator, over whole tables, with the SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import (
    bpe, chat, exact_dedup, licenses, merkle, ngram_join, packing, pii, quality, substring_dedup, token_counts,
    vector_codes, warc,
)
from leafmill.sources.tables import sample_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}

PACK_RANKS, PACK_JSON = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"
BPE_RANKS = "byte_bpe_multi_50k.tiktoken"
COUNT_JSON = "word_bpe_49k.json"
TOKEN_LIMIT = 2048


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            CHECKS[function.__name__] = sql.strip()
        return function

    return add


def pack_encoder() -> packing.Encode:
    return packing.encoder(
        public_tokenizers.path(PACK_RANKS), public_tokenizers.path(PACK_JSON), public_tokenizers.PATTERN
    )


@query()
def op1_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(sample_table(spark, d, "documents"), pack_encoder)


@query()
def op2_pii(spark: SparkSession, d: str) -> DataFrame:
    found = pii.report(sample_table(spark, d, "documents"))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans"
    )


@query(
    r"""WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS text FROM documents),
    g AS (SELECT text, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(text) AS text_sha256 FROM n JOIN g USING (text)"""
)
def op3_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    found = exact_dedup.duplicates(sample_table(spark, d, "documents"))
    return found.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


@query()
def op4_bpe(spark: SparkSession, d: str) -> DataFrame:
    path = public_tokenizers.path(BPE_RANKS)
    encoded = bpe.encode(sample_table(spark, d, "documents"), path, public_tokenizers.PATTERN)
    return bpe.decode(encoded, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query(
    """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    q AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
    w AS (SELECT *, CASE WHEN payload_bytes >= 1000
        THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS winner FROM q)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id <> winner THEN winner END AS refers_to FROM w"""
)
def op9_warc(spark: SparkSession, d: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    index = warc.write(sample_table(spark, d, "pages"), folder)
    records = warc.read(index, folder).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    records = records.withColumn("payload_digest", F.coalesce(F.sha1("payload"), F.col("payload_digest")))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    read = records.select(columns)
    responses = read.where("record_type = 'response'")
    sizes = responses.select(
        F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("of_response"), F.col("payload_digest").alias("digest")
    )
    # The full payload of a revisit is that of the response it names.
    revisits = (
        read.where("record_type = 'revisit'")
        .join(sizes, "refers_to", "left")
        .withColumn("payload_bytes", F.col("of_response"))
        .withColumn("payload_digest", F.col("digest"))
    )
    return responses.select(columns).unionByName(revisits.select(columns))


@query()
def op5_ngram_join(spark: SparkSession, d: str) -> DataFrame:
    return ngram_join.link(sample_table(spark, d, "documents")).select("doc_id", "n_shingles", "component_id")


@query()
def op6_quality(spark: SparkSession, d: str) -> DataFrame:
    found = quality.rate(sample_table(spark, d, "documents"), sample_table(spark, d, "labels"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "stratum", *[f"max_{rule}" for rule in quality.RULES],
    )


# The conversation that the query adds, as fixed values.
ADDED_CONVERSATION = -7
ADDED_TEXT = r"\### Assistant: </turn> ok"


@query(
    rf"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT {ADDED_CONVERSATION}, n, CASE WHEN n = 0 THEN 'user' ELSE 'assistant' END, '{ADDED_TEXT}' FROM range(2) t(n)),
    e AS (SELECT *, regexp_replace(text, '\\|</turn>|###( )', '\\\0', 'g') AS escaped FROM c),
    o AS (SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
        sum(length(role) + length(CASE WHEN text LIKE '%\%' OR text LIKE '%</turn>%' OR text LIKE '%### %' THEN escaped ELSE text END) + 14) AS chars
        FROM e GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
        chars::BIGINT AS formatted_chars FROM o"""
)
def op7_chat(spark: SparkSession, d: str) -> DataFrame:
    added = spark.range(2).select(
        F.lit(ADDED_CONVERSATION).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(ADDED_TEXT).alias("text"),
    )
    rows = sample_table(spark, d, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = chat.format_conversations(rows).select(
        "conv_id", "formatted", F.size("turns").cast("long").alias("n_turns"), F.array_join(turns, "").alias("said"),
        F.array_join(chat.masked(F.col("formatted"), F.col("loss")), "").alias("loss"),
    )
    return read.select(
        "conv_id", "n_turns",
        F.sha2("said", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query()
def op8_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    found = substring_dedup.remove_repeats(sample_table(spark, d, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def _license_sql() -> str:
    quoted = ",".join(f"('{name}', '{text.replace(chr(39), chr(39) * 2)}')" for name, text in licenses.TEMPLATES)
    return rf"""WITH t AS (SELECT row_number() OVER () AS nr, n AS license, x AS text FROM (VALUES {quoted}) v(n, x)),
    u AS (SELECT doc_id, unnest(list_distinct(list_transform(string_split(text, chr(10)) || regexp_split_to_array(text, '\n[ \t\r]*\n') || [text],
        lambda s: trim(regexp_replace(lower(s), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))))) AS unit FROM documents),
    w AS (SELECT doc_id, unit, string_split(unit, ' ') AS w FROM u UNION ALL
        SELECT NULL, nr::VARCHAR, string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') FROM t),
    g AS (SELECT doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) > 1),
    s AS (SELECT d.doc_id, license, 2 * len(list_intersect(d.g, b.g)) / (len(d.g) + len(b.g)) AS dice
        FROM g d, g b JOIN t ON b.doc_id IS NULL AND b.unit = t.nr::VARCHAR WHERE d.doc_id IS NOT NULL AND d.unit SIMILAR TO '.*(licen|permi|redistrib).*')
    SELECT doc_id, license, max(dice) AS dice, count(*) AS units FROM s WHERE dice >= {licenses.THRESHOLD} GROUP BY doc_id, license"""


@query(_license_sql())
def op10_licenses(spark: SparkSession, d: str) -> DataFrame:
    return licenses.scan(sample_table(spark, d, "documents"))


MANIFEST_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _manifest_sql(levels: int = 9, tree_levels: int = 4) -> str:
    """The manifest for trees of up to 8 to the number of levels leaves."""

    def field(column: str) -> str:
        return f"coalesce(octet_length(encode({column}::VARCHAR))::VARCHAR || ':' || {column}::VARCHAR, '-')"

    def climb(name: str, depth: int) -> list[str]:
        """Nodes of each level and the digests beside them, from ``{name}0`` on."""
        steps = []
        for k in range(depth):
            beside = "coalesce(string_agg(d, '') OVER (PARTITION BY tree, pos // 8 ORDER BY pos ROWS BETWEEN {}), '')"
            steps += [
                f"{name}s{k} AS (SELECT tree, pos, n, {beside.format('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS l,"
                f" {beside.format('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS r FROM {name}{k})",
                f"{name}{k + 1} AS (SELECT tree, pos // 8 AS pos, CASE WHEN min(n) > 1 THEN sha256(string_agg(d, '' ORDER BY pos)) ELSE min(d) END AS d,"
                f" (min(n) + 7) // 8 AS n FROM {name}{k} GROUP BY tree, pos // 8)",
            ]
        return steps

    def fold(name: str, depth: int, source: str) -> list[str]:
        """``source`` (tree, pos, f, proof) hashed up level by level, to ``{name}f{depth}``."""
        steps = [f"{name}f0 AS ({source})"]
        for k in range(depth):
            steps.append(
                f"{name}f{k + 1} AS (SELECT o.* REPLACE (CASE WHEN n > 1 THEN sha256(l || f || r) ELSE f END AS f,"
                f" CASE WHEN n > 1 THEN proof || l || r ELSE proof END AS proof) FROM {name}f{k} o JOIN {name}s{k} s"
                f" ON o.tree = s.tree AND o.pos // {8**k} = s.pos)"
            )
        return steps

    leaf = " || ".join(map(field, MANIFEST_COLUMNS))
    tampered = " || ".join(field(f"translate(text, '{UPPER}', '{LOWER}')" if c == "text" else c) for c in MANIFEST_COLUMNS)
    # CRC-32, a byte and then its eight bits (256) at a time.
    bits = "flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT] || repeat([256::BIGINT], 8)))"
    crc = (
        f"xor(4294967295, list_reduce([4294967295::BIGINT] || {bits}, lambda a, x:"
        " CASE WHEN x < 256 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"
    )
    parts = [
        f"h AS (SELECT doc_id, coalesce('=' || lang, '-') AS tree, sha256({leaf}) AS leaf,"
        f" CASE WHEN {crc} % 3 = 0 THEN sha256({tampered}) ELSE sha256({leaf}) END AS tampered FROM documents)",
        "p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM h)",
        "a0 AS (SELECT tree, pos, leaf AS d, count(*) OVER (PARTITION BY tree) AS n FROM p)",
        *climb("a", levels),
        f"b0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, d, count(*) OVER () AS n, tree AS name FROM a{levels})",
        *climb("b", tree_levels),
        *fold("a", levels, "SELECT doc_id, tree, pos, leaf, tampered AS f, '' AS proof FROM p"),
        *fold(
            "b", tree_levels,
            f"SELECT doc_id, b0.tree, b0.pos, leaf, b0.d AS subroot, f, proof FROM af{levels} o JOIN b0 ON o.tree = b0.name",
        ),
    ]
    return (
        f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, f AS folded_root,"
        f" f = d AS verified FROM bf{tree_levels}, b{tree_levels}"
    )


@query(_manifest_sql())
def op11_merkle(spark: SparkSession, d: str) -> DataFrame:
    picked = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    lowered = F.when(picked, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    rows = merkle.manifest(sample_table(spark, d, "documents"), MANIFEST_COLUMNS, tampered={"text": lowered})
    rows = rows.select(
        "doc_id", "leaf", "subroot", "root",
        merkle.proof(F.col("path")).alias("proof_sha256"),
        merkle.fold(F.col("path"), F.col("tampered_leaf")).alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


@query()
def op12_token_counts(spark: SparkSession, d: str) -> DataFrame:
    counted = token_counts.count(sample_table(spark, d, "documents"), public_tokenizers.path(COUNT_JSON))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def _codes_sql() -> str:
    k, parts = vector_codes.ENTRIES, vector_codes.PARTS
    nearest = (
        "SELECT vec_id, row, label, p.part, any_value(p.x) AS x, min((list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, c.x)"
        " + list_inner_product(c.x, c.x))::BIGINT * {k} + entry) AS best FROM p JOIN c{r} c ON p.part = c.part GROUP BY vec_id, row, label, p.part"
    )
    steps = [
        f"v AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) AS row,"
        f" list_transform(embedding, lambda x: floor({vector_codes.SCALE} * x::DOUBLE)) AS e"
        " FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT vec_id, label, row, part, e[part * (len(e) // {parts}) + 1 : (part + 1) * (len(e) // {parts})] AS x FROM v, range({parts}) t(part))",
        f"c0 AS MATERIALIZED (SELECT part, row - 1 AS entry, x FROM p WHERE row <= {k})",
    ]
    for r in range(vector_codes.ROUNDS + 1):
        steps.append(f"a{r} AS MATERIALIZED ({nearest.format(k=k, r=r)})")
        steps.append(
            f"m{r} AS (SELECT part, entry, list(floor(total / n) ORDER BY i) AS x FROM (SELECT part, best % {k} AS entry, i, sum(value) AS total,"
            f" count(*) AS n FROM (SELECT part, best, unnest(x) AS value, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY ALL) GROUP BY ALL)"
        )
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (part, entry))")
    last = vector_codes.ROUNDS
    return (
        f"WITH {', '.join(steps)}, o AS (SELECT vec_id, row, label, string_agg(printf('%02x', best % {k}), '' ORDER BY part) AS code,"
        f" sum(best // {k})::BIGINT AS error FROM a{last} GROUP BY ALL)"
        " SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,"
        f" (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda y: y::BIGINT), ','), ',' ORDER BY part, entry)) FROM c{last}) AS codebooks_sha256 FROM o"
    )


@query(_codes_sql())
def op13_vector_codes(spark: SparkSession, d: str) -> DataFrame:
    return vector_codes.compress(sample_table(spark, d, "embeddings"))

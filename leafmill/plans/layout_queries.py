"""Queries over text boxes on pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import layout
from leafmill.plans import fixtures as fx
from leafmill.plans.page_assembly import assemble_pages
from leafmill.plans.registry import query
from leafmill.sources.tables import sample_table

_BOX = ["page_id", "ix", "x1", "y1", "x2", "y2", "confidence"]


@query(
    """WITH tensors AS (SELECT vec_id, embedding::DOUBLE[] AS data,
           CASE WHEN label IN (8, 9) THEN 0 WHEN label % 2 = 0 THEN 16 ELSE 12 END AS n,
           CASE WHEN label % 2 = 0 THEN 4 ELSE 5 END AS stride FROM embeddings),
       boxes AS (SELECT vec_id, data, stride, unnest(range(n))::INTEGER AS ix FROM tensors),
       found AS (SELECT vec_id, ix, data[ix * stride + 1] AS x1, data[ix * stride + 2] AS y1,
              data[ix * stride + 3] AS x2, data[ix * stride + 4] AS y2,
              CASE WHEN stride = 5 THEN data[ix * 5 + 5] ELSE 1.0::DOUBLE END AS confidence FROM boxes)
       SELECT vec_id, ix, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2,
              round(confidence, 6) AS confidence FROM found WHERE confidence > 0.05"""
)
def detector_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Vectors read as detector output; labels 8 and 9 have shapes that hold no boxes."""
    label = F.col("label")
    shape = (
        F.when(label == 9, F.array(F.lit(2), F.lit(8), F.lit(4)))
        .when(label == 8, F.array(F.lit(16), F.lit(4)))
        .when(label % 2 == 0, F.array(F.lit(1), F.lit(16), F.lit(4)))
        .otherwise(F.array(F.lit(1), F.lit(12), F.lit(5)))
    )
    tensors = sample_table(spark, d, "embeddings").select(
        "vec_id", shape.alias("shape"), F.col("embedding").alias("data")
    )
    found = layout.detector_boxes(tensors, ["vec_id"], 0.05)
    return found.select(
        "vec_id", "ix", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2", "confidence")]
    )


@query(
    """WITH boxes AS (SELECT page_id, ix, CASE WHEN is_vertical THEN x2 ELSE x1 END AS x1, y1,
           CASE WHEN is_vertical THEN x1 ELSE x2 END AS x2, y2,
           (600 + page_id % 7 * 100)::INTEGER AS w, (500 + page_id % 5 * 300)::INTEGER AS h FROM fx_regions),
       placed AS (SELECT page_id, ix,
           trunc(greatest(x1::FLOAT * (w::FLOAT / 1024::FLOAT), 0::FLOAT))::INTEGER AS px_x1,
           trunc(greatest(y1::FLOAT * (h::FLOAT / 1024::FLOAT), 0::FLOAT))::INTEGER AS px_y1,
           trunc(least(x2::FLOAT * (w::FLOAT / 1024::FLOAT), w::FLOAT - 1::FLOAT))::INTEGER AS px_x2,
           trunc(least(y2::FLOAT * (h::FLOAT / 1024::FLOAT), h::FLOAT - 1::FLOAT))::INTEGER AS px_y2 FROM boxes)
       SELECT *, greatest(px_x2 - px_x1 + 1, 1) AS crop_width, greatest(px_y2 - px_y1 + 1, 1) AS crop_height,
           px_x2 - px_x1 + 1 > 0 AND px_y2 - px_y1 + 1 > 0 AS valid,
           greatest(trunc(32::FLOAT * (greatest(px_x2 - px_x1 + 1, 1)::FLOAT
               / greatest(px_y2 - px_y1 + 1, 1)::FLOAT))::INTEGER, 1) AS line_width FROM placed""",
    "fx_regions",
)
def box_rescale(spark: SparkSession, d: str) -> DataFrame:
    """Boxes to image pixels; vertical ones are given back to front and marked invalid."""
    upright = F.col("is_vertical")
    boxes = fx.regions(spark, d).select(
        "page_id", "ix",
        F.when(upright, F.col("x2")).otherwise(F.col("x1")).alias("x1"), "y1",
        F.when(upright, F.col("x1")).otherwise(F.col("x2")).alias("x2"), "y2",
        (F.lit(600) + F.col("page_id") % 7 * 100).cast("int").alias("image_width"),
        (F.lit(500) + F.col("page_id") % 5 * 300).cast("int").alias("image_height"),
    )
    return layout.rescale_boxes(boxes).select(
        "page_id", "ix", "px_x1", "px_y1", "px_x2", "px_y2", "crop_width", "crop_height", "valid",
        "line_width",
    )


@query(f"SELECT {', '.join(_BOX)} FROM fx_regions WHERE confidence > 0.95", "fx_regions")
def confident_regions(spark: SparkSession, d: str) -> DataFrame:
    return layout.confident(fx.regions(spark, d), 0.95).select(*_BOX)


@query(
    """SELECT page_id, round(coalesce(avg(CASE WHEN text <> 'red widget' THEN confidence END), 0), 6) AS confidence
       FROM fx_regions GROUP BY page_id""",
    "fx_regions",
)
def page_confidence(spark: SparkSession, d: str) -> DataFrame:
    """One product name counts as empty text here, so that some lines do not score."""
    text = F.when(F.col("text") == "red widget", F.lit("")).otherwise(F.col("text"))
    lines = fx.regions(spark, d).select("page_id", text.alias("text"), "confidence")
    scored = layout.page_confidence(lines, ["page_id"])
    return scored.withColumn("confidence", F.round("confidence", 6))


_VOTES = """votes AS (SELECT page_id, count_if(is_vertical)::BIGINT AS vertical, count_if(NOT is_vertical)::BIGINT AS horizontal,
    CASE WHEN count_if(is_vertical) > count_if(NOT is_vertical) THEN 'Vertical'
         WHEN count_if(is_vertical) < count_if(NOT is_vertical) THEN 'Horizontal' ELSE 'Mixed' END AS reading_order
    FROM {0} GROUP BY page_id)"""
_RANKED = """ranked AS (SELECT r.*, v.reading_order, row_number() OVER (PARTITION BY r.page_id ORDER BY
    CASE WHEN v.reading_order = 'Vertical' THEN -x1 ELSE y1 END,
    CASE WHEN v.reading_order = 'Vertical' THEN y1 ELSE x1 END, ix) AS rank
    FROM {0} r JOIN votes v ON v.page_id = r.page_id)"""
_MARKDOWN = """lagged AS (SELECT *, lag(y1) OVER w AS prev_y, lag(direction) OVER w AS prev_direction,
        coalesce(sum(length(text)) OVER (PARTITION BY page_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS written
        FROM ranked WINDOW w AS (PARTITION BY page_id ORDER BY rank)),
    markdowns AS (SELECT page_id, string_agg(CASE WHEN written = 0 THEN ''
        WHEN prev_y IS NULL OR abs(y1 - prev_y) > 50 THEN chr(10) || chr(10)
        WHEN coalesce(prev_direction, 0) <> direction THEN chr(10) ELSE '' END || text, '' ORDER BY rank) AS markdown
        FROM lagged GROUP BY page_id)"""


@query(f"WITH {_VOTES.format('fx_regions')} SELECT * FROM votes", "fx_regions")
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    return layout.reading_votes(fx.regions(spark, d))


@query(
    f"""WITH {_VOTES.format('fx_regions')}, {_RANKED.format('fx_regions')}
        SELECT page_id, ix, reading_order, rank FROM ranked""",
    "fx_regions",
)
def region_rank(spark: SparkSession, d: str) -> DataFrame:
    ranked = layout.in_reading_order(fx.regions(spark, d)).df
    return ranked.select("page_id", "ix", "reading_order", "rank")


@query(
    """WITH flagged AS (SELECT *, CASE WHEN abs(y1 - lag(y1) OVER (PARTITION BY page_id ORDER BY ix)) > 30
           THEN 1 ELSE 0 END AS starts FROM fx_regions),
       numbered AS (SELECT *, sum(starts) OVER (PARTITION BY page_id ORDER BY ix) AS paragraph FROM flagged)
       SELECT page_id, paragraph::BIGINT AS paragraph, 0 AS part, count(*)::INTEGER AS rows, string_agg(text, ' ' ORDER BY ix) AS text
       FROM numbered GROUP BY page_id, paragraph""",
    "fx_regions",
)
def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return layout.paragraph_texts(fx.regions(spark, d), 30.0)


@query(
    f"""WITH {_VOTES.format('fx_regions')}, {_RANKED.format('fx_regions')}, {_MARKDOWN}
        SELECT page_id, 0 AS part, markdown FROM markdowns""",
    "fx_regions",
)
def page_markdown(spark: SparkSession, d: str) -> DataFrame:
    return layout.page_markdown(fx.regions(spark, d)).select("page_id", "part", "markdown")


@query(
    """SELECT page_id, 0 AS part, string_agg(text, chr(10) ORDER BY ix) AS markdown, string_agg(text, ' ' ORDER BY ix) AS plain_text
       FROM fx_regions GROUP BY page_id""",
    "fx_regions",
)
def line_texts(spark: SparkSession, d: str) -> DataFrame:
    return layout.line_texts(fx.regions(spark, d)).select("page_id", "part", "markdown", "plain_text")


@query(
    """SELECT book_id, part, string_agg(ocr_markdown || chr(10) || chr(10) || '--- Page ' || page_number::VARCHAR
              || ' ---' || chr(10) || chr(10), '' ORDER BY page_number) AS document
       FROM (SELECT *, ((page_number - 1) // 16)::INTEGER AS part FROM fx_pages) GROUP BY book_id, part""",
    "fx_pages",
)
def book_document(spark: SparkSession, d: str) -> DataFrame:
    pages = fx.pages(spark, d)
    return layout.book_document(pages, "ocr_markdown", 16).select("book_id", "part", "document")


_IOU = """(least({0}.x2, {1}.x2) - greatest({0}.x1, {1}.x1)) * (least({0}.y2, {1}.y2) - greatest({0}.y1, {1}.y1))
    / (({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1) + ({1}.x2 - {1}.x1) * ({1}.y2 - {1}.y1)
       - (least({0}.x2, {1}.x2) - greatest({0}.x1, {1}.x1)) * (least({0}.y2, {1}.y2) - greatest({0}.y1, {1}.y1)))"""
_MEETS = "{0}.x1 < {1}.x2 AND {1}.x1 < {0}.x2 AND {0}.y1 < {1}.y2 AND {1}.y1 < {0}.y2"


@query(
    f"""WITH boxes AS (SELECT page_id, x1, y1, x2, y2, min(ix) AS ix, count(*) AS copies FROM fx_regions GROUP BY ALL)
        SELECT a.page_id, a.ix AS ix_a, b.ix AS ix_b, a.copies AS copies_a, b.copies AS copies_b,
               round({_IOU.format('a', 'b')}, 6) AS iou
        FROM boxes a JOIN boxes b ON a.page_id = b.page_id AND a.ix < b.ix AND {_MEETS.format('a', 'b')}
        UNION ALL SELECT page_id, ix, ix, copies, copies, 1.0::DOUBLE FROM boxes WHERE copies > 1""",
    "fx_regions",
)
def region_iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = layout.overlaps(fx.regions(spark, d))
    return pairs.withColumn("iou", F.round("iou", 6))


def _kept(source: str) -> str:
    """Greedy suppression one rank at a time over all pages."""
    return f"""best AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY confidence DESC, ix) AS n FROM {source}),
        fold AS (SELECT page_id, 1::BIGINT AS n, [{{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'ix': ix}}] AS kept FROM best WHERE n = 1
            UNION ALL SELECT f.page_id, f.n + 1, CASE WHEN len(list_filter(f.kept, lambda k: {_MEETS.format('k', 'b')}
                AND {_IOU.format('k', 'b')} > 0.5)) > 0 THEN f.kept
                ELSE list_append(f.kept, {{'x1': b.x1, 'y1': b.y1, 'x2': b.x2, 'y2': b.y2, 'ix': b.ix}}) END
            FROM fold f JOIN best b ON b.page_id = f.page_id AND b.n = f.n + 1),
        survivors AS (SELECT page_id, unnest(kept).ix AS ix FROM (
            SELECT page_id, kept, row_number() OVER (PARTITION BY page_id ORDER BY n DESC) AS last FROM fold) WHERE last = 1)"""


@query(f"WITH RECURSIVE {_kept('fx_regions')} SELECT page_id, ix FROM survivors", "fx_regions")
def nms(spark: SparkSession, d: str) -> DataFrame:
    return layout.suppress(fx.regions(spark, d), 0.5).select("page_id", "ix")


@query(
    f"""WITH RECURSIVE sure AS (SELECT * FROM fx_regions WHERE confidence > 0.92), {_kept('sure')},
        left_over AS (SELECT s.* FROM sure s JOIN survivors k ON k.page_id = s.page_id AND k.ix = s.ix),
        {_VOTES.format('left_over')}, {_RANKED.format('left_over')}, {_MARKDOWN}
        SELECT m.page_id, 0 AS part, m.markdown, round(c.confidence, 6) AS confidence FROM markdowns m
        JOIN (SELECT page_id, avg(confidence) AS confidence FROM left_over GROUP BY page_id) c ON c.page_id = m.page_id""",
    "fx_regions",
)
def assembled_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = assemble_pages(fx.regions(spark, d), 0.92, 0.5)
    return pages.select("page_id", "part", "markdown", F.round("confidence", 6).alias("confidence"))


@query(
    """WITH best AS (SELECT line_id, t, probs::DOUBLE[] AS p FROM fx_logits),
       steps AS (SELECT line_id, t, list_position(p, list_max(p)) - 1 AS id, list_max(p) AS score FROM best),
       usable AS (SELECT *, lag(id) OVER (PARTITION BY line_id ORDER BY t) AS last FROM steps WHERE id > 0 AND score > 0),
       emitted AS (SELECT * FROM usable WHERE last IS NULL OR last <> id)
       SELECT s.line_id, 0 AS part, coalesce(string_agg(substring('{dictionary}', e.id::INTEGER + 1, 1), '' ORDER BY e.t), '') AS text,
              round(coalesce(sum(e.score), 0) / max(s.steps), 6) AS confidence
       FROM (SELECT line_id, count(*) AS steps FROM steps GROUP BY line_id) s
       LEFT JOIN emitted e ON e.line_id = s.line_id GROUP BY s.line_id""".replace(
        "{dictionary}", fx.LINE_DICTIONARY
    ),
    "fx_logits",
)
def ctc_decode(spark: SparkSession, d: str) -> DataFrame:
    from leafmill.operators.tokens import ctc_decode as decode

    lines = decode(fx.decoding_steps(spark, d), fx.line_dictionary(spark))
    return lines.select("line_id", "part", "text", F.round("confidence", 6).alias("confidence"))

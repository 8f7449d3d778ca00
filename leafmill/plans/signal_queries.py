"""Queries over signals, scores and tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import arrays, audio
from leafmill.operators import signal, tokens
from leafmill.plans import fixtures as fx
from leafmill.plans.registry import query
from leafmill.sources.tables import sample_table

_W, _H, _N, _M, _R = (fx.SIGNAL[k] for k in ("window", "hop", "n_fft", "n_mels", "rate"))
_HALF = _N // 2

_FRAMES = f"""lens AS (SELECT signal_id, count(*) AS n FROM fx_signal GROUP BY signal_id HAVING count(*) >= {_W}),
    frames AS (SELECT signal_id, unnest(range((n - {_W}) // {_H} + 1)) AS frame FROM lens),
    windowed AS (SELECT f.signal_id, f.frame, s.sample_ix - f.frame * {_H} AS t,
        s.sample * 0.5::DOUBLE * (1 - cos(2 * pi() * (s.sample_ix - f.frame * {_H}) / {_W})) AS v
        FROM frames f JOIN fx_signal s ON s.signal_id = f.signal_id
        AND s.sample_ix >= f.frame * {_H} AND s.sample_ix < f.frame * {_H} + {_W})"""
_SPECTRUM = f"""bins AS (SELECT unnest(range({_HALF + 1})) AS bin),
    spectrum AS (SELECT signal_id, frame, bin,
        sqrt(pow(sum(v * cos(2 * pi() * bin * t / {_N})), 2) + pow(sum(v * sin(2 * pi() * bin * t / {_N})), 2)) AS magnitude
        FROM windowed CROSS JOIN bins GROUP BY signal_id, frame, bin)"""
_BANK = f"""points AS (SELECT i, round(700 * (pow(10, 2595 * log10(1 + {_R / 2}::DOUBLE / 700) * i / {_M + 1} / 2595) - 1)
        / {_R / 2}::DOUBLE * {_HALF})::INTEGER AS b FROM (SELECT unnest(range({_M + 2})) AS i)),
    mels AS (SELECT a.i AS mel, a.b AS s, c.b AS m, e.b AS e FROM points a JOIN points c ON c.i = a.i + 1 JOIN points e ON e.i = a.i + 2),
    bank AS (SELECT bin, mel, CASE WHEN bin < m THEN (bin - s) / (m - s + 1e-10) ELSE (e - bin) / (e - m + 1e-10) END AS weight
        FROM mels JOIN bins ON bin >= s AND bin < e),
    logmel AS (SELECT signal_id, frame, mel, ln(sum(magnitude * magnitude * weight) + 1e-10) AS value
        FROM spectrum JOIN bank USING (bin) GROUP BY signal_id, frame, mel)"""


@query(f"WITH {_FRAMES} SELECT signal_id, frame, frame * {_H} AS start FROM frames", "fx_signal")
def frames(spark: SparkSession, d: str) -> DataFrame:
    events = sample_table(spark, d, "events").select(F.col("user_id").alias("signal_id"))
    sizes = events.groupBy("signal_id").agg(F.count(F.lit(1)).alias("samples"))
    return signal.frame_starts(sizes, _W, _H)


@query(
    f"""SELECT signal_id, sample_ix, round(sample * 0.5::DOUBLE * (1 - cos(2 * pi() * (sample_ix % {_W}) / {_W})), 6) AS weighted
        FROM fx_signal""",
    "fx_signal",
)
def hann_weighted(spark: SparkSession, d: str) -> DataFrame:
    place = F.col("sample_ix") % _W
    return fx.samples(spark, d).select(
        "signal_id", "sample_ix", F.round(F.col("sample") * audio.hann(place, _W), 6).alias("weighted")
    )


@query(
    """SELECT event_id, round(2595 * log10(1 + value * 16 / 700), 6) AS mel, round(value * 16, 6) AS hz,
              round(ln(value * value + 1e-10), 6) AS log_power FROM events"""
)
def mel_scale(spark: SparkSession, d: str) -> DataFrame:
    hz = F.col("value") * 16
    mel = audio.hz_to_mel(hz)
    return sample_table(spark, d, "events").select(
        "event_id", F.round(mel, 6).alias("mel"), F.round(audio.mel_to_hz(mel), 6).alias("hz"),
        F.round(audio.log_power(F.col("value") * F.col("value")), 6).alias("log_power"),
    )


@query(f"WITH {_FRAMES}, {_SPECTRUM} SELECT signal_id, frame, bin::INTEGER AS bin, round(magnitude, 5) AS magnitude FROM spectrum", "fx_signal")
def spectrum(spark: SparkSession, d: str) -> DataFrame:
    found = signal.spectrum(fx.samples(spark, d), _W, _H, _N)
    return found.withColumn("magnitude", F.round("magnitude", 5))


@query(f"WITH {_FRAMES}, {_SPECTRUM}, {_BANK} SELECT signal_id, frame, mel::INTEGER AS mel, round(value, 5) AS value FROM logmel", "fx_signal")
def log_mel(spark: SparkSession, d: str) -> DataFrame:
    features = signal.log_mel(fx.samples(spark, d), **fx.SIGNAL)
    return features.withColumn("value", F.round("value", 5))


@query(
    f"""WITH {_FRAMES}, {_SPECTRUM}, {_BANK}, stats AS (SELECT signal_id, mel, avg(value) AS m, stddev_pop(value) AS s
        FROM logmel GROUP BY signal_id, mel)
        SELECT signal_id, frame, mel::INTEGER AS mel, round(CASE WHEN s > 0 THEN (value - m) / s ELSE 0 END, 4) AS normalised
        FROM logmel JOIN stats USING (signal_id, mel)""",
    "fx_signal",
)
def log_mel_normalized(spark: SparkSession, d: str) -> DataFrame:
    features = signal.log_mel(fx.samples(spark, d), **fx.SIGNAL)
    scaled = signal.normalised(features, ["signal_id", "mel"])
    return scaled.select("signal_id", "frame", "mel", F.round("normalised", 4).alias("normalised"))


@query(
    """SELECT event_id, user_id, round(CASE WHEN hi = lo THEN value ELSE (value - lo) / (hi - lo) END, 6) AS scaled
       FROM events JOIN (SELECT user_id, min(value) AS lo, max(value) AS hi FROM events GROUP BY user_id) USING (user_id)"""
)
def minmax_signal(spark: SparkSession, d: str) -> DataFrame:
    rows = sample_table(spark, d, "events").select("event_id", "user_id", "value")
    scaled = signal.min_max_table(rows, ["user_id"], "value")
    return scaled.select("event_id", "user_id", F.round("scaled", 6).alias("scaled"))


@query(
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
       SELECT vec_id, unnest(range(len(e)))::INTEGER AS pos,
              unnest(list_transform(e, lambda x: round((x - list_min(e)) / (list_max(e) - list_min(e)), 6))) AS scaled FROM v"""
)
def minmax_embedding(spark: SparkSession, d: str) -> DataFrame:
    values = F.col("embedding").cast("array<double>")
    scaled = sample_table(spark, d, "embeddings").select(
        "vec_id", F.posexplode(arrays.min_max(values)).alias("pos", "scaled")
    )
    return scaled.withColumn("scaled", F.round("scaled", 6))


@query(
    """SELECT event_id, round((value / 255.0::DOUBLE - CASE event_id % 3 WHEN 0 THEN 0.485::DOUBLE WHEN 1 THEN 0.456::DOUBLE ELSE 0.406::DOUBLE END)
              / CASE event_id % 3 WHEN 0 THEN 0.229::DOUBLE WHEN 1 THEN 0.224::DOUBLE ELSE 0.225::DOUBLE END, 6) AS standardised FROM events"""
)
def standardised_channels(spark: SparkSession, d: str) -> DataFrame:
    channel = (F.col("event_id") % 3).cast("int")
    return sample_table(spark, d, "events").select(
        "event_id", F.round(arrays.standardise_channel(F.col("value"), channel), 6).alias("standardised")
    )


_COARSE = "coarse AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: trunc(x * 20)) AS s FROM embeddings)"


def _coarse(spark: SparkSession, d: str) -> DataFrame:
    """Scores cut to few values, so that ties are common."""
    scores = F.transform("embedding", lambda v: (v.cast("double") * 20).cast("int").cast("double"))
    return sample_table(spark, d, "embeddings").select("vec_id", scores.alias("s"))


@query(
    f"""WITH {_COARSE} SELECT vec_id, (len(s) - list_position(list_reverse(s), list_max(s)))::INTEGER AS last_best,
        (list_position(s, list_max(s)) - 1)::INTEGER AS first_best, list_max(s) AS score FROM coarse"""
)
def argmax_token(spark: SparkSession, d: str) -> DataFrame:
    scores = F.col("s")
    return _coarse(spark, d).select(
        "vec_id", arrays.last_argmax(scores).alias("last_best"),
        arrays.first_argmax(scores).alias("first_best"), F.array_max(scores).alias("score"),
    )


_LONG = """long AS (SELECT vec_id, unnest(s) AS score, unnest(range(len(s)))::INTEGER AS token FROM coarse),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, token) - 1 AS place FROM long)"""


@query(f"WITH {_COARSE}, {_LONG} SELECT vec_id, place::INTEGER AS place, token, score FROM ordered WHERE place < 5")
def topk_tokens(spark: SparkSession, d: str) -> DataFrame:
    best = _coarse(spark, d).select(
        "vec_id", F.posexplode(arrays.top_k(F.col("s"), 5)).alias("place", "b")
    )
    return best.select("vec_id", "place", "b.token", (-F.col("b.neg")).alias("score"))


@query(
    f"""WITH {_COARSE}, {_LONG}, p AS (SELECT *, exp(score) / sum(exp(score)) OVER (PARTITION BY vec_id) AS probability FROM ordered),
        c AS (SELECT *, coalesce(sum(probability) OVER (PARTITION BY vec_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS mass FROM p)
        SELECT vec_id, place::INTEGER AS place, token, round(probability, 6) AS probability FROM c WHERE mass < 0.9"""
)
def topp_tokens(spark: SparkSession, d: str) -> DataFrame:
    best = _coarse(spark, d).select(
        "vec_id", F.posexplode(arrays.top_p(F.col("s"), 0.9)).alias("place", "b")
    )
    return best.select("vec_id", "place", "b.token", F.round("b.probability", 6).alias("probability"))


@query(
    """WITH t AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: trunc(abs(x) * 100)::INTEGER % 50) AS ts FROM embeddings),
       cut AS (SELECT vec_id, ts[1:least(40, CASE WHEN list_position(ts, 2) IS NULL OR list_position(ts, 2) = 0 THEN len(ts) ELSE list_position(ts, 2) END)] AS kept FROM t)
       SELECT vec_id, len(kept)::INTEGER AS length, list_aggregate(kept, 'string_agg', ',') AS tokens FROM cut"""
)
def token_truncation(spark: SparkSession, d: str) -> DataFrame:
    made = F.transform("embedding", lambda v: ((F.abs(v.cast("double")) * 100).cast("int") % 50))
    rows = sample_table(spark, d, "embeddings").select("vec_id", made.alias("t"))
    kept = rows.select("vec_id", arrays.until_end(F.col("t"), tokens.END_TOKEN, 40).alias("k"))
    return kept.select(
        "vec_id", F.size("k").alias("length"),
        F.array_join(F.col("k").cast("array<string>"), ",").alias("tokens"),
    )


@query(
    f"""WITH chars AS (SELECT doc_id, unnest(string_split(text, '')) AS token, unnest(range(length(text))) AS pos FROM documents),
        known AS (SELECT doc_id, pos, instr('{fx.LINE_DICTIONARY}', token) - 1 AS id FROM chars WHERE instr('{fx.LINE_DICTIONARY}', token) > 0)
        SELECT doc_id, count(*) AS tokens, sum(id)::BIGINT AS id_sum, sum(id * (pos % 97))::BIGINT AS placed_sum FROM known GROUP BY doc_id"""
)
def char_encode(spark: SparkSession, d: str) -> DataFrame:
    encoded = tokens.encode(
        fx.documents(spark, d), "doc_id", "text", fx.line_dictionary(spark)
    )
    return encoded.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("tokens"), F.sum("id").alias("id_sum"),
        F.sum(F.col("id") * (F.col("pos") % 97)).alias("placed_sum"),
    )


@query("SELECT page_id, 0 AS part, regexp_replace(url, '[^A-Za-z0-9_+]', '', 'g') AS text FROM pages")
def char_round_trip(spark: SparkSession, d: str) -> DataFrame:
    known = fx.line_dictionary(spark)
    encoded = tokens.encode(sample_table(spark, d, "pages"), "page_id", "url", known)
    return tokens.decode(encoded, "page_id", known).select("page_id", "part", "text")


@query("SELECT count(DISTINCT c) AS size FROM (SELECT unnest(string_split(text, '')) AS c FROM documents)")
def vocabulary_size(spark: SparkSession, d: str) -> DataFrame:
    """Size of the character vocabulary that the documents themselves make up."""
    characters = fx.documents(spark, d).select(
        F.explode(F.split("text", "")).alias("token")
    )
    return tokens.vocabulary_size(characters.distinct())

"""Personal data by candidate generation and boosted trees, in DataFrame operations only.

Strict patterns with validators give the base spans, which always stay. Wide patterns propose many more, overlapping
candidates. Boosted trees score every candidate from its format and its context; they are trained on candidates
whose truth is known from the base spans: those that meet one of their kind are true, wide ones that meet none are
false, and so is what a validator refused. Variants that no strict pattern covers have no known truth and are left
out of training. The trees are fitted on a sample. On all other candidates of known truth, each kind gets the lowest
score at which the precision still is ``PRECISION``; candidates at or above it that touch no base span are added.

Places are code points: the pieces between matches and the matches themselves are measured and summed up.
"""

from __future__ import annotations

import warnings

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.words import narrow
from leafmill.session import keep

KINDS = ("email", "ip", "card", "phone")

# (kind, role, what every match holds, pattern). Texts without a match of the cheap third are not searched for the
# fourth. Possessive marks change no match here, they only keep long matches off the stack.
GENERATORS = (
    ("email", "base", "@", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"),
    ("ip", "base", r"[0-9]\.[0-9]", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"),
    ("card", "base", r"[0-9](?:[\x20-]?[0-9]){11}", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", "base", r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("email", "wide", "@", r"[^\x20\x09-\x0D@]*+@[^\x20\x09-\x0D@]*+"),
    ("ip", "wide", r"[0-9]\.[0-9]", r"[0-9]+(?:\.[0-9]+)++"),
    ("card", "wide", "[0-9]{8}", "[0-9]{8,}"),
    ("phone", "variant", r"[0-9]\)?[\x20.-][0-9]{3}", r"\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}(?:[\x20.-][0-9]{3,4})?+"),
    (
        "email", "variant", r"[\[(]at[\])]",
        r"[A-Za-z0-9._%+-]+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]+(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]+)++",
    ),
)
# Words that announce a kind, as fixed values.
HINTS = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": "ip|host|server|address|adresse",
    "card": "card|visa|credit|karte|carte|tarjeta",
    "phone": "phone|tel|call|fax|mobil|tél",
}
CONTEXT = 24

TRAIN_ROWS = 20_000  # most labelled candidates that the trees are fitted on
PRECISION = 0.95
LEAST = 20  # candidates at or above a threshold, for it to count
TREES, DEPTH = 10, 3


def _matches(rows: DataFrame) -> DataFrame:
    """Every match of every generator: (id, part, gen, start, end, match, left, right)."""
    holds = lambda sign: F.contains(F.col("text"), F.lit(sign)) if len(sign) == 1 else F.col("text").rlike(sign)
    found = F.array(
        *[
            F.when(
                holds(sign),
                F.struct(
                    F.lit(g).alias("gen"),
                    F.split("text", pattern, -1).alias("between"),
                    F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("matches"),
                ),
            )
            for g, (_, _, sign, pattern) in enumerate(GENERATORS)
        ]
    )
    per_generator = rows.select("id", "part", F.inline(F.array_compact(found))).where(F.size("matches") > 0)
    after = F.slice("between", F.lit(2), F.size("between"))
    placed = per_generator.select(
        "id", "part", "gen", F.posexplode(F.arrays_zip("between", "matches", after.alias("after")))
    ).select(
        "id", "part", "gen", "pos",
        F.length("col.between").alias("gap"),
        F.coalesce(F.length("col.matches"), F.lit(0)).alias("size"),
        F.col("col.matches").alias("match"),
        F.lower(F.right("col.between", F.lit(CONTEXT))).alias("left"),
        F.left("col.after", F.lit(1)).alias("right"),
    )
    # Rows that repeat an id and its text have the same matches; one set of them is kept.
    once = placed.repartition("id", "part").dropDuplicates(["id", "part", "gen", "pos"])
    along = Window.partitionBy("id", "part", "gen").orderBy("pos")
    end = F.sum((F.col("gap") + F.col("size")).cast("long")).over(along)
    return once.withColumn("end", end).withColumn("start", F.col("end") - F.col("size")).where("size > 0")


def _by_generator(values: list[Column]) -> Column:
    return F.element_at(F.array(*values), F.col("gen") + 1)


def _valid() -> Column:
    """Whether a match of a base pattern passes its validator."""
    digits = F.regexp_replace("match", "[^0-9]", "")
    small = lambda part: (F.length(part) <= 3) & (part.cast("int") <= 255)
    ip = F.forall(F.transform(F.split("match", r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "")), small)
    card = F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    phone = F.length(digits).between(9, 15)
    gen = F.col("gen")
    return (gen == 0) | ((gen == 1) & ip) | ((gen == 2) & card) | ((gen == 3) & phone)


def _features(candidates: DataFrame) -> tuple[DataFrame, list[str]]:
    count = lambda chars: F.length("match") - F.length(F.regexp_replace("match", chars, ""))
    last = F.right("left", F.lit(1))
    values = {f"is_{kind}": F.col("kind") == kind for kind in KINDS}
    values |= {f"hint_{kind}": F.col("left").rlike(f"(?:{words})[^0-9]*$") for kind, words in HINTS.items()}
    values |= {
        "length": F.length("match"), "digits": count("[0-9]"), "letters": count("[A-Za-z]"), "dots": count(r"\."),
        "dashes": count("-"), "spaces": count(" "), "brackets": count(r"[()\[\]]"), "ats": count("@"),
        "groups": F.size(F.split("match", "[^0-9A-Za-z]+")),
        "longest": F.array_max(F.transform(F.split("match", "[^0-9]+"), F.length)),
        "after_word": last.rlike(r"\w"), "after_blank": last.rlike(r"\s"),
        "before_word": F.col("right").rlike(r"\w"), "before_mark": F.col("right").rlike(r"[^\w\s]"),
    }
    return candidates.select("*", *[v.cast("double").alias(f"f_{n}") for n, v in values.items()]), [f"f_{n}" for n in values]


def _meets(partition: list[str]) -> Column:
    """Whether a candidate shares a character with a base span of its partition, itself included."""
    order = Window.partitionBy(*partition).orderBy("start")
    before = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    after = order.rangeBetween(Window.currentRow, Window.unboundedFollowing)
    reaches = F.max(F.when(F.col("base"), F.col("end"))).over(before)
    begins = F.min(F.when(F.col("base"), F.col("start"))).over(after)
    return F.coalesce(reaches > F.col("start"), F.lit(False)) | F.coalesce(begins < F.col("end"), F.lit(False))


def candidates(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """Candidates of (id, part, text) with features, ``base``, and ``truth`` (null where unknown)."""
    kind = _by_generator([F.lit(k) for k, *_ in GENERATORS])
    role = _by_generator([F.lit(r) for _, r, *_ in GENERATORS])
    found = _matches(rows).withColumn("kind", kind).withColumn("role", role).withColumn("base", _valid())
    found = found.withColumn("meets_own", _meets(["id", "part", "kind"])).withColumn("meets_any", _meets(["id", "part"]))
    truth = F.when(F.col("meets_own"), 1.0).when((F.col("role") != "variant") | F.col("meets_any"), 0.0)
    found, names = _features(found.withColumn("truth", truth))
    return found.select("id", "part", "kind", "start", "end", "base", "meets_any", "truth", *names), names


def _thresholds(scored: DataFrame) -> DataFrame:
    """Per kind the lowest score, in steps of a hundredth, from which on the precision holds."""
    bins = scored.groupBy("kind", F.floor(F.col("score") * 100).alias("step")).agg(
        F.sum("truth").alias("true"), F.count(F.lit(1)).alias("n")
    )
    upwards = Window.partitionBy("kind").orderBy(F.desc("step"))  # at most 101 rows each
    reached = bins.withColumn("true", F.sum("true").over(upwards)).withColumn("n", F.sum("n").over(upwards))
    good = reached.where((F.col("true") >= PRECISION * F.col("n")) & (F.col("n") >= LEAST))
    return good.groupBy("kind").agg((F.min("step") / 100).alias("threshold"))


def _added(found: DataFrame, names: list[str], train_rows: int) -> DataFrame:
    """Candidates beyond the base spans that the trees accept."""
    place = ["id", "part", "kind", "start", "end"]
    labelled = found.where("truth is not null").withColumn("draw", F.xxhash64(*place))
    # Three tenths are held back, by a hash of its own, however small the input is.
    labelled = labelled.withColumn("held", F.pmod(F.xxhash64(F.lit("held"), *place), F.lit(10)) < 3)
    drawn = labelled.where("not held").select("draw").orderBy("draw").limit(train_rows)
    last = drawn.agg(F.max("draw")).first()[0]
    fit = keep(labelled.where(~F.col("held") & (F.col("draw") <= F.lit(last))))
    rest = labelled.where(F.col("held") | (F.col("draw") > F.lit(last)))
    open_ones = found.where(~F.col("meets_any"))
    if fit.select("truth").distinct().count() < 2:  # nothing to tell apart
        if (n := fit.count()) >= train_rows:
            warnings.warn(f"no spans are added: all {n} candidates to fit on have the same truth", stacklevel=2)
        return open_ones.limit(0)
    vectors = VectorAssembler(inputCols=names, outputCol="features")
    trees = GBTClassifier(labelCol="truth", maxIter=TREES, maxDepth=DEPTH, seed=7, checkpointInterval=-1)
    model = trees.fit(vectors.transform(fit))

    def scored(df: DataFrame) -> DataFrame:
        return model.transform(vectors.transform(df)).withColumn("score", vector_to_array("probability")[1])

    thresholds = keep(_thresholds(scored(rest)))
    return scored(open_ones).join(thresholds, "kind").where(F.col("score") >= F.col("threshold"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return narrow(docs, id_col, text_col).withColumn("part", F.xxhash64("text"))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per span and document: (id, part, kind, start, end, base); ``part`` is a hash of the text.

    Null or empty texts have no spans. Rows that repeat an id and text share their spans. Other columns are dropped.
    """
    found, names = candidates(_keyed(docs, id_col, text_col))
    found = keep(found)
    columns = ["id", "part", "kind", "start", "end", "base"]
    added = _added(found, names, train_rows)
    return found.where("base").select(columns).unionByName(added.select(columns).distinct())


def _listed(spans_of: Column) -> Column:
    """kind:start:end of sorted (start, kind number, end), comma-joined."""
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind_no"] + 1)
    one = lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans_of), one), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: number of base spans per kind, base spans and all spans as text.

    An empty table gives no rows. See :func:`spans` for odd rows.
    """
    kind_no = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    place = F.struct(F.col("start"), kind_no.alias("kind_no"), F.col("end"))
    found = spans(docs, id_col, text_col, train_rows).groupBy("id", "part").agg(
        *[F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS],
        _listed(F.collect_list(F.when(F.col("base"), place))).alias("base_spans"),
        _listed(F.collect_list(place)).alias("spans"),
    )
    rows = _keyed(docs, id_col, text_col).select("id", "part")
    same = rows["id"].eqNullSafe(found["id"]) & (rows["part"] == found["part"])
    return rows.join(found, same, "left").select(
        rows["id"].alias("doc_id"),
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.coalesce("base_spans", F.lit("")).alias("base_spans"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; spans that touch each other become one.

    All columns stay; a null text stays null. Rows that repeat an id are redacted each.
    """
    order = Window.partitionBy("id", "part").orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce((F.col("start") >= reached).cast("int"), F.lit(1))
    islands = (
        spans(docs, id_col, text_col, train_rows)
        .withColumn("opens", opens)
        .withColumn("island", F.sum("opens").over(order))
        .groupBy("id", "part", "island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "kind")).alias("kind"))
        .groupBy("id", "part")
        .agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("cuts"))
        .select(F.col("id").alias("__id"), F.col("part").alias("__part"), "cuts")
    )
    text = F.col(f"`{text_col}`")
    own = F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("__part"))
    befores = F.array_insert(F.transform("cuts", lambda c: c["end"]), 1, F.lit(0).cast("long"))
    kept = F.zip_with(
        befores, "cuts",
        lambda a, c: F.when(c.isNull(), F.substring(text, a.cast("int") + 1, F.lit(2**31 - 1))).otherwise(
            F.concat(F.substring(text, a.cast("int") + 1, (c["start"] - a).cast("int")), F.lit("["), F.upper(c["kind"]), F.lit("]"))
        ),
    )
    new = F.when(F.col("cuts").isNull(), text).otherwise(F.array_join(kept, ""))
    return docs.join(islands, own, "left").withColumn(text_col, new).select([f"`{c}`" for c in docs.columns])

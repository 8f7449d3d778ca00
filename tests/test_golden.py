"""Small cases with known results."""

import hashlib
import json
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions import arrays, audio, geometry, text
from leafmill.functions.documents import from_document, last_states, to_document
from leafmill.operators import (
    audits, catalog, convert, export, layout, merge, repeats, search, signal, slots, suffixes, tokens,
    vocabulary, writes,
)
from leafmill.operators.ordering import arrange
from leafmill.schemas import TABLES
from leafmill.sources import files
from leafmill.sources.tables import memory_catalog, open_catalog

# Fixed value: a 574-character text with 260 branching repeats, the empty one included.
LOREM = (
    "Lorem Ipsum is simply dummy text of the printing and typesetting industry. Lorem Ipsum has "
    "been the industry's standard dummy text ever since the 1500s, when an unknown printer took a "
    "galley of type and scrambled it to make a type specimen book. It has survived not only five "
    "centuries, but also the leap into electronic typesetting, remaining essentially unchanged. "
    "It was popularised in the 1960s with the release of Letraset sheets containing Lorem Ipsum "
    "passages, and more recently with desktop publishing software like Aldus PageMaker including "
    "versions of Lorem Ipsum."
)


def one(spark, column, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return frame.select(column.alias("r")).first()["r"]


def test_words(spark):
    def words(t):
        return one(spark, text.words(F.col("t")), t=t)

    assert words("Hello world this is a test") == ["hello", "world", "this", "test"]
    assert words("  test. re-read Ünï ab été　naïve ") == ["ünï", "été", "naïve"]
    assert words("こんにちは世界") == []
    assert words("日本 語 a") == ["日本", "語"]  # two characters are six bytes
    assert words("") == []


def test_sentences(spark):
    t = "This is a test. Another sentence here."
    pick = text.first_sentence(text.sentences(F.col("t")), F.col("w"))
    assert one(spark, pick, t=t, w="test") == "This is a test"
    assert one(spark, pick, t=t, w="here") == "Another sentence here"
    assert one(spark, pick, t=t, w="Test") is None
    assert one(spark, pick, t="甲。　乙に丙！丁", w="丙") == "乙に丙"
    assert one(spark, pick, t="e.g. this", w="e.g") is None
    assert one(spark, pick, t="testing! A test", w="test") == "testing"


def test_sentences_by_a_plain_search(spark):
    texts = [
        "This is a test. Another test here", "testing! A test", "甲。　乙に丙！丁", " \x85\tone two\u3000!two", "..a test..", "test", "",
        "Test. TEST", "a\ntest\n。b", "über Ärger. ärger!",
    ]
    asked = ["test", "one", "two", "丙", "丁", "here", "über", "ärger", "missing"]
    pairs = spark.createDataFrame([(i, t, w) for i, t in enumerate(texts) for w in asked], "i int, t string, w string")
    slow = pairs.select("i", "w", text.first_sentence(text.sentences(F.col("t")), F.col("w")).alias("s")).collect()
    assert len(slow) == len(texts) * len(asked)
    for r in slow:
        assert text.sentence_at(text.one_sentence_end(texts[r.i]), r.w) == r.s


def test_sentences_of_a_page_without_ends_are_given_on_in_parts(spark):
    letters = "abcdefghijklmnopqrst"
    asked = [a + b + c for a in letters for b in letters for c in letters]
    long_text = " ".join(asked)
    pages = spark.createDataFrame([(1, long_text), (2, "abc. Zed abc"), (3, "ABC !"), (4, None)], "id int, t string")
    targets = spark.createDataFrame([(w,) for w in asked], "word string")
    found = vocabulary.concordance(pages, targets, "t")
    assert "Contains" not in found._jdf.queryExecution().executedPlan().toString()
    got = found.selectExpr("id", "word", "sha2(sentence, 256) s").collect()
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    wanted = {(1, w, digest(long_text)) for w in asked} | {(2, "abc", digest("abc")), (3, "abc", None)}
    assert len(got) == len(wanted) and {tuple(r) for r in got} == wanted
    batch = pa.RecordBatch.from_pydict({"id": [1, 2], "_text": [long_text, None], "_wanted": [asked, ["abc"]]})
    parts = list(vocabulary._look_up(["id"], ["id", "word", "sentence"])(iter([batch])))
    most = vocabulary.GIVEN_CHARACTERS + len(long_text) + 3
    assert len(parts) > 50 and all(p.column("sentence").nbytes <= most + 8 * p.num_rows + 8 for p in parts)
    assert sum(p.num_rows for p in parts) == len(asked) + 1
    assert parts[-1].to_pylist()[-1] == {"id": 2, "word": "abc", "sentence": None}


def test_words_of_a_page_are_taken_out_once(spark):
    pages = spark.createDataFrame([(1, 2, "One two. Two three one"), (1, 1, "two!")], "book_id int, page_number int, t string")
    found = vocabulary.first_occurrences(pages, "t")
    assert "array_position(lambda" in found._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in found.collect()} == {
        ("one", 1, 2, 0, "Two three one"), ("two", 1, 2, 1, "One two"), ("three", 1, 2, 2, "Two three one"),
    }


def test_definitions(spark):
    asked = spark.createDataFrame(
        [(w,) for w in ("test", "Example", "unknown_word_xyz", "stored", "stored")], "word string"
    )
    cache = spark.createDataFrame(
        [(2, "stored", "second"), (1, "stored", "first"), (0, "stored", None)],
        "id long, word string, definition string",
    )
    found = {r.word: r for r in vocabulary.define_words(asked, cache).collect()}
    assert found["stored"].definition == "first" and not found["stored"].ai_generated
    assert found["test"].definition.startswith("A procedure")
    assert found["Example"].definition.startswith("A thing characteristic")
    assert "unknown_word_xyz" in found["unknown_word_xyz"].definition
    assert len(vocabulary.DEFINITIONS) == 5
    assert all(20 < len(d) < 500 for d in vocabulary.DEFINITIONS.values())
    assert vocabulary.definitions_table(spark).count() == 5


def test_titles_and_previews(spark):
    def title(t, p):
        return one(spark, text.title_or_stem(F.col("t"), F.col("p")), t=t, p=p)

    assert title("A", "/x/y.pdf") == "A"
    assert title("", "/x/my.book.pdf") == "my.book"
    assert title("", "") == "Unknown"
    assert one(spark, text.preview(F.col("t")), t="日" * 120) == "日" * 100 + "..."
    assert one(spark, text.preview(F.col("t")), t="ab") == "ab..."
    assert one(spark, text.part_of_speech_label(F.col("t")), t="Verb") == "動詞"


def test_html(spark):
    html = one(spark, text.markdown_html(F.col("t")), t="# A\n# B\n**c**")
    wanted = "# A\n# B\n**c**"
    for old, new in text.HTML_REPLACEMENTS:
        wanted = wanted.replace(old, new)
    assert html == f"<p>{wanted}</p>"


def test_iou(spark):
    box = {n: F.col(n) for n in ("x1", "y1", "x2", "y2")}

    def iou(*other):
        second = {n: F.lit(v) for n, v in zip(box, other)}
        return one(spark, geometry.iou(box, second), x1=0.0, y1=0.0, x2=10.0, y2=10.0)

    assert iou(20.0, 20.0, 30.0, 30.0) == 0
    assert iou(0.0, 0.0, 10.0, 10.0) == 1
    assert iou(5.0, 5.0, 15.0, 15.0) == pytest.approx(25 / 175)
    assert iou(10.0, 0.0, 20.0, 10.0) == 0


def test_argmax_and_candidates(spark):
    frame = spark.createDataFrame([([0.1, 0.5, 0.3, 0.9, 0.2],), ([1.0, 1.0, 0.0],)], "s array<double>")
    picks = frame.select(
        arrays.last_argmax(F.col("s")), arrays.first_argmax(F.col("s")), arrays.top_k(F.col("s"), 2)
    ).collect()
    assert picks[0][0] == 3 and picks[1][0] == 1 and picks[1][1] == 0
    assert [p.token for p in picks[0][2]] == [3, 1]
    mass = frame.select(arrays.top_p(F.col("s"), 0.5)).collect()
    assert [p.token for p in mass[1][0]] == [0, 1]
    assert sum(p.probability for p in mass[1][0]) > 0.5
    flat = spark.createDataFrame([([2.0, 2.0],)], "s array<double>")
    assert flat.select(arrays.min_max(F.col("s"))).first()[0] == [2.0, 2.0]
    tokens_ = spark.createDataFrame([([5, 2, 7],), ([5, 6, 7],), ([],)], "s array<int>")
    cut = [r[0] for r in tokens_.select(arrays.until_end(F.col("s"), 2, 2)).collect()]
    assert cut == [[5, 2], [5, 6], []]


def test_mel_scale_and_window(spark):
    assert one(spark, audio.mel_to_hz(audio.hz_to_mel(F.col("h"))), h=440.0) == pytest.approx(440.0)
    assert one(spark, audio.hann(F.col("n"), 400), n=0) == pytest.approx(0.0)
    bank = audio.mel_filterbank(spark, 16_000, 400, 80)
    assert bank.count() == bank.select("bin", "mel").distinct().count()
    assert bank.agg(F.max("bin")).first()[0] <= 200


def samples(spark, *values):
    rows = [(f"s{i}", j, float(v)) for i, vs in enumerate(values) for j, v in enumerate(vs)]
    return spark.createDataFrame(rows, "signal_id string, sample_ix long, sample double")


def test_log_mel_shape_and_values(spark):
    rng = np.random.default_rng(1)
    noise = rng.normal(size=1_500)
    found = signal.log_mel(samples(spark, [0.0] * 16_000, noise, [1.0] * 100), block=480)
    shape = {r.signal_id: (r.f, r.m) for r in found.groupBy("signal_id").agg(
        F.countDistinct("frame").alias("f"), F.countDistinct("mel").alias("m")).collect()}
    assert shape == {"s0": (98, 80), "s1": (7, 80)}
    bank = np.zeros((201, 80))
    for r in audio.mel_filterbank(spark, 16_000, 400, 80).collect():
        bank[r.bin, r.mel] = r.weight
    hann = 0.5 * (1 - np.cos(2 * np.pi * np.arange(400) / 400))
    for r in found.filter("signal_id = 's1' and mel = 40").collect():
        power = np.abs(np.fft.rfft(noise[r.frame * 160 : r.frame * 160 + 400] * hann)) ** 2
        assert r.value == pytest.approx(math.log(power @ bank[:, 40] + 1e-10))


@pytest.mark.parametrize("window,hop,block", [(8, 3, 4), (8, 3, 9), (4, 6, 12), (8, 8, 8), (9, 2, 2)])
def test_frames_across_blocks(spark, window, hop, block):
    values = np.arange(50.0)
    found = signal.spectrum(samples(spark, values), window, hop, window, block)
    starts = range(0, 50 - window + 1, hop)
    assert {r.frame for r in found.select("frame").distinct().collect()} == set(range(len(starts)))
    hann = 0.5 * (1 - np.cos(2 * np.pi * np.arange(window) / window))
    zero = {r.frame: r.magnitude for r in found.filter("bin = 0").collect()}
    for i, s in enumerate(starts):
        assert zero[i] == pytest.approx((values[s : s + window] * hann).sum())
    frames = signal.frame_starts(spark.createDataFrame([("a", 50), ("b", window - 1)], "signal_id string, samples long"), window, hop)
    assert [r.start for r in frames.orderBy("frame").collect()] == list(starts)


def test_duration_rejects(spark):
    sizes = spark.createDataFrame([(1, 16_000), (2, 100), (3, 480_001)], "signal_id int, samples long")
    found = {r.signal_id: r.reject_reason for r in signal.with_reject_reason(sizes, 400).collect()}
    assert found == {1: None, 2: "too short", 3: "too long"}
    assert signal.signal_lengths(samples(spark, [0.0] * 16_000)).first().seconds == 1.0


def test_character_round_trip(spark):
    known = tokens.vocabulary(spark)
    texts = spark.createDataFrame([(1, "こんにちは"), (2, "xアy<")], "key int, t string")
    encoded = tokens.encode(texts, "key", "t", known)
    assert {r.key: r.text for r in tokens.decode(encoded, "key", known).collect()} == {1: "こんにちは", 2: "ア<"}
    assert tokens.vocabulary_size(known).first().size == len(tokens.CHARACTERS) == 119


def nodes(spark, *texts, keys=("k",)):
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    return repeats.repeated_substrings(frame, list(keys), "t")


def brute_nodes(*texts):
    """Substrings that two different symbols follow; every text ends with a symbol of its own."""
    seen = {}
    for k, t in enumerate(texts):
        for i in range(len(t)):
            for j in range(i, len(t) + 1):
                count, after = seen.get(t[i:j], (0, set()))
                seen[t[i:j]] = (count + 1, after | {t[j] if j < len(t) else k})
    return {g: n for g, (n, after) in seen.items() if len(after) > 1 or not g}


def test_repeats(spark):
    found = {r.gram: r.freq for r in nodes(spark, "abracadabra").collect()}
    assert found == {"abra": 2, "a": 5, "bra": 2, "ra": 2, "": 11}
    assert len(LOREM) == 574
    assert nodes(spark, LOREM).count() == 260
    assert {r.gram: r.freq for r in nodes(spark, "banana$band$$").collect()} == brute_nodes("banana$band$$")
    assert nodes(spark, "").count() == 0
    longest = max((r.gram for r in nodes(spark, "abcdefghijklmnopqrX abcdefghijklmnopqrY").collect()), key=len)
    assert longest == "abcdefghijklmnopqr"


def test_repeats_of_any_length(spark):
    """Repeats that end before, at and after the characters compared in a round."""
    alphabet = [chr(0x4E00 + i) for i in range(400)]
    for size in (suffixes.BLOCK - 1, suffixes.BLOCK, suffixes.BLOCK + 1, 64, 300):
        text = "".join(alphabet[:size]) + "X" + "".join(alphabet[:size]) + "Y" + "".join(alphabet[:size])
        assert {r.gram: r.freq for r in nodes(spark, text).collect()} == brute_nodes(text)
    assert {r.gram: r.freq for r in nodes(spark, "a" * 250).collect()} == brute_nodes("a" * 250)


def test_repeats_over_all_texts(spark):
    """Two ends are two different symbols."""
    texts = ["xab", "yab", "ab" * 90, "ab" * 90, LOREM[:200]]
    found = {r.gram: r.freq for r in nodes(spark, *texts, keys=()).collect()}
    assert found == brute_nodes(*texts)


def test_suffix_order(spark):
    frame = spark.createDataFrame([(0, "abracadabra"), (1, "a" * 20 + "b"), (2, None), (3, "é😀é")], "k int, t string")
    rows = repeats.suffix_order(frame, "k", "t").orderBy("k", "rank").collect()
    assert [r.pos for r in rows if r.k == 0] == [10, 7, 0, 3, 5, 8, 1, 4, 6, 9, 2]
    assert [r.shared for r in rows if r.k == 0] == [0, 1, 4, 1, 1, 0, 3, 0, 0, 0, 2]
    assert [(r.pos, r.shared) for r in rows if r.k == 1] == [(i, 0 if i in (0, 20) else 20 - i) for i in range(21)]
    assert [(r.pos, r.shared) for r in rows if r.k == 3] == [(2, 0), (0, 1), (1, 0)]


def test_terms_keep_no_marks(spark):
    rows = spark.createDataFrame([("c\u0061\u0301fe \u1eb9 \u00e9t\u00e9 \u1ea5",)], "t string")
    assert rows.select(text.search_tokens(F.col("t")).alias("w")).first().w == ["cafe", "e", "ete", "\u1ea5"]


def test_ranked_search_needs_the_whole_query(spark):
    notes = spark.createDataFrame([(3, "reaux x"), (4, "assistant reaux ment"), (5, "ment")], "id long, t string")
    terms = ["reaux", "assistant", "ment"]
    rows = search.postings(notes, "id", ["t"], terms)
    found = search.with_rank(search.bm25(rows, search.lengths(notes, "id", ["t"]), terms, search.match_all(rows, terms)))
    assert [(r.id, r["rank"]) for r in found.collect()] == [(4, 1)]


def test_passages(spark):
    frame = spark.createDataFrame(
        [("One two, three four",), ("zero one two three. one two three",), ("one two",)], "t string"
    )
    found = {r.passage: (r.occurrences, r.documents) for r in repeats.repeated_passages(frame, "t", 3).collect()}
    assert found == {"one two three": (3, 2)}


def test_runs_of_repeated_words(spark):
    """Stretches of any length, at the ends of a text, and of rows that share a key."""
    rows = [(1, "A b, c d e x y"), (1, "a b c d e"), (2, "z z x y q b c d"), (None, "q b"), (3, None), (4, "lone lone lone lone")]
    found = repeats.repeated_runs(spark.createDataFrame(rows, "k int, t string"), "k", "t", 2).collect()
    assert sorted((r.k or 0, r.start, r.words) for r in found) == [(0, 0, 2), (1, 0, 5), (1, 0, 5), (1, 5, 2), (2, 2, 2), (2, 4, 4)]


def now():
    return F.lit(1_700_000_000).cast("long")


def test_progress_lifecycle(spark):
    books = spark.createDataFrame([("b", 100)], "id string, total_pages int")
    empty = spark.createDataFrame([], TABLES["processing_progress"])
    table = merge.reset_progress(empty, books, now())
    assert table.first()[:4] == ("b", 0, 100, "pending")
    for page, status in [(50, "processing"), (100, "completed")]:
        change = spark.createDataFrame(
            [("b", page, status), ("none", 1, "failed")],
            "book_id string, last_processed_page int, status string",
        )
        table = merge.update_progress(table, change, now())
    assert [tuple(r)[:4] for r in table.collect()] == [("b", 100, 100, "completed")]
    again = merge.reset_progress(table, books, now())
    assert [tuple(r)[1:4] for r in again.collect()] == [(0, 100, "pending")]


def test_patches_and_replacements(spark):
    target = spark.createDataFrame([(1, "a", "x", 5), (2, "b", "y", 5)], "id int, c string, d string, at int")
    change = spark.createDataFrame([(1, None, "new")], "id int, c string, d string")
    patched = merge.apply_patches(target, change, "id", ["c", "d"], ("at", F.lit(9))).orderBy("id").collect()
    assert [tuple(r) for r in patched] == [(1, "a", "new", 9), (2, "b", "y", 5)]
    replaced = merge.replace_rows(target, change, "id", ["c", "d"]).orderBy("id").collect()
    assert [tuple(r) for r in replaced] == [(1, None, "new", 5), (2, "b", "y", 5)]
    words = spark.createDataFrame([(1, "old", False, 0)], "id int, definition string, ai_generated boolean, updated_at long")
    made = spark.createDataFrame([(1, "new", True)], "id int, definition string, ai_generated boolean")
    assert merge.update_definitions(words, made, now()).first()[1:] == ("new", True, 1_700_000_000)
    books = spark.createDataFrame([("1", "c")], "id string, cover_path string")
    clear = spark.createDataFrame([("1", None)], "id string, cover_path string")
    assert merge.set_covers(books, clear).first().cover_path is None


def test_delete_by_book(spark):
    table = spark.createDataFrame([(1, "1"), (2, "1"), (3, "2")], "id int, book_id string")
    gone = spark.createDataFrame([("1",), ("9",)], "book_id string")
    counts = {r.book_id: r.affected for r in merge.affected_by_book(table, gone).collect()}
    assert counts == {"1": 2, "9": 0}
    assert [r.id for r in merge.delete_keys(table, gone, "book_id").collect()] == [3]
    assert merge.affected(table, gone, "book_id").first().affected == 2


def test_log_folds(spark):
    log = spark.createDataFrame(
        [(1, 1, "a", None), (1, 2, None, "x"), (1, 3, None, None), (2, 1, None, None)],
        "id int, ts int, c string, d string",
    )
    folded = {r.id: (r.c, r.d) for r in merge.fold_patches(log, "id", ["c", "d"], ["ts"]).collect()}
    assert folded == {1: ("a", "x"), 2: (None, None)}
    latest = {r.id: (r.ts, r.c) for r in merge.fold_latest(log, "id", ["ts"]).collect()}
    assert latest == {1: (3, None), 2: (1, None)}


def test_catalog_reads(spark):
    rows = [
        (1, "b", 1, "highlight", "c", None, None, None, None, 0, 0),
        (2, "b", 3, "note", "c", None, 4, 9, "n", 0, 0),
        (3, "b", 2, "bookmark", "c", None, None, None, None, 0, 0),
        (4, "b", 3, "highlight", "c", None, None, None, None, 0, 0),
        (5, "other", 1, "note", "c", None, None, None, None, 0, 0),
    ]
    table = memory_catalog(spark, {"annotations": rows})["annotations"]
    assert [r.id for r in catalog.annotations_of_book(table, "b").collect()] == [1, 3, 4, 2]
    assert catalog.highlights(table, "b").count() == 2
    assert catalog.bookmarks(table, "b").count() == 1
    assert catalog.notes(table, "b").count() == 1
    assert spark.table("annotations").filter("color is null").count() == 5
    types = spark.createDataFrame([("highlight",), ("BookMark",), ("note",), ("invalid",)], "t string")
    parsed = [r[0] for r in types.select(catalog.annotation_type(F.col("t"))).collect()]
    assert parsed == ["highlight", "bookmark", "note", None]


def test_progress_labels(spark):
    books = spark.createDataFrame(
        [("a", True, 0, 10), ("b", True, 29, 100), ("c", True, 10, 10), ("d", False, 0, 10), ("e", True, 0, None)],
        "id string, is_pdf boolean, pages_captured int, total_pages int",
    )
    found = books.select(
        catalog.conversion_action(books), catalog.progress_percent(books.pages_captured, books.total_pages)
    ).collect()
    assert [tuple(r) for r in found] == [
        ("Convert", 0), ("Resume Conversion", int(np.float32(29) / np.float32(100) * np.float32(100))),
        (None, 100), (None, 0), (None, 0),
    ]


def test_insert_checks(spark):
    stored = spark.createDataFrame([("b", 1)], "book_id string, page_number int")
    batch = spark.createDataFrame([("b", 1, 1), ("b", 2, 2), ("b", 2, 3)], "book_id string, page_number int, seq int")
    accepted, rejected = writes.accept_pages(batch, stored, "seq")
    assert [r.seq for r in accepted.collect()] == [2]
    assert {r.seq: r.reject_reason for r in rejected.collect()} == {1: "key exists", 3: "repeated in batch"}
    orphans = audits.foreign_key_orphans([("batch", batch, "seq", "book_id")], spark.createDataFrame([("x",)], "id string"), "id")
    assert orphans.count() == 3


def test_append_and_open(spark, tmp_path):
    root = str(tmp_path)
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.parquet(f"{root}/{name}")
    new = spark.createDataFrame(
        [("b", n, f"p{n}", f"Page {n}", f"Page {n}", n) for n in (3, 1, 2)],
        "book_id string, page_number int, image_path string, ocr_markdown string, ocr_text_plain string, n int",
    )
    stored = open_catalog(spark, root)["books"].select(F.lit(0).cast("long").alias("id"))
    with_ids = writes.next_ids(new, stored, [F.col("n")])
    writes.append(writes.with_defaults(with_ids, "book_pages", now()), root, "book_pages")
    pages = open_catalog(spark, root)["book_pages"]
    assert [r.page_number for r in catalog.pages_of_book(pages, "b").collect()] == [1, 2, 3]
    assert sorted(r.id for r in pages.collect()) == [1, 2, 3]
    note = writes.with_defaults(spark.createDataFrame([("m",)], "user_memo string"), "sticky_notes", F.timestamp_seconds(now()))
    assert note.first().created_at is not None
    book = writes.with_hash_ids(spark.createDataFrame([("T", "A")], "title string, author string"), "title", "author")
    assert len(book.first().id) == 16
    defaults = writes.with_defaults(book, "books", now()).first()
    assert (defaults.pages_captured, defaults.is_pdf, defaults.total_pages) == (0, False, None)


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "My Book.pdf").write_bytes(b"%PDF-x")
    (tmp_path / "in" / "note.txt").write_text("x")
    found = files.read_files(spark, str(tmp_path / "in"), "*.pdf").collect()
    assert len(found) == 1 and bytes(found[0].content) == b"%PDF-x" and found[0].length == 6
    listed = files.list_files(spark, str(tmp_path / "in"), "*.pdf")
    assert "content" not in listed.columns
    manifest = files.import_manifest(listed, F.col("path"), F.lit(None).cast("string")).first()
    assert manifest.target_path.startswith("pdfs/") and "Book" in manifest.title
    (tmp_path / "dict.txt").write_text("_\r\na\nb\n\n日\n")
    entries = files.read_dictionary(spark, str(tmp_path / "dict.txt")).orderBy("line").collect()
    assert [(r.line, r.token) for r in entries] == [(0, "_"), (1, "a"), (2, "b"), (3, ""), (4, "日")]


def test_documents(spark):
    books = spark.createDataFrame(
        [("1", "T", "A", None, 3, None, 5, 6, 7, True, "/p.pdf")], TABLES["books"]
    )
    text_ = books.select(to_document(books).alias("j"))
    assert set(json.loads(text_.first().j)) == set(books.columns)
    assert from_document(text_, "j", books.schema).select("document.*").first() == books.first()
    logs = spark.createDataFrame(
        [
            ("u", '{"current_route":"/reader","scroll_position":200.0,"timestamp":9876543210}'),
            ("u", '{"current_route":"/","scroll_position":1.0,"timestamp":5}'),
            ("u", "{broken"),
        ],
        "user string, j string",
    )
    state = last_states(logs, "user", "j").first()
    assert (state.current_route, state.scroll_position, state.timestamp) == ("/reader", 200.0, 9876543210)
    rejected = from_document(logs, "j", T.StructType([T.StructField("timestamp", T.LongType())]))
    assert rejected.filter("reject_reason is not null").count() == 1


def test_exports(spark, tmp_path):
    entries = spark.createDataFrame(
        [("b", 'say "x"', None, "book", None, None), ("a", None, "e.g.", None, 4, "t")],
        "word string, meaning string, example_sentence string, source_book string, source_page int, tags string",
    )
    lines = {r.word: r.l for r in entries.select("word", export.csv_line().alias("l")).collect()}
    assert lines == {"b": '"b","say "x"","","book","0",""', "a": '"a","","e.g.","","4","t"'}
    document = "\n".join(r.value for r in export.markdown_lines(entries).collect())
    assert document == (
        "# Vocabulary List\n\n## a\n**Example**: e.g.\n\n## b\n**Meaning**: say \"x\"\n**Source**: book (p.0)\n"
    )
    for form in ("markdown", "csv", "json"):
        export.export_vocabulary(entries, form, str(tmp_path / form))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert {r.word: r.meaning for r in back.collect()}["b"] == 'say "x"'
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    with pytest.raises(ValueError):
        export.export_vocabulary(entries, "xml", str(tmp_path / "x"))


def test_search(spark):
    notes = spark.createDataFrame(
        [
            (1, "The Café is open. The open road", "A"), (2, "open the road", "cafe"),
            (3, "closed", "B"), (4, None, "road"), (5, "road road road to the the open", "C"),
        ],
        "id int, memo string, title string",
    )
    rows = search.postings(notes, "id", ["memo", "title"])

    def ids(found):
        return sorted(r.id for r in found.collect())

    assert ids(search.match_all(rows, ["cafe", "open"])) == [1, 2]
    assert ids(search.match_all(rows, ["cafe", "open"], ["memo"])) == [1]
    assert ids(search.match_any(rows, ["closed", "road"])) == [1, 2, 3, 4, 5]
    assert ids(search.match_none(search.match_any(rows, ["road"]), rows, ["cafe"])) == [4, 5]
    assert ids(search.match_phrase(rows, ["open", "the"])) == [1, 2]
    assert ids(search.match_phrase(rows, ["the", "the", "open"])) == [5]
    assert ids(search.match_phrase(rows, ["road", "road"])) == [5]
    assert ids(search.match_prefix(rows, "clo")) == [3]
    index = search.inverted_index(rows).filter("term = 'road' and id = 5").first()
    assert (index.tf, index.positions) == (3, [0, 1, 2])
    sizes = search.lengths(notes, "id", ["memo", "title"])
    scores = search.bm25(rows, sizes, ["closed", "cafe"])
    best = search.ranked_rows(scores, notes, "id", 2).collect()
    assert best[0].id == 3 and len(best) == 2
    n, mean = 5, sizes.agg(F.avg("length")).first()[0]
    idf = math.log((n - 1 + 0.5) / (1 + 0.5))
    assert best[0].score == pytest.approx(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / mean)))
    asked = spark.createDataFrame([(7, "closed"), (7, "cafe"), (8, "road")], "query_id int, term string")
    many = {(r.query_id, r.id): r.score for r in search.bm25_many(rows, sizes, asked).collect()}
    assert {i for q, i in many if q == 8} == {1, 2, 4, 5}
    assert many[(7, 3)] == pytest.approx(best[0].score)


def test_stored_index(spark):
    notes = spark.createDataFrame([(1, "one two"), (2, "two")], "id int, memo string")
    search.write_index(search.postings(notes, "id", ["memo"]), "stored_postings", 4)
    try:
        assert search.match_any(spark.table("stored_postings"), ["two"]).count() == 2
    finally:
        spark.sql("DROP TABLE stored_postings")


def test_detector_shapes(spark):
    rows = spark.createDataFrame(
        [
            (1, [1, 2, 4], [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0]),
            (2, [1, 2, 5], [0.0, 1.0, 2.0, 3.0, 0.9, 4.0, 5.0, 6.0, 7.0, 0.5]),
            (3, [2, 2, 4], [0.0] * 16), (4, [2, 4], [0.0] * 8), (5, [1, 0, 4], []),
            (6, [1, 3, 4], [0.0, 1.0, 2.0, 3.0, 4.0]),
        ],
        "k int, shape array<int>, data array<float>",
    )
    found = layout.detector_boxes(rows, ["k"], 0.5).collect()
    assert sorted((r.k, r.ix) for r in found) == [(1, 0), (1, 1), (2, 0), (6, 0)]
    assert layout.reading_votes(
        spark.createDataFrame([(1, True), (1, False), (2, True), (3, False)], "page_id int, is_vertical boolean")
    ).orderBy("page_id").select("reading_order").collect() == [("Mixed",), ("Vertical",), ("Horizontal",)]


def test_work_plans(spark):
    books = spark.createDataFrame([("a", 373), ("b", 3), ("c", None), ("d", 0)], "id string, total_pages int")
    sizes = convert.batch_sizes(convert.work_plan(books)).orderBy("book_id", "batch").collect()
    assert len(sizes) == 39 and sizes[37].pages == 3 and sizes[38].pages == 3
    done = spark.createDataFrame([("b", 1), ("b", 1)], "book_id string, page_number int")
    assert convert.remaining_pages(books, done).filter("book_id = 'b'").count() == 2
    reports = convert.sampled_progress(convert.page_sequence(books)).filter("book_id = 'b'").collect()
    assert sorted(r.page_number for r in reports) == [1, 3]


def test_slots(spark):
    def factory():
        tried = {}

        def work(row):
            tried[row["id"]] = tried.get(row["id"], 0) + 1
            if row["id"] == 2 or (row["id"] == 1 and tried[1] <= 2):
                raise RuntimeError("no")
            return row["id"] * 10

        return lambda rows: [work(row) for row in rows]

    rows = slots.run_slot(spark.range(3).coalesce(1), ["id"], factory, T.LongType())
    good, bad = slots.split_outcomes(rows)
    assert {(r.id, r.result, r.attempts) for r in good.collect()} == {(0, 0, 1), (1, 10, 2)}
    assert [(r.id, r.attempts, r.error) for r in bad.collect()] == [(2, 2, "RuntimeError: no")]


def test_stored_outcomes_are_not_made_again(spark, tmp_path):
    """A job that fails half way, a restart, new rows, and another try of the skipped ones; every call is counted."""
    calls, stop, store = (tmp_path / n for n in ("calls", "stop", "store"))
    calls.mkdir()
    stop.touch()

    def factory():
        def work(row):
            with open(calls / str(row["id"]), "a") as log:
                log.write("x")
            if row["id"] == 7 and stop.exists():
                raise RuntimeError("not now")
            return row["id"] * 10

        return lambda rows: [work(row) for row in rows]

    def factory_that_dies():
        if sum(1 for _ in calls.iterdir()) >= 10:
            raise MemoryError("executor lost")
        return factory()

    def made():
        return {int(f.name): len(f.read_text()) for f in calls.iterdir()}

    rows = spark.range(40).coalesce(1)
    with pytest.raises(Exception, match="executor lost"):
        slots.run_stored(rows, ["id"], factory_that_dies, T.LongType(), f"file://{store}", waves=4, batch_rows=1)
    before = made()
    assert 10 <= len(before) < 40
    found = slots.run_stored(rows, ["id"], factory, T.LongType(), f"file://{store}", waves=4, batch_rows=1)
    assert {r.id: r.result for r in found.collect()} == {i: None if i == 7 else i * 10 for i in range(40)}
    after = made()
    assert all(after[i] == n for i, n in before.items()) and set(after) == set(range(40))
    found = slots.run_stored(spark.range(42).coalesce(1), ["id"], factory, T.LongType(), f"file://{store}", waves=4)
    assert found.count() == 42 and {i for i, n in made().items() if n != after.get(i)} == {40, 41}
    stop.unlink()
    found = slots.run_stored(spark.range(42).coalesce(1), ["id"], factory, T.LongType(), f"file://{store}", waves=4, again=True)
    assert {r.id: r.result for r in found.collect()} == {i: i * 10 for i in range(42)}
    assert made()[7] == after[7] + 1 and made()[8] == after[8]


def test_slot_keys_pass_untouched(spark):
    """A null key beside one that no double can hold; the function sees None for null."""
    big = 9_007_199_254_740_993
    seen = T.ArrayType(T.BooleanType())
    rows = spark.createDataFrame([(big, "a"), (None, None), (7, "c")], "k long, t string").coalesce(1)
    found = slots.run_slot(rows, ["k"], lambda: lambda batch: [[r["k"] is None, r["t"] is None] for r in batch], seen)
    assert {(r.k, tuple(r.result)) for r in found.collect()} == {(big, (False, False)), (None, (True, True)), (7, (False, False))}
    short = slots.run_slot(rows, ["k"], lambda: lambda batch: [1] * (len(batch) // 2 + len(batch) % 2 * (len(batch) == 1)), T.LongType())
    assert {(r.k, r.status) for r in short.collect()} == {(big, "ok"), (None, "ok"), (7, "ok")}


def test_definitions_skip_what_fails(spark):
    words = spark.createDataFrame([(1, "good", "x"), (2, "bad", None)], "k int, word string, context string").coalesce(1)

    def engine():
        def define(rows):
            if any(r["word"] == "bad" for r in rows):
                raise KeyError("bad")
            return [f"{r['word']} {r['context']}" for r in rows]

        return define

    found = {r.k: (r.definition, r.status, r.attempts) for r in slots.define(words, ["k"], engine).collect()}
    assert found == {1: ("good x", "ok", 1), 2: (None, "skipped", 2)}


@pytest.mark.parametrize("large", [False, True])
def test_unknown_directions_at_every_size(spark, large):
    rows = [("p", 0, 0.0, 0.0, True), ("p", 1, 5.0, 5.0, None), (None, 0, 1.0, 2.0, None), (None, 1, 0.0, 1.0, True), (None, 2, 0.0, 0.0, True)]
    regions = spark.createDataFrame(rows, "page_id string, ix int, x1 double, y1 double, is_vertical boolean")
    found = {(r.page_id, r.ix): (r.reading_order, r["rank"]) for r in layout.in_reading_order(regions, large=large).df.collect()}
    assert found == {
        ("p", 0): ("Mixed", 1), ("p", 1): ("Mixed", 2),
        (None, 0): ("Vertical", 1), (None, 1): ("Vertical", 3), (None, 2): ("Vertical", 2),
    }
    votes = {r.page_id: (r.vertical, r.horizontal) for r in layout.reading_votes(regions).collect()}
    assert votes == {"p": (1, 1), None: (2, 1)}


@pytest.mark.parametrize("large", [False, True])
def test_running_total_passes_nulls(spark, large):
    rows = [(1, None), (2, 5), (3, 7), (4, None), (5, 1), (6, None)]
    df = spark.createDataFrame([("g", *r) for r in rows] + [(None, 1, None)], "k string, t int, v int")
    done = arrange(df, ["k"], [F.col("t")], slice_rows=2, large=large).running_total(F.col("v"), "sum").df
    assert {(r.k, r.t): r["sum"] for r in done.collect()} == {
        ("g", 1): None, ("g", 2): 5, ("g", 3): 12, ("g", 4): 12, ("g", 5): 13, ("g", 6): 13, (None, 1): None,
    }

import re

import pytest

from leafmill.llm import pii
from leafmill.llm.queries import op2_pii
from tests.llm.helpers import LONG, docs, empty

FOLDER = "/root/testdata/sf0.001"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([ -]?[0-9])+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}


def luhn(digits):
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def valid(kind, text):
    digits = re.sub("[^0-9]", "", text)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in text.split(".")),
        "card": lambda: 12 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 9 <= len(digits) <= 15,
    }[kind]()


def base(text):
    spans = [
        (m.start(), k, m.end(), kind)
        for k, (kind, pattern) in enumerate(PATTERNS.items())
        for m in re.finditer(pattern, text or "")
        if valid(kind, m.group())
    ]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(spans))


ODD = [
    "mail a@b.c_d@e.f x", "1.2.3.4.5.6.7.8 999.1.1.1", "ip 256.1.1.1 001.002.003.255", "+1 (626) 555-5759.", "+12345678",
    "4111 1111 1111 1111 and 4111-1111-1111-1112", "é😀 a@b.co 1", "", None, "0" * 30, "a.b@c..d.e", "@@@",
    "1-2 3-4 " * 3000, "+" + "1 " * 4000, "a@b" + ".c" * 20000, LONG, "a@b.c", "a@b.c",
]


def test_odd_rows(spark):
    found = {r.doc_id: r for r in pii.report(docs(spark, ODD)).collect()}
    assert len(found) == len(ODD)
    for i, text in enumerate(ODD):
        assert found[i].base_spans == base(text), text
        assert set(filter(None, base(text).split(","))) <= set(found[i].spans.split(","))
    assert pii.report(empty(spark)).count() == 0


def test_repeated_and_missing_ids(spark):
    rows = spark.createDataFrame([(1, "a@b.c"), (1, "a@b.c"), (1, "x"), (None, "a@b.c")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.base_spans) for r in pii.report(rows).collect()) == [
        (0, "email:0:5"), (1, ""), (1, "email:0:5"), (1, "email:0:5"),
    ]


def test_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = op2_pii(spark, FOLDER).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        spans = base(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(spans.count(f"{k}:") for k in PATTERNS)


def test_trees_add_what_the_strict_patterns_miss(spark):
    """National numbers score like those inside international ones; version numbers do not."""
    texts = [f"please call +1 (6{i % 10}{i % 7}) 555-{1000 + i} now, version {i}.{i % 9}" for i in range(400)]
    texts += ["please call (626) 555-1234 now"]
    found = {r.doc_id: r.spans for r in pii.report(docs(spark, texts)).collect()}
    assert "phone:12:26" in found[400].split(",")
    assert all(not s.startswith("ip") for spans in found.values() for s in spans.split(","))


def test_trees_add_on_large_input(spark):
    """Over 40,000 labelled candidates: the sample's order leaves both parts of it filled."""
    say = "please call +1 (6{0}) 555-{1} now, version {1}.{2}. "
    texts = ["".join(say.format(i % 90 + 10, 1000 + i % 8999, j) for j in range(10)) for i in range(2000)]
    rows = docs(spark, [*texts, "please call (626) 555-1234 now"])
    found, _ = pii.candidates(rows.selectExpr("doc_id as id", "text", "xxhash64(text) as part"))
    assert found.where("truth is not null").count() > 40_000
    assert pii.report(rows).where("doc_id = 2000").first().spans == "phone:12:26"


def test_rare_kinds_get_a_threshold(spark):
    """Thresholds come from all candidates outside the fitted sample, in which a kind may be rare."""
    runs = [" ".join(f"no {i}{j:02}00000000x" for j in range(20)) for i in range(1000)]
    calls = [f"please call +1 (6{i % 90 + 10}) 555-{1000 + i} now" for i in range(150)]
    rows = docs(spark, [*runs, *calls, "please call (626) 555-1234 now"])
    assert pii.report(rows, train_rows=1500).where("doc_id = 1150").first().spans == "phone:12:26"


def test_one_class_is_reported(spark):
    with pytest.warns(UserWarning, match="same truth"):
        assert pii.report(docs(spark, [f"a{i}@b.co" for i in range(100)]), train_rows=50).count() == 100


def test_redaction(spark):
    texts = ["a mail a@b.co, ip 1.2.3.4!", "é +1 (626) 555-5759", None, "clean"]
    rows = pii.redact(docs(spark, texts))
    assert rows.columns == docs(spark, texts).columns
    assert {r.doc_id: r.text for r in rows.collect()} == {0: "a mail [EMAIL], ip [IP]!", 1: "é [PHONE]", 2: None, 3: "clean"}

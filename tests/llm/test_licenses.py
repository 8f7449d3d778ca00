import re

from leafmill.llm import licenses
from leafmill.llm.queries import CHECKS, op10_licenses
from tests.compare import difference, duck
from tests.llm.helpers import LONG, docs, empty

FOLDER = "/root/testdata/sf0.001"


def bigrams(text):
    words = re.findall(r"[^\W_]+", text.lower())
    return set(zip(words, words[1:]))


def brute(text):
    units = {u for u in [*(text or "").split("\n"), *re.split(r"\n[ \t\r]*\n", text or ""), text or ""]}
    best, found = {}, set()
    for unit in units:
        for name, template in licenses.TEMPLATES:
            a, b = bigrams(unit), bigrams(template)
            dice = 2 * len(a & b) / (len(a) + len(b))
            if dice >= licenses.THRESHOLD:
                best[name] = max(best.get(name, 0), dice)
                found.add(name)
    return {name: round(best[name], 9) for name in found}


ODD = [
    None, "", "mit", "Released under the MIT License!", "x\nlicensed   UNDER the apache-license, (version 2.0)\ny", LONG,
    "\n\n".join(t for _, t in licenses.TEMPLATES), licenses.TEMPLATES[2][1].replace("charge, ", "charge,\n"),
    licenses.TEMPLATES[2][1].replace("software", "program"), "license license license", "the of this " * 50,
    "Permission to use, copy, modify", "Released under the MIT License.", "Released under the MIT License.",
]


def test_odd_rows(spark):
    found = {}
    for r in licenses.scan(docs(spark, ODD)).collect():
        found.setdefault(r.doc_id, {})[r.license] = round(r.dice, 9)
        assert r.units >= 1
    assert found == {i: b for i, t in enumerate(ODD) if (b := brute(t))}
    assert licenses.scan(empty(spark)).count() == 0


def test_notices_in_running_text(spark):
    """A notice within a line, or wrapped over comment lines, is found; one place counts once."""
    line = "The photos are by the author. Released under the MIT License. Contact us for prints."
    named, other = dict(licenses.TEMPLATES), " ".join(f"w{i}" for i in range(80))

    def comment(name, mark):
        lines = re.findall(r".{1,50}(?: |$)", named[name])
        blank = mark.rstrip()
        return "\n".join([f"{mark}Copyright (c) 2020 Somebody Else", blank, *[mark + x for x in lines], blank, f"{mark}{other}"])

    mit = f"# {licenses.TEMPLATES[2][1]}".replace("without", "\n# without")
    texts = [
        line, comment("MIT", "# "), f"#\n{mit}\n#\n# {other}", "x " * 3000 + line + " y" * 3000,
        line + " And so on and so forth. " + line, "the photos are under a licence of the author, released", comment("BSD-3-Clause", " * "),
    ]
    found = {}
    for r in licenses.scan(docs(spark, texts)).collect():
        found.setdefault(r.doc_id, []).append((r.license, r.dice, r.units))
    assert found == {i: [("MIT", 1.0, 1)] for i in range(4)} | {4: [("MIT", 1.0, 2)], 6: [("BSD-3-Clause", 1.0, 1)]}


def test_every_template_needs_a_marker():
    """Whatever bigrams a unit lacks, one with a marker word is left if it reaches the threshold."""
    words = set(licenses.markers(licenses.TEMPLATES, licenses.THRESHOLD))
    for _, text in licenses.TEMPLATES:
        own = licenses.bigrams_of(text)
        bare = [b for b in own if not words & set(b.split())]
        assert 2 * len(bare) / (len(bare) + len(own)) < licenses.THRESHOLD


def test_whole_table(spark):
    assert difference(op10_licenses(spark, FOLDER).toPandas(), duck(FOLDER).execute(CHECKS["op10_licenses"]).df()) is None

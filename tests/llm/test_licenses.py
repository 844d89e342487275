import random

from tests.llm.helpers import SCHEMA, frame, odd_rows, tables, words
from tidemark.llm import licenses

EDGES = "\"'()[]{}<>.,;:!?*#$%&|`_-"


def folded(text):
    return [w.strip(EDGES) or w for w in ("".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in words(text))]


def shingles(w):
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def plain(text):
    """Templates of which some window of their length holds enough distinct shingles."""
    own, found = shingles(folded(text)), set()
    for k, (_, template) in enumerate(licenses.TEMPLATES):
        want = set(shingles(folded(template)))
        n = len(shingles(folded(template)))
        for i in range(max(1, len(own) - n + 1)):
            if len(want & set(own[i : i + n])) >= 0.8 * len(want):
                found.add(k)
                break
    return {licenses.TEMPLATES[k][0] for k in found}


def mixed_texts():
    rng = random.Random(4)
    documents = tables("0.001", "documents")[0]
    texts = []
    for _ in range(80):
        name, template = rng.choice(licenses.TEMPLATES)
        w = template.split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], [w[k], "or"], ["other"]])
        notice = rng.choice([" ", "\n", "  "]).join(w)
        texts.append(f"{rng.choice(documents)[1][:200]} é {rng.choice([notice, notice.upper()])} {rng.choice(documents)[1][:100]}")
    return texts


def test_matches_are_those_of_exact_containment():
    templates = licenses.Templates([(n, t.encode()) for n, t in licenses.TEMPLATES])
    texts = mixed_texts() + ["", "a b c d e"]
    got = {}
    for k, name, *_ in licenses.find(templates, [t.encode() for t in texts]):
        got.setdefault(k, set()).add(name)
    assert [got.get(k, set()) for k in range(len(texts))] == [plain(t) for t in texts]


def test_spans_name_the_notice(spark):
    text = "é intro\nReleased under the MIT License. outro Licensed under CC BY-NC 4.0."
    out = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert {(r.license, text[r.start : r.end], r.containment) for r in out} == {
        ("MIT", "Released under the MIT License.", 1.0), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", 1.0)}


def test_blocks_of_templates_and_odd_rows(spark, monkeypatch):
    docs = frame(spark, odd_rows(["Released under the MIT License. " * 300, None, "", "x"]))
    whole = sorted(map(tuple, licenses.scan(docs).collect()))
    assert len(whole) == 300
    monkeypatch.setattr(licenses, "TEMPLATE_BYTES", 100)
    assert sorted(map(tuple, licenses.scan(docs).collect())) == whole
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0
    assert licenses.scan(docs, templates=(("tiny", "too short"),)).count() == 0


def test_licenses_that_differ_in_a_number_are_told_apart(spark):
    by_name = {}
    for name, template in licenses.TEMPLATES:
        by_name.setdefault(name, []).append(template)
    texts = ["This work is licensed under the GNU General Public License, version 3.", "This work is licensed under the GNU General Public License, version 2.",
             max(by_name["AGPL-3.0"], key=len), max(by_name["LGPL-3.0"], key=len), max(by_name["GPL-3.0"], key=len)]
    out = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r.doc_id, r.license) for r in out} == {(0, "GPL-3.0"), (1, "GPL-2.0"), (2, "AGPL-3.0"), (3, "LGPL-3.0"), (4, "GPL-3.0")}
    both = texts[0] + " And also: " + texts[1]
    assert {r.license for r in licenses.scan(spark.createDataFrame([(0, both)], "doc_id long, text string")).collect()} == {"GPL-2.0", "GPL-3.0"}

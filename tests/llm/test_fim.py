import hashlib
import io
import random
import re

import pytest
import zstandard

from tests.llm.helpers import SCHEMA, frame, odd_rows, tables
from tidemark.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(doc_id, text):
    """doc_id, n, form, code points of prefix and middle, output; by plain string handling."""
    text = text or ""
    units = UNIT.findall(text)
    digest = sha(f"42:{doc_id}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or doc_id is None or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def as_digests(rows):
    return sorted(repr((*r[:5], sha(r[5]), sha(text or ""))) for (_, text), r in rows)


def corpus(seed):
    rng = random.Random(seed)
    words = ["a", "be", "né", "漢字", "😀", "<P", "S>", "<", "M>", "x" * 90]
    out = []
    for k in range(400):
        text = "".join(rng.choice(words) + rng.choice([" ", "", "\n", " \t ", "\x0b"]) for _ in range(rng.choice([1, 2, 5, 60])))
        out.append((k, rng.choice(["", " ", "\n\n"]) + text))
    return out + [(1000, "<M> inside"), (1001, "   "), (1002, None), (None, "no id here"), (7, out[7][1]), (7, out[7][1])]


@pytest.mark.parametrize("size", [1, 16, 1 << 16])
def test_digests_are_those_of_plain_strings_at_any_frame_size(spark, size):
    rows = corpus(size)
    out = fim.digests(fim.transform(spark.createDataFrame(rows, "doc_id long, text string"), frame_bytes=size))
    assert sorted(repr(tuple(r)) for r in out.collect()) == as_digests([(r, plain(*r)) for r in rows])


def test_output_frames_join_to_one_file_and_every_form_occurs(spark):
    rows = corpus(5)
    out = fim.transform(spark.createDataFrame(rows, "doc_id long, text string"), frame_bytes=40).collect()
    want = sorted((repr(plain(*r)) for r in rows))
    whole = [zstandard.ZstdDecompressor().stream_reader(io.BytesIO(b"".join(r.frames)), read_across_frames=True).read().decode() for r in out]
    assert sorted(repr((*r[:5], t)) for r, t in zip(map(tuple, out), whole, strict=True)) == want
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    texts = fim.texts(fim.transform(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert sorted(repr(tuple(r)) for r in texts) == want


def test_only_the_frames_of_the_cuts_are_opened(monkeypatch):
    text = b" ".join(b"word%d" % k for k in range(5000))
    frames = fim.Frames(text, 500)
    opened, real = [], zstandard.ZstdDecompressor
    monkeypatch.setattr(fim, "unit_ends", lambda data, f=fim.unit_ends: opened.append(len(data)) or f(data))
    parts, _, _ = frames.cut(1234, 4321)
    assert len(opened) == 2 and max(opened) <= 500
    assert b"".join(real().decompress(f) for p in parts for f in p) == text
    assert sum(f in set(frames.data) for p in parts for f in p) >= len(frames.data) - 2


def test_a_text_of_many_frames_and_all_cuts():
    text = "één twee  drie\tvier <half\n vijf   ".encode()
    for size in (1, 3, 7, 100):
        frames = fim.Frames(text, size)
        units = UNIT.findall(text.decode())
        assert frames.n == len(units)
        for a in range(len(units) + 1):
            for b in range(a, len(units) + 1):
                parts, p, m = frames.cut(a, b)
                got = [b"".join(fim.opened(x)).decode() for x in parts]
                assert got == ["".join(units[:a]), "".join(units[a:b]), "".join(units[b:])] and (p, m) == (len(got[0]), len(got[1]))


def test_odd_rows_clashing_columns_and_an_empty_table(spark):
    rows = odd_rows()
    out = fim.digests(fim.transform(frame(spark, rows)))
    assert sorted(repr(tuple(r)) for r in out.collect()) == as_digests([(r[:2], plain(*r[:2])) for r in rows])
    assert fim.digests(fim.transform(spark.createDataFrame([], SCHEMA))).count() == 0


def test_whole_table_of_documents(spark):
    rows = [r[:2] for r in tables("0.001", "documents")[0]]
    out = fim.digests(fim.transform(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sorted(repr(tuple(r)) for r in out.collect()) == as_digests([(r, plain(*r)) for r in rows])

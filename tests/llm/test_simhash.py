import itertools
import random

import numpy as np
import xxhash

from tests.llm.helpers import SCHEMA, components, frame, odd_rows, tables, words
from tidemark.llm import simhash
from tidemark.llm.components import components as spark_components
from tidemark.llm.components import forest


def plain_fingerprint(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def plain(rows):
    fp = [plain_fingerprint(t) for _, t in rows]
    links = [(i, j) for i, j in itertools.combinations(range(len(fp)), 2) if (fp[i] ^ fp[j]).bit_count() <= 4]
    group = components(len(fp), links)
    least = {}
    for g, (doc, _) in zip(group, rows, strict=True):
        if doc is not None:
            least[g] = min(least.get(g, doc), doc)
    return group, sorted(repr((doc, f"{f:016x}", least.get(g))) for (doc, _), f, g in zip(rows, fp, group, strict=True))


def near_copies(seed=5):
    rng = random.Random(seed)
    documents = tables("0.001", "documents")[0][:60]
    rows = [r[:2] for r in documents]
    long_ = max((r[1] for r in documents), key=len)
    for k in range(25):
        w = long_.split()
        w[rng.randrange(len(w))] = f"x{k}"
        rows.append((1000 + k, " ".join(w)))
    return rows + [(2000, documents[3][1]), (2001, documents[3][1].upper())]


def test_components_are_those_of_all_pairs(spark):
    rows = near_copies() + [r[:2] for r in odd_rows()]
    out = simhash.cluster(frame(spark, [(*r, None, None, None, None) for r in rows]))
    assert sorted(repr(tuple(r)) for r in out.collect()) == plain(rows)[1]


def test_one_row_of_each_component_stays(spark):
    rows = [(*r, "en", None, k, True) for k, r in enumerate(near_copies())] + odd_rows()
    docs = frame(spark, rows)
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    group, _ = plain([r[:2] for r in rows])
    first = {}
    for g, r in zip(group, rows, strict=True):
        first.setdefault(g, []).append(r)
    best = sorted((repr(min((x[0] is None, x[0] or 0) for x in g))) for g in first.values())
    got = kept.collect()
    assert sorted(repr((r.doc_id is None, r.doc_id or 0)) for r in got) == best
    assert simhash.deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0
    assert simhash.cluster(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ball_of_many_near_fingerprints_is_split_and_loses_no_link(monkeypatch):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, 6, dtype=np.uint64)
    fp = np.unique(np.concatenate([c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (40, 3)).astype(np.uint64), axis=1) for c in centre]))
    links = [(i, j) for i, j in itertools.combinations(range(len(fp)), 2) if int(fp[i] ^ fp[j]).bit_count() <= 4]
    want = components(len(fp), links)
    monkeypatch.setattr(simhash, "VARIANTS_AT_ONCE", 3000)
    place = {int(x): k for k, x in enumerate(fp)}
    found = []
    for bucket in range(64):
        distance = np.bitwise_count((fp >> np.uint64(58)) ^ np.uint64(bucket))
        u, v = simhash._bucket_links(fp[distance <= 2], bucket, 6)
        found += [(place[int(a)], place[int(b)]) for a, b in zip(u, v, strict=True)]
    assert components(len(fp), found) == want


def test_components_of_long_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (-5, 60)]
    got = {r.node: r.root for r in spark_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{100 + k: 100 for k in range(30)}, -5: -5, 60: -5}
    assert forest(4, np.array([3]), np.array([1])).tolist() == [0, 1, 2, 1]

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import tables
from tidemark.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int"
DOUBLES = "vec_id long, embedding array<double>, data string, cell int"


def search(spark, rows, schema=SCHEMA):
    return neighbours.search(spark.createDataFrame(rows, schema), F.col("vec_id") % 100 == 0)


def plain(rows, k=10):
    """Every query's k nearest by brute force: {(vec_id, vector): [(score, vec_id)]}."""
    fit = [(i, tuple(v)) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    sizes = [len(v) for _, v in fit]
    size = min(sorted(set(sizes)), key=lambda s: (-sizes.count(s), s), default=0)
    fit = sorted({(i, v) for i, v in fit if len(v) == size})
    vectors = np.array([v for _, v in fit], np.float64).reshape(len(fit), size)
    out = {}
    for n, (i, v) in enumerate(fit):
        if i % 100 == 0:
            score = np.sqrt(((vectors - np.array(v)) ** 2).sum(axis=1))
            out[i, v] = sorted((float(s), j) for m, (s, (j, _)) in enumerate(zip(score, fit, strict=True)) if m != n)[:k]
    return out


def by_query(found):
    out = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
    return out


def vectors(seed, n, size=16, unit=True):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(5, size))[rng.integers(0, 5, n)] * 0.8 + rng.normal(size=(n, size))
    x = x / np.linalg.norm(x, axis=1, keepdims=True) if unit else x * rng.uniform(0.1, 3, (n, 1))
    return x.astype(np.float32)


def recall(found, want):
    hits = sum(len({i for _, i in found.get(q, [])} & {i for _, i in near}) for (q, _), near in want.items())
    return hits / sum(len(near) for near in want.values())


def check(spark, rows, schema=SCHEMA, least=0.9):
    found = by_query(search(spark, rows, schema).collect())
    want = plain(rows)
    assert recall(found, want) >= least
    place = {}
    for i, v, *_ in rows:
        place.setdefault(i, []).append(v)
    for (q, v), near in want.items():
        got = found[q]
        assert len(got) == len(near) and got == sorted(got) and len({x for _, x in got}) == len(got)
        for score, i in got:  # exactly the distance of the original vectors
            assert any(abs(score - math.sqrt(sum((a - b) ** 2 for a, b in zip(v, w, strict=True)))) < 1e-12 * max(1, score) for w in place[i] if len(w) == len(v))
    return found, want


@pytest.mark.parametrize("unit", [True, False])
def test_recall_against_brute_force(spark, unit):
    rows = [(k, v.tolist(), 0) for k, v in enumerate(vectors(1, 3000, unit=unit))]
    check(spark, rows)


def test_deeper_codes_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CODE_ROWS", 2)
    for name, value in (("ROWS", 64), ("LEAST_ROWS", 16), ("QUERIES", 2)):
        monkeypatch.setattr(neighbours, name, value)
    rows = [(k, v.tolist(), 0) for k, v in enumerate(vectors(2, 4000))]
    assert neighbours._depth(4000, neighbours.Space(16, None, False)) == 2
    check(spark, rows)


def test_turning_keeps_lengths_and_probes_begin_with_the_own_code():
    space = neighbours.Space(13, None, False)
    unit = space.unit(vectors(3, 50, 13).astype(np.float64))
    turned = neighbours._turned(unit, np.random.default_rng(1).choice([-1.0, 1.0], (3, 16)))
    assert np.allclose(np.linalg.norm(turned, axis=1), 1) and np.allclose(turned @ turned.T, unit @ unit.T)
    for depth in (1, 2):
        cell, fine = space.codes(unit, 1, depth)
        probes = space.probes(unit, 1, depth, 40)
        assert (probes[:, 0] == cell * space.fine_codes(depth) + fine).all()
        assert all(len(set(p)) == len(p) for p in probes.tolist())


def test_a_third_of_copies_and_a_ball_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAST_ROWS", 64)
    x = vectors(4, 3000)
    x[::3] = x[0]
    near = x[1] + 0.01 * np.random.default_rng(5).normal(size=(1000, 16)).astype(np.float32)
    rows = [(k, v.tolist(), 0) for k, v in enumerate(np.concatenate([x, near]))]
    found, want = check(spark, rows)
    assert found[300] == want[300, tuple(rows[300][1])] and found[300][0][0] == 0.0


def test_a_rare_query_whose_neighbours_lie_in_cells_it_would_not_probe(spark):
    far = [-1.0] + [0.0] * 15
    rows = [(k, [1.0, 0.001 * (k % 7)] + [0.0] * 14, 0) for k in range(1, 900) if k % 100] + [(0, far, 0)]
    found, want = check(spark, rows, least=1.0)
    assert found[0] == want[0, tuple(far)]


def test_fewer_rows_than_k_ties_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], "x", 1), (100, [1.0, 0.0], None, None), (100, [1.0, 0.0], "again", 2), (200, [0.0, 2.0], None, None), (3, [0.0, -1.0], None, None),
        (2, [0.0, 1.0], None, None), (None, [1.0, 1.0], None, None), (5, None, None, None), (6, [], None, None), (7, [0.0, 0.0], None, None),
        (8, [nan, 1.0], None, None), (9, [inf, 1.0], None, None), (10, [None, 1.0], None, None), (300, [1.0, 2.0, 3.0], None, None), (-100, [1e200, -1e200], None, None),
    ]
    found = by_query(search(spark, rows, DOUBLES).collect())
    want = {q: near for (q, _), near in plain(rows).items()}
    assert set(found) == set(want) == {0, 100, 200, -100}
    for q, near in want.items():
        assert [i for _, i in found[q]] == [i for _, i in near] or q == -100
        assert len(found[q]) == 5
    assert found[0][0] == (0.0, 100) and found[-100][0][0] == pytest.approx(math.sqrt(2) * 1e200)


def test_rows_that_share_an_id_and_empty_tables(spark):
    rows = [(100, [1.0, 0.0], 0), (100, [0.0, 1.0], 0), (1, [1.0, 1.0], 0)]
    found = search(spark, rows).collect()
    assert sorted((r.query_id, r.vec_id, round(r.score, 6)) for r in found) == [(100, 1, 1.0), (100, 1, 1.0), (100, 100, 1.414214), (100, 100, 1.414214)]
    for empty in ([], [(0, [0.0], 0)], [(100, [1.0], 0)]):
        out = search(spark, empty)
        assert out.columns == ["query_id", "rank", "vec_id", "score"] and out.count() == 0


def test_recall_on_the_table_of_embeddings(spark):
    rows = [(r[0], list(r[1]), 0) for r in tables("0.01", "embeddings")[0]]
    check(spark, rows)

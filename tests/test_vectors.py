"""Vector search that skips blocks, against all pairs."""

import numpy as np
import pytest

from folioscope.operators import vector_blocks as B
from folioscope.operators import vectors as V

WORDS = [f"word{i}" for i in range(200)]


def clustered(n=1500, clusters=30, width=64, noise=0.25, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, width))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    vecs = centres[rng.integers(0, clusters, n)] + noise / np.sqrt(width) * rng.normal(size=(n, width))
    vecs[:3] = 0
    vecs[10:14] = vecs[9]
    titles = [f"common {rng.choice(WORDS)} {rng.choice(WORDS)}" if rng.random() < 0.5 else f"{rng.choice(WORDS)} {rng.choice(WORDS)} {rng.choice(WORDS)}"
              for _ in range(n)]
    titles[5], titles[6] = "", "common"
    return vecs, titles


def brute(vecs, titles):
    u = B.unit(list_series(vecs))
    cos = u @ u.T
    sim = B.overlap([set(t.split()) for t in titles], [set(t.split()) for t in titles])
    return cos, sim, np.minimum(1.0, cos + np.where(sim >= V.TITLE_MIN, V.TITLE_WEIGHT * sim, 0.0))


def list_series(vecs):
    import pandas as pd
    return pd.Series([list(v) for v in vecs])


@pytest.fixture(scope="module")
def data():
    return clustered()


@pytest.fixture(scope="module")
def notes(spark, data):
    vecs, titles = data
    rows = [(f"{i:05d}", [float(x) for x in v], t) for i, (v, t) in enumerate(zip(vecs, titles))]
    return spark.createDataFrame(rows, "id string, vec array<double>, title string").repartition(4)


def test_bounds_hold():
    """No pair is above the bound of its row or of its blocks; the bound is not loose either."""
    rng = np.random.default_rng(2)
    for width in (4, 8, 9, 40, 64):
        z = rng.normal(size=(200, width)) * np.linspace(2, 0.2, width)
        z /= np.linalg.norm(z, axis=1, keepdims=True)
        parts = np.split(z, 8)
        means = np.stack([p.mean(0) for p in parts])
        radii = np.stack([B.segments(p - m).max(0) for p, m in zip(parts, means)])
        for i, p in enumerate(parts):
            bound = B.block_bound(means[i], radii[i], means, radii)
            for j, q in enumerate(parts):
                assert (p @ q.T).max() <= bound[j] + 1e-12
                assert ((p @ q.T).max(1) <= B.row_bound(p, means[j], radii[j]) + 1e-12).all()
                assert bound[j] <= means[i] @ means[j] + 8


def test_pairs_are_all_pairs(notes, data):
    _, _, score = brute(*data)
    for floor in (0.72, 0.95):
        got = {(r.a, r.b): r.combined for r in V.pairs(notes, floor, block=64).collect()}
        rows, cols = np.nonzero(np.triu(score >= floor, 1))
        assert set(got) == {(f"{i:05d}", f"{j:05d}") for i, j in zip(rows, cols)}
        assert all(abs(v - score[int(a), int(b)]) < 1e-9 for (a, b), v in got.items())


@pytest.mark.parametrize("titles", [True, False])
def test_nearest_is_exact(notes, data, titles):
    cos, _, score = brute(*data)
    score = score if titles else cos
    asked = notes.filter("int(id) % 7 = 0")
    got = {}
    for r in V.nearest(asked, notes, 5, titles=titles, block=64).collect():
        got.setdefault(int(r.id), []).append((r.pos, r.combined))
    assert len(got) == len([i for i in range(score.shape[0]) if i % 7 == 0])
    for i, found in got.items():
        assert np.allclose([s for _, s in sorted(found)], np.sort(score[i])[::-1][:5], atol=1e-9)


def test_blocks_are_skipped(notes):
    shares = {
        "pairs": V.visited_share(notes, notes, floor=0.72, titles=False, block=64),
        "pairs, frequent title word": V.visited_share(notes, notes, floor=0.9, block=64),
        "top 5": V.visited_share(notes, notes, k=5, titles=False, block=32),
    }
    print(shares)
    # the word "common" is in half of all titles and adds up to 0.3 wherever two blocks share it
    assert shares["pairs"] < 0.3 and shares["top 5"] < 0.3 and shares["pairs, frequent title word"] < 0.5


def test_awkward_vectors(spark):
    schema = "id string, vec array<double>, title string"
    none = spark.createDataFrame([], schema)
    assert V.nearest(none, none, 3).collect() == [] and V.pairs(none).collect() == []
    one = spark.createDataFrame([("a", [1.0, 0.0], "x"), ("b", [0.0, 0.0], "x"), ("c", [1.0, 1e-12], None)], schema)
    assert [(r.a, r.b) for r in V.pairs(one, 0.9).collect()] == [("a", "c")]
    got = sorted((r.id, r.pos, r.other) for r in V.nearest(one, one, 9, titles=False).collect())
    assert [g[1] for g in got] == [1, 2, 3] * 3
    assert V.nearest(one.filter("id = 'a'"), none, 3).collect() == []


def test_members_are_sent_once_per_tile(spark, notes, data, monkeypatch):
    """Rows shuffled for the search are blocks times tiles, not pairs of blocks; several tiles find what one does."""
    monkeypatch.setattr(V, "TILES", 3)
    search = V.Search(notes, notes, False, 32)
    asking = search._ask(5, None)
    blocks = search.packed.count()
    plan = search._streamed(asking, 5, False)
    found = plan.count()
    assert blocks > 20 and found <= 5 * notes.count()
    _, _, score = brute(*data)
    got = {(r.a, r.b) for r in V.pairs(notes, 0.72, block=32).collect()}
    rows, cols = np.nonzero(np.triu(score >= 0.72, 1))
    assert got == {(f"{i:05d}", f"{j:05d}") for i, j in zip(rows, cols)}

import numpy as np
import pytest

from wireloom.llm import embedding_dedup as E

def slow(rows, threshold=0.9):
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(rows[i][1], float) / max(map(abs, rows[i][1])) for i in ok}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    near = {i: set() for i in range(len(rows))}
    for i in ok:
        for j in ok:
            if i < j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                near[i].add(j), near[j].add(i)
    out, seen = [None] * len(rows), set()
    for i in range(len(rows)):
        if i in seen:
            continue
        group, front = {i}, [i]
        while front:
            new = near[front.pop()] - group
            group |= new
            front += new
        seen |= group
        low = min((rows[g][0] for g in group if rows[g][0] is not None), default=None)
        for g in group:
            out[g] = (rows[g][0], len(near[g]), low, rows[g][0] == low)
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, E.near_duplicates(df).collect()), key=repr)


def test_edge_cases(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, -0.0]), (2, [2.0, 0.0, 0.0]), (3, [0.95, 0.3, 0.0]), (4, [0.0, 0.0, 0.0]), (5, None), (6, []), (7, [1.0, None, 0.0]), (8, [float("nan"), 1.0, 0.0]), (9, [float("inf"), 1.0, 0.0])]
    rows += [(10, [1.0, 0.0]), (11, [1.0, 0.1]), (12, [1.0]), (13, [-1.0]), (14, [2.0]), (None, [0.0, 1.0, 0.0]), (15, [0.0, 1.0, 0.01]), (16, [1e300, 0.0, 0.0]), (17, [1e-300, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, n_links string").repartition(3)
    assert got(df) == slow(rows)
    assert got(spark.createDataFrame([], "vec_id long, embedding array<float>")) == []


def clusters(n, per, spread, dim=16, seed=1):
    draw = np.random.default_rng(seed)
    centre = draw.normal(size=(n, dim))
    x = np.repeat(centre, per, axis=0) + spread * draw.normal(size=(n * per, dim))
    return x.astype(np.float32)


def test_recall_on_hard_clusters(spark):
    """Clusters whose cosines spread around the threshold: no false link, few lost."""
    x = clusters(60, 12, 0.25)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    have = {r[0]: r for r in got(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))}
    want = {r[0]: r for r in slow(rows)}
    assert all(have[i][1] <= want[i][1] for i in want)
    assert sum(r[1] for r in have.values()) >= 0.98 * sum(r[1] for r in want.values()) > 0


@pytest.mark.parametrize("spread", [0.2, 0.25, 0.3])
def test_recall_over_many_cells(spark, monkeypatch, spread):
    """Many cells, so that the margin and the walk decide which pairs meet, and most vectors not in the sample."""
    words, fit = [], E.MultiIndex.fit.__func__

    def seen(cls, *a, **kw):
        index = fit(cls, *a, **kw)
        words.append((len(index.first), len(index.second)))
        return index

    monkeypatch.setattr(E, "PER_CELL", 5)
    monkeypatch.setattr(E.MultiIndex, "fit", classmethod(seen))
    rows = [(i, v.tolist()) for i, v in enumerate(clusters(150, 12, spread))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    have = {r[0]: r[1] for r in E.near_duplicates(df, sample=400).collect()}
    want = {r[0]: r[1] for r in slow(rows)}
    assert [min(w) for w in words] == [18]
    assert all(have[i] <= want[i] for i in want)
    recall = sum(have.values()) / sum(want.values())
    print(f"recall {recall:.4f} of {sum(want.values()) // 2} pairs, {spread=}, {words=}")
    assert recall >= 0.9


def test_very_many_lengths(spark, monkeypatch):
    """Vectors of 300 different lengths, two of which have enough for an index of their own: one pass fits them all."""
    monkeypatch.setattr(E, "ONE_CELL", 100)
    monkeypatch.setattr(E, "PER_CELL", 5)
    fits, fit = [], E.MultiIndex.fit.__func__
    monkeypatch.setattr(E.MultiIndex, "fit", classmethod(lambda cls, x, n, *a, **kw: (fits.append((x.shape, n)), fit(cls, x, n, *a, **kw))[1]))
    draw = np.random.default_rng(9)
    rows = []
    for d in range(1, 301):
        v = draw.normal(size=d)
        rows += [(len(rows) + i, (v + 0.02 * i * draw.normal(size=d)).tolist()) for i in range(2)]
    for d in (6, 9):
        rows += [(10_000 * d + i, v.tolist()) for i, v in enumerate(clusters(30, 5, 0.2, d, d).astype(float))]
    have = {r[0]: r for r in got(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5))}
    want = {r[0]: r for r in slow(rows)}
    assert sorted(fits) == [((152, 6), 152), ((152, 9), 152)]
    assert all(have[i][1] <= want[i][1] for i in want) and sum(r[1] for r in have.values()) >= 0.95 * sum(r[1] for r in want.values())
    assert all(have[i] == want[i] for i in have if i < 600 and len(rows[i][1]) not in (6, 9))


def test_codewords_follow_the_vectors():
    assert [E.words_for(n) for n in (1, 799, 800, 51_200, 10**9, 10**10, 10**12)] == [1, 1, 2, 16, 2236, 7071, 8192]


def test_distances_are_held_in_parts(monkeypatch):
    x = clusters(40, 10, 0.3).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    monkeypatch.setattr(E, "PER_CELL", 5)
    one = E.MultiIndex.fit(x, len(x), 0.9)
    monkeypatch.setattr(E, "HELD", 200)
    two = E.MultiIndex.fit(x, len(x), 0.9)
    assert np.allclose(one.first, two.first) and np.allclose(one.second, two.second) and abs(one.margin - two.margin) < 1e-9


def test_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = slow([(r.vec_id, r.embedding) for r in df.collect()])
    assert got(df) == want


def test_blocks(spark, monkeypatch):
    """A hot cell, dealt out in many blocks, gives the same counts."""
    monkeypatch.setattr(E, "BLOCK", 16)
    monkeypatch.setattr(E, "VISITORS", 24)
    x = clusters(2, 150, 0.05)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert got(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)) == slow(rows)


def test_walk_visits_by_distance():
    draw = np.random.default_rng(3)
    index = E.MultiIndex(draw.normal(size=(7, 3)), draw.normal(size=(5, 2)), 1.5)
    for v in draw.normal(size=(40, 5)):
        d1, d2 = (d[0] for d in index.halves(v[None]))
        all_ = sorted((d1[i] + d2[j], i * 5 + j) for i in range(7) for j in range(5))
        want = [c for d, c in all_ if d <= all_[0][0] + 1.5]
        assert index.visits(d1, d2) == want

import zlib

import numpy as np

from wireloom.llm import quality as Q

from .edge import docs, empty, rows


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = Q.learned(d, labels)
    got = Q.scored(d, model).join(labels, "doc_id").collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [r for r in got if r.held_out]
    assert len(held) > 50 and np.mean([r.predicted == r.quality for r in held]) >= 0.97
    # the held-out labels and everything but the text have no part in the scores
    other = labels.withColumn("quality", (labels.quality * 0 + 1 - labels.quality).cast("int")).filter(Q.held_out()).union(labels.filter(~Q.held_out()))
    again = Q.learned(d.drop("lang", "source"), other)
    assert np.array_equal(again.weights, model.weights) and again.shift == model.shift


def test_pairs_order_scores():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(400, len(Q.NAMES)))
    y = (x[:, 0] - x[:, 3] + 0.1 * draw.normal(size=400) > 0).astype(int)
    m = Q.fit(x, y)
    s = m.score(x)
    assert s[y == 1].mean() > s[y == 0].mean() and ((s >= 0.3) == y).mean() > 0.95


def slow_fit(x, label, pairs, ridge, seed, cut):
    """Bradley-Terry by plain accelerated gradient descent over the same preference pairs, and the cut by trying every place."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    scale = x.std(axis=0)
    z = np.clip((x - x.mean(axis=0)) / np.where(scale > 1e-12, scale, 1.0), -8, 8)
    draw = np.random.default_rng(seed)
    d = z[draw.choice(good, pairs)]
    d = d - z[draw.choice(bad, pairs)]
    hold = np.array([ridge if n in Q.STYLE else ridge * Q.HASHED_RIDGE for n in Q.NAMES])
    rate = 1 / (np.linalg.eigvalsh(d.T @ d / pairs)[-1] / 4 + hold.max())
    w = ahead = np.zeros(d.shape[1])
    for i in range(6000):
        grad = -(d * (1 / (1 + np.exp(d @ ahead)))[:, None]).mean(axis=0) + hold * ahead
        new = ahead - rate * grad
        w, ahead = new, new + i / (i + 3) * (new - w)
    s = z @ w
    levels = np.sort(s)
    wrong = lambda c: (s[label == 1] < c).mean() + (s[label == 0] >= c).mean()
    middles = (levels[1:] + levels[:-1]) / 2
    least = min(map(wrong, middles))
    best = [c for c in middles if wrong(c) <= least + 1e-12]
    return w, 1 / (1 + np.exp(-(s - best[len(best) // 2] + np.log(cut / (1 - cut)))))


def test_against_gradient_descent(spark, sf):
    """The fitted weights and scores are those of an independent, plain fit."""
    docs_, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    rows_ = docs_.join(labels, "doc_id").select("text", "quality").collect()
    x, y = np.array([Q.features(r.text) for r in rows_]), np.array([r.quality for r in rows_])
    noise = np.random.default_rng(3).random(len(y)) < 0.15  # so that the classes overlap
    y = np.where(noise, 1 - y, y)
    m = Q.fit(x, y, pairs=1500, ridge=1e-2, seed=4)
    w, scores = slow_fit(x, y, 1500, 1e-2, 4, Q.CUT)
    assert np.abs(m.weights - w).max() < 2e-3 and np.abs(m.score(x) - scores).max() < 0.05
    assert np.corrcoef(m.score(x), scores)[0, 1] > 0.9999


def test_hashed_features_are_shares_of_words_and_bytes():
    text = "b a b " * 3 + "naïve"
    words = text.encode().split()
    share = np.zeros(Q.BUCKETS)
    for word in words:
        share[zlib.crc32(word) % Q.BUCKETS] += 1 / len(words)
    raw, runs = text.encode(), np.zeros(Q.BUCKETS)
    for i in range(len(raw) - 2):
        h = sum(int(b) * int(k) for b, k in zip(raw[i : i + 3], Q._MIX)) * int(Q._MIX[3]) % (1 << 32) >> 26
        runs[h] += 1 / (len(raw) - 2)
    got = Q.features(text)[len(Q.STYLE) :]
    assert np.allclose(got[: Q.BUCKETS] ** 2, share) and np.allclose(got[Q.BUCKETS :] ** 2, runs)


def test_repeats_of_a_labelled_document_are_one_row(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    once = [(i, ("good calm words. " if i % 2 else "BAD!!! |||| ") * (i + 1)) for i in range(40)]
    one = Q.learned(spark.createDataFrame(once, "doc_id long, text string"), labels)
    many = Q.learned(spark.createDataFrame(once * 3 + once[:1] * 500, "doc_id long, text string").repartition(5), labels)
    assert np.array_equal(one.weights, many.weights) and one.shift == many.shift


def test_one_class_only():
    x = np.zeros((3, len(Q.NAMES)))
    assert Q.fit(x, np.ones(3, int)).score(x)[0] == 0.5
    assert abs(Q.fit(x, np.zeros(3, int)).score(x)[0] - 0.25) < 1e-12
    assert Q.fit(x[:0], np.zeros(0, int)).score(x)[0] == 0.5


def test_edge_cases(spark):
    labels = spark.createDataFrame([(1, 1, "x"), (2, 0, "x"), (7, 0, "x"), (7, 1, "x"), (None, 1, "x"), (6, None, "x"), (777, 0, "x"), (8, 5, "x")], "doc_id long, quality int, text string")
    model = Q.learned(docs(spark), labels)
    got = Q.scored(docs(spark, "held_out"), model)
    assert got.count() == docs(spark).count() and all(0 <= r.score <= 1 for r in got.collect())
    assert Q.scored(empty(spark), model).count() == 0
    none = Q.learned(empty(spark), labels)
    assert rows(Q.scored(docs(spark), none))[0][2] == 0.5
    kept = Q.kept(docs(spark), none)
    assert kept.columns == docs(spark).columns and kept.count() == docs(spark).count()


def test_features_of_whole_texts():
    clean, junk = "The cat sat on the mat. " * 50, "Th&&& ou%%% st*** " * 50
    f, g = Q.features(clean), Q.features(junk)
    assert len(f) == len(Q.NAMES) and g[Q.NAMES.index("symbol")] > f[Q.NAMES.index("symbol")]
    assert (Q.features(None) == Q.features("")).all()

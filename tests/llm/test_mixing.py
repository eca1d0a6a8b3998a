import re
from collections import defaultdict

import pytest

from wireloom.llm import mixing

from .edge import docs, empty, rows


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def slow_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, stopped = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in stopped]
        left = total - sum(stopped.values())
        share = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return share | stopped
        stopped |= {s: 3 * sizes[s] for s in over}


def check(df, out):
    data = [(r.doc_id, r.text, r.source) for r in df.collect()]
    sizes = defaultdict(int)
    for _, t, s in data:
        sizes[s] += size(t)
    want = slow_targets(sizes)
    got = out.collect()
    assert sorted(((r.doc_id, r.size) for r in got), key=repr) == sorted(((d, size(t)) for d, t, _ in data), key=repr)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-12)
        assert 0 <= r.taken <= 3 * r.size
        assert not r.size or r.taken // r.size in (r.epochs, r.epochs + 1)
        taken[r.source] += r.taken
    for s, n in taken.items():
        assert n == int(want[s] + 1e-9)  # exactly the budget


def test_edge_cases(spark):
    df = docs(spark, "target")
    check(df, mixing.mixed(mixing.sizes_of(df)))
    assert mixing.mixed(mixing.sizes_of(empty(spark))).count() == 0


def test_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    out = mixing.mixed(mixing.sizes_of(df))
    check(df, out)
    again = mixing.mixed(mixing.sizes_of(df.repartition(5)))
    assert rows(out.select("doc_id", "taken")) == rows(again.select("doc_id", "taken"))


def test_only_blank_texts(spark):
    df = spark.createDataFrame([(1, " ", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert rows(mixing.mixed(mixing.sizes_of(df)).select("doc_id", "target", "taken")) == [(1, 0.0, 0), (2, 0.0, 0)]


def test_materialised_holds_the_budgets(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    out = mixing.materialised(df)
    assert out.columns == df.columns
    plan = {(r.source): (int(r.target)) for r in mixing.mixed(mixing.sizes_of(df)).select("source", "target").distinct().collect()}
    words, text = defaultdict(int), {r.doc_id: r.text for r in df.collect()}
    short = 0
    for r in out.collect():
        words[r.source] += size(r.text)
        assert text[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
        short += r.text != text[r.doc_id]
    assert dict(words) == plan and short <= len(plan)


@pytest.mark.parametrize("bound", [100_000, 0])
def test_materialised_holds_the_budgets_with_ties(spark, monkeypatch, bound):
    """Rows that agree in id, source and size, where the cut falls among them."""
    monkeypatch.setattr(mixing, "SOURCES_BOUND", bound)
    for copies, words in ((3, 7), (5, 11), (2, 1), (40, 13)):
        data = [(1, " ".join(["w"] * words) + ("" if i % 2 else " "), "a", 0) for i in range(copies)] + [(2, "one two three", "b", 13), (3, "x y", "c", 3), (4, None, "c", None), (5, "q", None, 1)]
        df = spark.createDataFrame(data, "doc_id long, text string, source string, n_chars long")
        out = mixing.materialised(df).collect()
        got, want = defaultdict(int), {}
        for r in out:
            got[r.source] += size(r.text)
            assert r.text is None or r.n_chars == len(r.text) or (r.doc_id == 1 and r.n_chars == 0)
        for r in mixing.mixed(mixing.sizes_of(df)).collect():
            want[r.source] = int(r.target)
        assert {s: n for s, n in got.items() if n} == {s: n for s, n in want.items() if n}, (copies, words)


def test_materialised_edge_cases(spark):
    out = mixing.materialised(docs(spark, "size"))
    assert out.columns == docs(spark, "size").columns and out.count() > 0
    assert mixing.materialised(empty(spark)).count() == 0


def test_first_words(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("  a b\tc  d ",)], "t string")
    got = [df.select(mixing.first_words("t", F.lit(n))).head()[0] for n in (1, 2, 4, 9)]
    assert got == ["  a", "  a b", "  a b\tc  d", "  a b\tc  d "]

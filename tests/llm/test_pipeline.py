import hashlib
import re
from collections import defaultdict

import pytest

import corpus_pipeline as C
from wireloom.llm import common, quality, secret_scan
from wireloom.llm.common import written

from .edge import DOCS, SCHEMA
from .test_mixing import slow_targets
from .test_mixing import size as words
from .test_simhash import slow_fingerprint, slow_groups


def test_every_stage_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.learned(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    kept = {r.doc_id: r.text for r in docs.collect() if model.score(quality.features(r.text)[None])[0] >= 0.3}
    columns = docs.columns
    seen = []
    for name, stage in C.STAGES:
        before, docs = docs, written(stage(spark, docs, sf), "t")
        seen.append(docs)
        if name != C.STAGES[-1][0]:
            assert docs.columns == columns, name
    one, two, three, four, five = seen
    assert {r.doc_id: r.text for r in one.collect()} == kept and len(kept) < 200
    low = slow_groups([(i, i, slow_fingerprint(t)) for i, t in kept.items()])
    assert {r.doc_id: r.text for r in two.collect()} == {i: t for i, t in kept.items() if low[i] == i}
    for r in three.collect():
        t, at = kept[r.doc_id], secret_scan.spans(kept[r.doc_id])
        assert r.text == secret_scan.mask(t, at) and r.n_chars == len(r.text) and (at or r.text == t)
        assert not [s for s in secret_scan.spans(r.text) if s[0] in ("access", "hex")]
    assert three.count() == two.count()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in three.collect():
        sizes[r.source] += words(r.text)
    for r in four.collect():
        taken[r.source] += words(r.text)
    want = slow_targets(sizes)
    assert all(abs(taken[s] - want[s]) < 1 + 1e-6 for s in sizes)
    copies = sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in four.collect())
    assert sorted((r.doc_id, r.decoded_sha256) for r in five.collect()) == copies
    assert re.fullmatch(r"[0-9a-f]{64}", five.head().ids_sha256)


def test_run_gives_the_last_stage(spark, sf):
    out = C.run(spark, sf)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns) and out.count() > 0


@pytest.fixture
def folder(spark, tmp_path):
    """A folder of the driver's tables with the awkward rows, or with none."""

    def made(rows):
        spark.createDataFrame(rows, SCHEMA.format(extra="taken")).write.parquet(f"{tmp_path}/documents.parquet")
        labels = [(1, 1, 0), (7, 0, 0), (8, 1, 0), (6, 0, 1)]
        spark.createDataFrame(labels if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
        return str(tmp_path)

    return made


def test_awkward_rows(spark, folder):
    """Nulls, empty and very long texts, ties, repeated rows and a column named like a result go through all stages."""
    sf = folder(DOCS)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in C.STAGES[:-1]:
        docs = written(stage(spark, docs, sf), "t")
        assert docs.columns == columns, name
    assert 0 < before and {r.doc_id for r in docs.collect()} <= {d[0] for d in DOCS}
    out = C.run(spark, sf).collect()
    assert sorted((r.doc_id, r.decoded_sha256) for r in out if r.doc_id) == sorted((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect() if r.doc_id)


def test_empty_tables(spark, folder):
    assert C.run(spark, folder([])).count() == 0


def test_superseded_stages_are_removed(spark, sf, monkeypatch):
    kept = []
    monkeypatch.setattr(C, "written", lambda df, tag: (kept.append(written(df, tag)), kept[-1])[1])
    out = C.run(spark, sf)
    there = [common._hadoop(spark, d._wireloom_path)[1].exists(common._hadoop(spark, d._wireloom_path)[0]) for d in kept]
    assert there == [False, False, False, True] and out.count() > 0

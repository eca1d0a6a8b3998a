import random

import xxhash

from wireloom.llm import simhash
from wireloom.llm.components import components

from .edge import docs, empty


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_groups(pairs):
    """{key: smallest id reachable} of (key, id, fingerprint) rows."""
    todo, out = list(pairs), []
    while todo:
        group, front = [], [todo.pop()]
        while front:
            x = front.pop()
            group.append(x)
            near = [y for y in todo if (x[2] ^ y[2]).bit_count() <= 3]
            todo = [y for y in todo if (x[2] ^ y[2]).bit_count() > 3]
            front += near
        low = min((g[1] for g in group if g[1] is not None), default=None)
        out += [(g[0], low) for g in group]
    return dict(out)


def check(df, rows):
    want = slow_groups([(i, r[0], slow_fingerprint(r[1])) for i, r in enumerate(rows)])
    expect = sorted(((r[0], f"{slow_fingerprint(r[1]):016x}", want[i]) for i, r in enumerate(rows)), key=repr)
    assert sorted(map(tuple, df.collect()), key=repr) == expect


def test_edge_cases(spark):
    df = docs(spark, "fingerprint")
    check(simhash.near_duplicates(df), [(r.doc_id, r.text) for r in df.collect()])
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_table_against_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    check(simhash.near_duplicates(df), [(r.doc_id, r.text) for r in df.collect()])


def test_links_lose_nothing(spark):
    """Random clusters, with blocks so small that every bucket is split."""
    draw = random.Random(4)
    fps = set()
    for _ in range(40):
        centre = draw.getrandbits(64)
        for _ in range(30):
            x = centre
            for b in draw.sample(range(64), draw.randint(0, 5)):
                x ^= 1 << b
            fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = slow_groups([(x, s, x) for x, s in zip(fps, signed)])
    for block, chain in ((2048, 2), (64, 2), (5, 2), (2048, 3), (3, 3)):
        got = {r.node: r.root for r in components(simhash.links(df, 3, block, chain)).collect()}
        for x, s in zip(fps, signed):
            assert got.get(s, s) == want[x]


def test_long_chains_on_a_table(spark, sf, monkeypatch):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted(map(tuple, simhash.near_duplicates(df).collect()))
    monkeypatch.setattr(simhash, "LONG_CHAIN", 1)
    assert sorted(map(tuple, simhash.near_duplicates(df).collect())) == want


def test_keep_one(spark):
    kept = simhash.keep_one(docs(spark))
    assert kept.columns == docs(spark).columns
    ids = [r.doc_id for r in kept.collect()]
    assert 2 not in ids and 4 not in ids and 5 not in ids and ids.count(1) == 2 and None in ids


def test_components_on_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[1000 + i] == 1000 for i in range(50)) and len(got) == 351

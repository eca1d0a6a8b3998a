import hashlib
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wireloom.llm import common, warc

TRAP = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:wireloom:page:666>\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"


def slow(rows):
    first = {}
    for i, (p, _, h) in enumerate(rows):
        raw = (h or "").encode()
        if len(raw) >= 100:
            key = (p is None, p or 0, rows[i][1] is None, rows[i][1] or "", i)
            if raw not in first or key < first[raw][0]:
                first[raw] = (key, i, p)
    out = []
    for i, (p, _, h) in enumerate(rows):
        raw = (h or "").encode()
        again = raw in first and first[raw][1] != i
        out.append((p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[raw][2] if again else None))
    return sorted(out, key=repr)


def round_trip(spark, df):
    folder = common.new_path(spark, "warc")
    warc.write(df, folder)
    return sorted(map(tuple, warc.resolved(warc.read(spark, folder)).collect()), key=repr)


SCHEMA = "page_id long, url string, html string, payload string"


def edge():
    rows = [(1, "http://a/", None), (2, None, ""), (3, "http://x\r\nWARC-Type: evil\r\n", "short"), (4, "u", "same " * 40), (9, "v", "same " * 40), (9, "v", "same " * 40)]
    rows += [(5, "é", "日本" * 60), (None, "n", "null id " * 30), (6, "w", "null id " * 30), (7, "t", TRAP), (8, "t", "x" * 90 + TRAP * 3 + "\r\n\r\n" + TRAP), (10, "t", TRAP * 3), (11, "t", TRAP * 3)]
    return rows + [(12, "big", "<p>" + "y" * 300_000), (13, "end", "ends in breaks\r\n\r\n\r\n\r\n"), (14, "http://x/" + "long" * 60_000, "after a long header"), (15, "z", "WARC/1.1\r\n" * 20)]


def test_edge_cases(spark):
    df = spark.createDataFrame([(*r, "clash") for r in edge()], SCHEMA)
    for n in (1, 4):
        assert round_trip(spark, df.repartition(n)) == slow(edge())
    assert round_trip(spark, spark.createDataFrame([], SCHEMA)) == []


def test_small_chunks_and_many_hops(spark, monkeypatch):
    """Chunks smaller than most records; claims and records then run in this process."""
    folder = common.new_path(spark, "warc")
    warc.write(spark.createDataFrame([(*r, "x") for r in edge() * 3], SCHEMA).coalesce(1), folder)
    path, size = next((r.path, r.length) for r in spark.read.format("binaryFile").load(folder).select("path", "length").collect() if r.length)
    fs, at = common.file_system(path)
    data = fs.open_input_file(at).read()
    monkeypatch.setattr(warc, "CHUNK", 700)
    batch = [pa.RecordBatch.from_pydict({"p": [path], "n": [size], "lo": [lo]}) for lo in range(0, size, 700)]
    claims = {r["off"]: r["out"] for b in warc._claims(batch) for r in b.to_pylist()}
    at, want = 0, []
    while at < size:
        want.append(at)
        at = warc.header(data, at).next
    hops, at = [], 0
    while at in claims:
        hops.append(at)
        at = claims[at]
    assert set(hops) <= set(want) and len(hops) > 5
    records = [r["off"] for b in warc._records([pa.RecordBatch.from_pydict({"p": [path], "n": [size], "o": [o]}) for o in hops]) for r in b.to_pylist()]
    assert sorted(records) == want
    files = spark.createDataFrame([(path, size)], "path string, length long")
    monkeypatch.setattr(warc, "_chunks", lambda f: spark.createDataFrame([(path, size, lo) for lo in range(0, size, 8 << 20)], "path string, length long, lo long"))
    assert [r.off for r in warc.entries(files).collect()] == [0]


def test_pointer_doubling_reaches_far(spark, monkeypatch):
    """A chain of 300 chunks, with claims beside it that nothing true leads to."""
    claims = [("f", i * 10, (i + 1) * 10) for i in range(300)] + [("f", 5 + 10 * i, 15 + 10 * i) for i in range(50)]
    monkeypatch.setattr(warc, "_chunks", lambda f: spark.range(1).select(F.lit("f").alias("path")))
    table = spark.createDataFrame(claims, "path string, off long, out long")
    monkeypatch.setattr(warc.common, "written", lambda df, tag: spark.createDataFrame(table.collect() if tag == "warc-claims" else df.collect(), table.schema if tag == "warc-claims" else df.schema))
    got = sorted(r.off for r in warc.entries(spark.createDataFrame([("f", 3000)], "path string, length long")).collect())
    assert got == [i * 10 for i in range(300)]


def plainly(data, lo, hi):
    """Every hit's header by itself."""
    out, at = [], data.find(warc.MAGIC, lo)
    while 0 <= at < hi:
        if h := warc.header(data, at):
            out.append((at, h.next))
        at = data.find(warc.MAGIC, at + 1)
    return out


PIECES = [b"WARC/1.1\r\n", b"X: WARC/1.1\r\n", b"Content-Length: 7\r\n", b"content-length : 12\r\n", b"Content-Length: x\r\n", b"a: b\r\n", b"no field\r\n", b"\r\n", b"\r\n\r\n", b"\r", b"\n", b"word", b"c:" + b"y" * 90 + b"\r\n"]


def test_candidates_are_what_every_hit_s_header_says(monkeypatch):
    """Random bytes out of what headers are made of, cut into chunks anywhere."""
    draw = random.Random(8)
    monkeypatch.setattr(warc, "AHEAD", 60)
    for _ in range(400):
        data = b"".join(draw.choices(PIECES, k=draw.randint(1, 60)))
        lo = draw.randrange(len(data))
        hi = draw.randint(lo, len(data))
        got = warc.candidates(pa.BufferReader(data), lo, hi, len(data))
        assert got == plainly(data, lo, hi), (data, lo, hi)


@pytest.mark.parametrize("trap", [b"WARC/1.1\r\n", b"WARC/1.1\r\nContent-Length: 5\r\n", b"WARC/1.1\r\na: WARC/1.1\r\nb: ", b"a:WARC/1.1\r\n", b"WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n", b"WARC/1.1\r\n" + b"z" * 4000])
@pytest.mark.parametrize("behind", [b"", b"\r\n\r\n"])
def test_megabytes_of_magic_lines_take_linear_time(trap, behind):
    data = trap * ((12 << 20) // len(trap)) + behind
    began = time.process_time()
    for lo in range(0, len(data), warc.CHUNK):
        warc.candidates(pa.BufferReader(data), lo, min(len(data), lo + warc.CHUNK), len(data))
    assert time.process_time() - began < 40


def test_payload_of_eight_megabytes_of_magic_lines(spark):
    rows = [(1, "a", "WARC/1.1\r\n" * 800_000), (2, "b", TRAP * 30_000), (3, "c", "after"), (4, "d", "WARC/1.1\r\nb: c\r\n" * 400_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).coalesce(1)
    assert round_trip(spark, df) == slow(rows)


def test_tasks_are_packed(spark):
    cores = spark.sparkContext.defaultParallelism
    assert [warc._tasks(spark, n) for n in (0, 1, 5, 10**3, 10**7)] == [1, 1, 5, max(2 * cores, 10**3 // 32), 20 * cores]


def test_table(spark, sf):
    df = spark.read.parquet(f"{sf}/pages.parquet")
    assert round_trip(spark, df) == slow([(r.page_id, r.url, r.html) for r in df.collect()])

import random

from pyspark.sql import functions as F

from wireloom.operators import alerts, correlate, flows, reassembly
from wireloom.operators.decode import decode
from wireloom.streaming import stateful

from . import wire as w
from .test_alerts import SCHEMA as EVENTS
from .test_alerts import event


def frames(n=120, seed=3):
    draw, out = random.Random(seed), []
    for i in range(n):
        flags, body = draw.choice([(0x10, b"abcd"), (0x18, b"xy"), (0x02, b""), (0x12, b""), (0x11, b""), (0x04, b"")]) if i % 3 else (0x18, b"data")
        port, there = 5000 + draw.randrange(3), draw.random() < 0.6
        if i % 7 == 0:
            d = w.dns(draw.randrange(4), answers=w.rr(1, b"\1\2\3\4"), n=1, response=not there)
            out.append(w.eth(0x0800, w.ip4(17, w.udp(port, 53, d)) if there else w.ip4(17, w.udp(53, port, d), "192.168.1.1", "10.0.0.1")))
            continue
        seq = 1000 + draw.randrange(30)
        out.append(w.eth(0x0800, w.ip4(6, w.tcp(port, 80, flags, body, seq, 1010)) if there else w.ip4(6, w.tcp(80, port, flags, body, seq, 1010), "192.168.1.1", "10.0.0.1")))
    return out


def parts(spark, rows, schema, tmp_path, n=3):
    """A stream that brings the rows in order, a few files after one another."""
    folder = tmp_path / "in"
    size = -(-len(rows) // n)
    for i in range(n):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(f"{folder}/p{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def run(spark, stream, tmp_path):
    out = str(tmp_path / "out")
    q = stateful.to_tables(stream, out, str(tmp_path / "checkpoint"))
    q.awaitTermination(300)
    assert list(stateful.heartbeats(q))
    return spark.read.parquet(out)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_flows_stream_equals_batch(spark, tmp_path):
    raw = w.rows(*frames())
    batch = flows.annotated(flows.flow_packets(decode(spark.createDataFrame(raw, w.RAW))))
    stream = stateful.annotated(flows.flow_packets(decode(parts(spark, raw, w.RAW, tmp_path))))
    assert rows(run(spark, stream, tmp_path)) == rows(batch) and batch.filter("closes").count() > 3


def test_dns_stream_equals_batch(spark, tmp_path):
    raw = w.rows(*frames(200, 5))
    batch = correlate.dns_pairs(decode(spark.createDataFrame(raw, w.RAW)))
    stream = stateful.dns_pairs(decode(parts(spark, raw, w.RAW, tmp_path)))
    assert rows(run(spark, stream, tmp_path)) == rows(batch) and batch.count() > 3


def test_volume_stream_equals_batch(spark, tmp_path):
    config = alerts.AlertConfig(volume_interval_ms=3000)
    data = [event(i, up=i * 7 % 90, exe=f"/bin/{i % 3}") for i in range(90)]
    batch = alerts.volume_samples(spark.createDataFrame(data, EVENTS), config)
    stream = stateful.volume_samples(parts(spark, data, EVENTS, tmp_path), config)
    assert rows(run(spark, stream, tmp_path)) == rows(batch) and batch.count() > 10


def test_cooldown_stream_equals_batch(spark, tmp_path):
    config = alerts.AlertConfig(cooldown_ms=60)
    data = [(i, 1, "k", "info", i * 17, 1, 1, "ab"[i % 2], "t", "{}") for i in range(60)]
    batch = alerts.emitted(spark.createDataFrame(data, alerts.ALERT), config)
    assert rows(run(spark, stateful.emitted(parts(spark, data, alerts.ALERT, tmp_path), config), tmp_path)) == rows(batch)


def test_firsts_stream(spark, tmp_path):
    data = [(i, f"k{i % 5}") for i in range(40)]
    got = run(spark, stateful.firsts(parts(spark, data, "seq long, k string", tmp_path), ["k"], "seq long, k string"), tmp_path)
    assert rows(got) == [(i, f"k{i}") for i in range(5)]


def test_reassembly_stream(spark, tmp_path):
    raw = w.rows(*frames())
    pick = lambda df: reassembly.segments(decode(df))
    batch = {tuple(r[:6]): bytes(r.bytes) for r in reassembly.streams(pick(spark.createDataFrame(raw, w.RAW))).collect() if r.bytes}
    got = run(spark, stateful.reassembled(pick(parts(spark, raw, w.RAW, tmp_path))), tmp_path)
    joined = {}
    for r in got.orderBy("number").collect():
        joined[tuple(r[:6])] = joined.get(tuple(r[:6]), b"") + bytes(r.bytes)
    assert joined == batch


def test_marked_packets(spark):
    packets = decode(w.frame(spark, *frames(40)))
    notes = flows.annotated(flows.flow_packets(packets))
    got = flows.marked(packets, notes)
    again = {r.number for r in notes.filter("retransmission").collect()}
    assert again == {r.number for r in got.filter(F.col("summary.info").startswith("[Retransmission] TCP") | F.col("summary.info").startswith("[Retransmission] ")).collect()}
    assert all(r.summary.color_hint == "Retransmission" for r in got.filter("retransmission").collect())

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from wireloom.operators import flows, reassembly

from .wire import T0

SCHEMA = "number long, ts timestamp, wire_len long, src_ip binary, src_port int, dst_ip binary, dst_port int, protocol int, seq long, ack long, payload_len long, syn boolean, ack_flag boolean, fin boolean, rst boolean"
A, B = bytes([10, 0, 0, 1]), bytes([192, 168, 1, 1])


def packet(n, out=True, seq=1000, plen=0, flags="", ack=0, ms=None, proto=6, port=5000):
    ends = (A, port, B, 80) if out else (B, 80, A, port)
    return (n, T0 + dt.timedelta(milliseconds=n if ms is None else ms), 100, *ends, proto, seq, ack, plen, "S" in flags, "A" in flags, "F" in flags, "R" in flags)


def notes(spark, rows):
    return flows.annotated(flows.keyed(spark.createDataFrame(rows, SCHEMA).repartition(3)))


def got(spark, rows, *columns):
    return [tuple(r) for r in notes(spark, rows).orderBy("number").select(*columns).collect()]


def test_retransmission(spark):
    rows = [packet(0, seq=1000, plen=100), packet(1, seq=1100, plen=200), packet(2, seq=1000, plen=100), packet(3, False, seq=1000, plen=100)]
    assert got(spark, rows, "retransmission") == [(False,), (False,), (True,), (False,)]


def test_close_and_trailing_ack(spark):
    rows = [packet(0, plen=5), packet(1, flags="FA"), packet(2, False, flags="FA"), packet(3, flags="A"), packet(4, flags="R"), packet(5)]
    assert got(spark, rows, "incarnation", "closes", "first_seen") == [(1, False, True), (1, False, False), (1, True, False), (2, False, True), (2, True, False), (3, False, True)]


def test_accounting(spark):
    rows = [packet(0), packet(1, False), packet(2)]
    r = flows.flow_table(notes(spark, rows), [A]).head()
    assert (r.bytes_up, r.pkts_up, r.bytes_down, r.pkts_down, r.closed) == (200, 2, 100, 1, False)
    r = flows.flow_table(notes(spark, rows), [B]).head()
    assert (r.bytes_up, r.pkts_up, bytes(r.local_ip)) == (100, 1, B)
    assert flows.completed(flows.flow_table(notes(spark, rows))).count() == 0 and flows.live(flows.flow_table(notes(spark, rows))).count() == 1


def test_handshake_and_smoothed_rtt(spark):
    rows = [packet(0, flags="S", ms=0), packet(1, False, flags="SA", ms=20), packet(2, seq=1000, plen=10, ms=30), packet(3, False, flags="A", ack=1010, ms=40), packet(4, seq=1010, plen=10, ms=50), packet(5, False, flags="A", ack=1020, ms=70)]
    assert got(spark, rows, "handshake_rtt_ms", "srtt_ms")[-1] == (20.0, 10 * 0.875 + 20 * 0.125)


def test_udp_never_closes(spark):
    rows = [packet(i, proto=17, plen=None, seq=None, ack=None) for i in range(3)]
    assert got(spark, rows, "incarnation", "closes", "retransmission") == [(1, False, False)] * 3


def test_address_order(spark):
    six = bytes(15) + b"\1"
    rows = [(0, T0, 1, six, 5, bytes([250, 0, 0, 1]), 9, 6, 0, 0, 0, False, False, False, False), (1, T0, 1, A, 9, A, 5, 6, 0, 0, 0, False, False, False, False)]
    r = flows.keyed(spark.createDataFrame(rows, SCHEMA)).orderBy("number").collect()
    assert bytes(r[0].low_ip) == bytes([250, 0, 0, 1]) and not r[0].low_to_high and (r[1].low_port, r[1].high_port) == (5, 9)


class Slow:
    """The plain sequential model of one connection table."""

    def __init__(self):
        self.table, self.count = {}, {}

    def see(self, p):
        n, ts, _, si, sp, di, dp, proto, seq, ack, plen, syn, ackf, fin, rst = p
        out = (si, sp) <= (di, dp)
        key = (min((si, sp), (di, dp)), max((si, sp), (di, dp)), proto)
        if key not in self.table:
            self.count[key] = self.count.get(key, 0) + 1
            self.table[key] = {"fin": set(), "max": {}, "un": {True: {}, False: {}}, "syn": None, "rtt": None, "srtt": None}
        s = self.table[key]
        again = False
        if plen > 0:
            if out in s["max"] and seq + plen <= s["max"][out]:
                again = True
            else:
                s["max"][out] = seq + plen
        if syn and not ackf:
            s["syn"] = s["syn"] or ts
        elif syn and s["rtt"] is None and s["syn"] and ts >= s["syn"]:
            s["rtt"] = (ts - s["syn"]) / dt.timedelta(microseconds=1) / 1000
        if plen > 0:
            s["un"][out].setdefault((seq + plen) % 2**32, ts)
            if len(s["un"][out]) > 256:
                del s["un"][out][min(s["un"][out])]
        if ackf:
            for k in sorted(k for k in s["un"][not out] if k <= ack):
                at = s["un"][not out].pop(k)
                if ts >= at:
                    x = (ts - at) / dt.timedelta(microseconds=1) / 1000
                    s["srtt"] = x if s["srtt"] is None else s["srtt"] * 0.875 + x * 0.125
        if fin:
            s["fin"].add(out)
        closes = rst or len(s["fin"]) == 2
        if closes:
            del self.table[key]
        return (n, self.count[key], again, closes, s["rtt"], s["srtt"])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_sequences_against_the_model(spark, seed):
    draw = random.Random(seed)
    rows, model = [], Slow()
    for n in range(900):
        rows.append(packet(n, draw.random() < 0.5, 1000 + 10 * draw.randrange(60), draw.choice([0, 10, 20]), draw.choice(["", "A", "A", "A", "S", "SA", "FA", "R"] if n % 3 else ["A"]), 1000 + 10 * draw.randrange(60), n * 7 - draw.randrange(30), port=5000 + draw.randrange(4)))
    want = [model.see(p) for p in rows]
    assert got(spark, rows, "number", "incarnation", "retransmission", "closes", "handshake_rtt_ms", "srtt_ms") == want


def test_many_unacked_segments():
    u = flows.Unacked()
    for i in range(300):
        u.sent(i, i)
    u.sent(299, 7)
    assert len(u.ends) == 256 and u.acked(100) == list(range(44, 101)) and u.acked(100) == []


def test_closed_form_of_retransmissions(spark):
    rows = [packet(n, bool(n % 3), 1000 + 10 * (n * 37 % 50), 10, "R" if n % 60 == 59 else "") for n in range(400)]
    base = flows.keyed(spark.createDataFrame(rows, SCHEMA)).select("number", "seq", "payload_len")
    x = notes(spark, rows).join(base, "number").withColumn("again", flows.retransmitted(None))
    assert x.filter(F.col("again") != F.col("retransmission")).count() == 0


# --- reassembly ------------------------------------------------------------


def stream(*parts):
    s = reassembly.Stream()
    return s, [s.insert(q, d) for q, d in parts]


def test_reassembly_vectors():
    s, r = stream((1000, b"AAA"), (1006, b"CCC"))
    assert s.drain() == b"AAA" and r == ["contiguous", "gap"]
    s.insert(1003, b"BBB")
    assert s.drain() == b"BBBCCC" and s.drain() is None
    s, r = stream((1000, b"hello"), (1000, b"hello"), (1003, b"lop"))
    assert r == ["contiguous", "duplicate", "contiguous"] and s.drain() == b"hellop"
    s, _ = stream((0xFFFFFFFE, b"AB"), (0, b"CD"))
    assert s.drain() == b"ABCD"
    s, r = stream((0, b"x" * (1 << 20)), (1 << 20, b"y"))
    assert r == ["contiguous", "capped"] and s.capped
    s, r = stream((10, b"ab"), (5, b"ab"), (10, b""), (20, b"z"), (20, b"q"))
    assert r == ["contiguous", "duplicate", "buffered", "gap", "duplicate"] and not s.complete
    s.fin = True
    assert not s.complete


def test_overlapped_waiting_segment_is_never_taken():
    s, _ = stream((0, b"ab"), (4, b"ef"), (2, b"cdXY"))
    assert bytes(s.ready) == b"abcdXY" and s.waiting == {4: b"ef"}


def test_followed_streams(spark):
    from wireloom.operators.decode import decode

    from . import wire as w

    f = lambda out, seq, body: w.eth(0x0800, w.ip4(6, w.tcp(5, 80, body=body, seq=seq)) if out else w.ip4(6, w.tcp(80, 5, body=body, seq=seq), "192.168.1.1", "10.0.0.1"))
    packets = decode(w.frame(spark, f(True, 10, b"GET"), f(False, 90, b"HT"), f(True, 16, b"!"), f(True, 13, b" / "), f(False, 92, b"TP")))
    r = reassembly.followed(reassembly.segments(packets)).head()
    assert (bytes(r.client), bytes(r.server)) == (b"GET / !", b"HTTP")

from pyspark.sql import functions as F

from wireloom.functions import detail
from wireloom.operators import alerts, flows, monitor, stats, store
from wireloom.operators.decode import decode

from . import wire as w

HOST = bytes([10, 0, 0, 1])


def out(port, flags=0x10, body=b"", dst="8.8.4.4"):
    return w.eth(0x0800, w.ip4(6, w.tcp(port, 443, flags, body), "10.0.0.1", dst))


def back(port, flags=0x10, src="8.8.4.4"):
    return w.eth(0x0800, w.ip4(6, w.tcp(443, port, flags), src, "10.0.0.1"))


def events(spark):
    frames = [out(5000, 0x02), back(5000, 0x12), out(5000, 0x18, w.hello("www.example.com")), out(5000, 0x11), back(5000, 0x11), out(5000), back(6000, 0x02)]
    packets = decode(w.frame(spark, *frames))
    sockets = spark.createDataFrame([(w.T0, 6, bytearray(HOST), 5000, 42, "curl", "/usr/bin/curl")], "ts timestamp, protocol int, addr binary, port int, pid long, name string, exe_path string")
    land = spark.createDataFrame([(bytearray([8, 8, 0, 0]), bytearray([8, 8, 255, 255]), "US")], "start_ip binary, end_ip binary, country string")
    net = spark.createDataFrame([(bytearray([8, 8, 4, 0]), bytearray([8, 8, 4, 255]), 15169, "Example Net")], "start_ip binary, end_ip binary, asn long, as_org string")
    ids = spark.createDataFrame([("/usr/bin/curl", "Sha256", "h1", None, None, None, "Unsigned")], "path string, kind string, value string, signing_id string, team_id string, authority string, status string")
    return packets, monitor.flow_events(packets, [HOST], sockets, land, net, ids)


def test_the_whole_chain(spark):
    packets, e = events(spark)
    rows = e.orderBy("seq").collect()
    assert [r.name for r in rows] == [None, None, *["www.example.com"] * 5]
    assert [(r.id, r.incarnation, r.outbound) for r in rows] == [(0, 1, True)] * 5 + [(5, 2, True), (6, 1, False)]
    assert [r.bytes_up > 0 for r in rows] == [True, False, True, True, False, True, False] and all(r.bytes_up + r.bytes_down > 0 for r in rows)
    assert [r.exe for r in rows] == ["/usr/bin/curl"] * 6 + [None] and rows[0].identity.value == "h1" and rows[6].identity is None
    assert {(r.dest_ip, r.country, r.asn, r.as_org) for r in rows} == {("8.8.4.4", "US", 15169, "Example Net")}
    got = alerts.alerts(e, alerts.AlertConfig(learn_ms=0)).collect()
    assert [(r.seq, r.kind) for r in got] == [(0, "new_process_egress"), (0, "new_process_dest"), (0, "new_geo"), (0, "new_geo")]
    table = flows.flow_table(flows.annotated(flows.flow_packets(packets)), [HOST])
    c = store.connections(table, e).collect()
    assert [(r.id, r.process_id, r.dest_id, r.name, r.local_port, r.remote_port) for r in c] == [(4, 1, 1, "www.example.com", 5000, 443)]
    live = {r.id: (r.process, r.dest_name, r.bytes_up) for r in stats.live_connections(monitor.live_rows(e)).collect()}
    assert live[6][0] == "?" and live[0][:2] == ("curl", "www.example.com")


def test_without_any_tables(spark):
    e = monitor.flow_events(decode(w.frame(spark, out(1), w.eth(0x0800, w.ip4(17, w.udp(5, 6))))))
    assert [(r.exe, r.country, r.outbound) for r in e.collect()] == [(None, None, True)] * 2 and alerts.alerts(e).count() == 0


def test_detail_lines(spark):
    answers = w.rr(1, b"\1\2\3\4") + w.rr(5, b"\1a\xc0\x0c") + w.rr(15, b"\0\5\xc0\x0c") + w.rr(16, b"\2hi") + w.rr(33, b"\0\1\0\2\0\3\xc0\x0c") + w.rr(99, b"")
    frames = [
        w.eth(0x0800, w.ip4(6, w.tcp(5, 443, 0x18, w.hello("a.b", ("h2",))))), w.eth(0x0800, w.ip4(17, w.udp(53, 9, w.dns(answers=answers, n=6, response=True)))),
        w.eth(0x0806, bytes.fromhex("0001080006040001001122334455c0a80101000000000000c0a80102")), w.eth(0x86DD, w.ip6(58, b"\x80\0" + bytes(6))), w.eth(0x0800, w.ip4(6, w.tcp(5, 80, body=b"GET /x HTTP/1.1\r\nHost: h\r\n\r\n"))), b"",
    ]
    packets = decode(w.frame(spark, *frames))
    got = {r.number: r.d for r in packets.select("number", detail.lines(packets).alias("d")).collect()}
    assert got[0][0] == "▸ Ethernet II, Src: 11:22:33:44:55:66, Dst: aa:bb:cc:dd:ee:ff" and "    Type: 0x0800" in got[0] and "    Header Length: 20 bytes (5)" in got[0] and "    Protocol: TCP (6)" in got[0]
    assert "    Flags: [ACK, PSH]" in got[0] and "    Server Name: a.b" in got[0] and "    ALPN: h2" in got[0] and got[0][-1].startswith("▸ Data (") and any(x.startswith("    JA4: t12d") for x in got[0])
    assert "▸ DNS Response (0xabcd)" in got[1] and "    Question: example.com (type=A)" in got[1]
    assert [x for x in got[1] if "Answer" in x] == [f"    Answer: example.com → {x}" for x in ("A 1.2.3.4", "CNAME a.example.com", "MX 5 example.com", "TXT hi", "SRV example.com:3", "type99")]
    assert "▸ ARP (Request)" in got[2] and "    Target IP: 192.168.1.2" in got[2] and "▸ ICMPv6, Type: 128, Code: 0" in got[3] and "    Next Header: ICMPv6 (58)" in got[3]
    assert "▸ HTTP GET /x" in got[4] and "    Host: h" in got[4] and got[5] == []
    assert packets.select(F.size(detail.lines(packets)).alias("n")).filter("n < 0").count() == 0

import random

from pyspark.sql import functions as F

from wireloom.functions import bytes as b
from wireloom.functions import text as t
from wireloom.operators import anomaly, correlate, diff, stats
from wireloom.operators.decode import decode

from . import wire as w

ADDRESSES = ["0.0.0.0", "10.1.2.3", "172.16.0.1", "172.32.0.1", "192.168.1.1", "127.0.0.1", "169.254.1.1", "192.0.2.1", "198.51.100.7", "203.0.113.9", "255.255.255.255", "224.0.0.1", "239.1.1.1", "240.0.0.1", "100.64.0.1", "8.8.8.8"]
SIXES = ["::", "::1", "ff02::1", "fe80::1", "febf::1", "fec0::1", "fc00::1", "fdff::1", "fe00::1", "2001:db8::1", "2001:0:0:1:0:0:0:1", "1:0:0:2:3:0:0:4", "0:1:2:3:4:5:6:7", "1:2:3:4:5:6:7:0", "1:2:3:4:5:6:0:0", "::ffff:1.2.3.4", "64:ff9b::102:304"]


def test_addresses(spark):
    import ipaddress as ip

    packed = [ip.ip_address(x).packed for x in ADDRESSES + SIXES]
    df = spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(packed)], "i int, ip binary")
    got = {r.i: (r.x, r.g) for r in df.select("i", b.ip_text(F.col("ip")).alias("x"), b.is_global(F.col("ip")).alias("g")).collect()}
    never = {"0.0.0.0", "10.1.2.3", "172.16.0.1", "192.168.1.1", "127.0.0.1", "169.254.1.1", "192.0.2.1", "198.51.100.7", "203.0.113.9", "255.255.255.255", "224.0.0.1", "239.1.1.1", "::", "::1", "ff02::1", "fe80::1", "febf::1", "fc00::1", "fdff::1"}
    for i, x in enumerate(ADDRESSES + SIXES):
        assert got[i] == (str(ip.ip_address(x)), x not in never), x
    back = df.select("i", F.when(F.length("ip") == 16, correlate.ipv6_bytes(b.ip_text(F.col("ip")))).otherwise(b.ipv4_bytes(b.ip_text(F.col("ip")))).alias("p")).collect()
    assert all(bytes(r.p) == packed[r.i] for r in back)
    order = [r.i for r in df.orderBy(b.ip_order(F.col("ip"))).collect()]
    assert order == sorted(range(len(packed)), key=lambda i: (len(packed[i]), packed[i]))


def test_texts(spark):
    names = {"api.github.com": "github.com", "github.com": "github.com", "a.b.co.uk": "b.co.uk", "co.uk": "co.uk", "localhost": "localhost", "x.y.z..": "y.z", "": ""}
    df = spark.createDataFrame([(k,) for k in names], "n string")
    assert {r.n: r.d for r in df.select("n", t.registrable_domain(F.col("n")).alias("d")).collect()} == names
    sizes = {0: "0B", 1023: "1023B", 1024: "1.0K", 1280: "1.2K", 1792: "1.8K", 1 << 20: "1.0M", 5 << 30: "5.0G", 5 << 40: "5120.0G"}
    df = spark.createDataFrame([(k,) for k in sizes], "n long")
    assert {r.n: r.s for r in df.select("n", t.byte_size(F.col("n")).alias("s")).collect()} == sizes
    raw = bytes(range(20)) + b"A\r\n\t\xff"
    r = spark.createDataFrame([(bytearray(raw),)], "d binary").select(t.hex_dump(F.col("d")).alias("h"), t.printable(F.col("d")).alias("p")).head()
    assert r.h == ["0000   00 01 02 03 04 05 06 07  08 09 0a 0b 0c 0d 0e 0f   ................", "0010   10 11 12 13 41 0d 0a 09  ff " + " " * 21 + "  ....A...."]
    assert r.p == "." * 9 + "\t\n" + ".." + " " + "." * 6 + "A \n\t."
    r = spark.createDataFrame([(1, -5)], "a long, b long").select(b.serial_less(F.lit(4294967290), F.lit(5)).alias("x"), b.serial_less(F.lit(5), F.lit(4294967290)).alias("y"), t.day_and_time(F.lit(1704067200123)).alias("z")).head()
    assert (r.x, r.y, r.z) == (True, False, "2024-01-01 00:00:00")


def response(txid, asked, ip):
    return w.eth(0x0800, w.ip4(17, w.udp(53, 5000, w.dns(txid, asked, w.rr(1, bytes(map(int, ip.split(".")))), 1, True))))


def test_names_as_of(spark):
    frames = [
        w.eth(0x0800, w.ip4(6, w.tcp(5, 80, body=b"GET / HTTP/1.1\r\nHost: low\r\n\r\n"), dst="1.1.1.1")),
        response(1, "one.com", "1.1.1.1"),
        w.eth(0x0800, w.ip4(6, w.tcp(5, 80, body=b"GET / HTTP/1.1\r\nHost: late\r\n\r\n"), dst="1.1.1.1")),
        w.eth(0x0800, w.ip4(6, w.tcp(5, 443, body=w.hello("two.com")), dst="1.1.1.1")),
        response(2, "six.com", "2.2.2.2"),
    ]
    seen = correlate.name_observations(decode(w.frame(spark, *frames)))
    assert seen.count() == 5
    ips = {"1.1.1.1": bytes([1] * 4), "2.2.2.2": bytes([2] * 4)}
    events = spark.createDataFrame([(n, bytearray(ips[i])) for n in range(5) for i in ips] + [(9, None)], "number long, ip binary")
    got = {(r.number, bytes(r.ip) if r.ip else None): r.name for r in correlate.name_as_of(events, seen).collect()}
    assert [got[n, ips["1.1.1.1"]] for n in range(5)] == ["low", "one.com", "one.com", "two.com", "two.com"]
    assert got[3, ips["2.2.2.2"]] is None and got[4, ips["2.2.2.2"]] == "six.com" and got[9, None] is None
    now = {bytes(r.ip): (r.name, r.source) for r in correlate.current_names(seen).collect()}
    assert now == {ips["1.1.1.1"]: ("two.com", "tls_sni"), ips["2.2.2.2"]: ("six.com", "dns")}


def test_dns_pairs_against_a_pending_table(spark):
    draw = random.Random(5)
    frames, want, pending = [], [], {}
    for n in range(300):
        tx = draw.randrange(6)
        if draw.random() < 0.5:
            frames.append(w.eth(0x0800, w.ip4(17, w.udp(5000, 53, w.dns(tx)))))
            pending[tx] = n
        else:
            frames.append(response(tx, "a.b", "9.8.7.6"))
            if tx in pending:
                q = pending.pop(tx)
                want.append((n, q, (n - q) * 1000.0, "9.8.7.6"))
    got = correlate.dns_pairs(decode(w.frame(spark, *frames))).orderBy("number").collect()
    assert [tuple(r) for r in got] == want


def test_ranges_over_prefixes_and_versions(spark):
    import ipaddress as ip

    raw = [("1.0.0.0", "3.0.0.255", "AA"), ("3.0.1.0", "3.0.1.0", "BB"), ("9.9.9.9", "9.9.9.10", "CC"), ("2001:db8::", "2001:db8::ffff", "DD")]
    ranges = spark.createDataFrame([(bytearray(ip.ip_address(a).packed), bytearray(ip.ip_address(z).packed), c) for a, z, c in raw], "start_ip binary, end_ip binary, country string")
    ask = {"0.255.255.255": None, "1.0.0.0": "AA", "2.5.5.5": "AA", "3.0.0.255": "AA", "3.0.1.0": "BB", "3.0.1.1": None, "9.9.9.10": "CC", "2001:db8::5": "DD", "2001:db8::1:0": None, "10.0.0.1": None}
    rows = spark.createDataFrame([(k, bytearray(ip.ip_address(k).packed)) for k in ask] + [("none", None)], "k string, ip binary")
    got = {r.k: r.country for r in correlate.located(rows, "ip", ranges).collect()}
    assert got == ask | {"none": None}
    assert correlate.located(rows, "ip").select("country", "asn", "as_org").distinct().collect() == [(None, None, None)]


def test_source_owner(spark):
    from .wire import T0

    a = bytearray([10, 0, 0, 1])
    sockets = spark.createDataFrame([(T0, 6, a, 5000, 1, "one", None), (T0, 6, a, 80, 2, "two", "/x")], "ts timestamp, protocol int, addr binary, port int, pid long, name string, exe_path string")
    rows = spark.createDataFrame([(0, T0, a, 5000, 80, 6), (1, T0, a, 9, 80, 6), (2, T0, a, 9, 9, 6)], "number long, ts timestamp, src_ip binary, src_port int, dst_port int, protocol int")
    assert [(r.number, r.pid, r.exe_path) for r in correlate.source_owner(rows, sockets).orderBy("number").collect()] == [(0, 1, None), (1, 2, "/x"), (2, None, None)]


def test_anomalies(spark):
    basic = b"GET / HTTP/1.1\r\nAUTHORIZATION: BASIC abc\r\n\r\n"
    plain = b"GET / HTTP/1.1\r\nHost: h\r\n\r\n"
    frames = [(80, basic), (1337, basic), (1337, plain), (80, plain), (21, b"xx pAsS y"), (22, b"PASS x"), (1337, w.hello("a")), (21, b"PASSx")]
    got = anomaly.annotated(decode(w.frame(spark, *[w.eth(0x0800, w.ip4(6, w.tcp(50000, p, body=d))) for p, d in frames]))).orderBy("number").collect()
    assert [r.anomaly and (r.anomaly.kind, r.anomaly.severity) for r in got] == [("PlaintextCredential", "Warning"), ("PlaintextCredential", "Warning"), ("UnusualPort", "Info"), None, ("PlaintextCredential", "Warning"), None, None, None]
    assert got[2].anomaly.detail == "cleartext HTTP on unusual port 1337"


def test_diff(spark):
    rows = lambda *d: spark.createDataFrame([(i, bytearray([x])) for i, x in enumerate(d)], "number long, data binary")
    one, two = rows(1, 2, 3), rows(2, 3, 4)
    assert diff.common(one, two).head()[0] == 2 and sorted(map(tuple, diff.difference(one, two).collect())) == [("a", 0), ("b", 2)]
    draw = random.Random(2)
    x, y = [draw.randrange(5) for _ in range(60)], [draw.randrange(6) for _ in range(50)]
    want, left = [], [x.count(v) for v in range(6)]
    for side, m, o in (("a", x, y), ("b", y, x)):
        left = {v: o.count(v) for v in range(6)}
        for i, v in enumerate(m):
            if left[v]:
                left[v] -= 1
            else:
                want.append((side, i))
    assert sorted(map(tuple, diff.difference(rows(*x), rows(*y)).collect())) == sorted(want)
    assert diff.common(one, rows()).head()[0] == 0 and diff.report(rows(*range(50)), rows()).count() == 20


def test_views(spark):
    frames = [w.eth(0x0800, w.ip4(6, w.tcp(5, 80))), w.eth(0x0800, w.ip4(6, w.tcp(80, 5), "192.168.1.1", "10.0.0.1")), w.eth(0x0800, w.ip4(17, w.udp(1, 2), "10.0.0.9", "10.0.0.9"))]
    packets = decode(w.frame(spark, *frames)).cache()
    talk = {r.endpoint: r.packets for r in stats.top_talkers(packets).collect()}
    assert talk == {"10.0.0.1": 2, "192.168.1.1": 2, "10.0.0.9": 2}
    f = stats.flow_view(packets).collect()
    assert [(r.label, r.packets) for r in f] == [("10.0.0.1:5 <-> 192.168.1.1:80", 2), ("10.0.0.9:1 <-> 10.0.0.9:2", 1)]
    bars = stats.timeline(stats.flow_view(packets)).collect()
    assert [(r.bar_start, r.bar_length) for r in bars] == [(0, 20), (40, 1)] and bars[0].bar == "▇" * 20
    assert [r.packets for r in stats.throughput(packets).collect()] == [1, 1, 1] and stats.throughput(packets, 2).count() == 2
    assert stats.throughput(packets.limit(0)).count() == 0
    assert [r.number for r in stats.last_packets(packets, 2).orderBy("number").collect()] == [1, 2] and stats.one_shot(packets, 2).count() == 2 and stats.one_shot(packets, None, 1.5).count() == 2
    assert stats.bookmarked(packets, []).count() == 0

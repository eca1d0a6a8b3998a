import json
import struct

import pytest
from pyspark.sql import functions as F

from wireloom.operators.decode import decode
from wireloom.sources import capture, host, json_lines

from . import wire as w


def frames(n=25):
    return [w.eth(0x0800, w.ip4(6, w.tcp(1000 + i, 80, body=b"x" * i))) for i in range(n)]


@pytest.mark.parametrize("container", ["pcap", "pcapng"])
@pytest.mark.parametrize("files", [1, 3])
def test_round_trip(spark, tmp_path, container, files):
    raw = w.frame(spark, *frames())
    out = str(tmp_path / "c")
    capture.write(raw, out, container, files)
    back = capture.read(spark, out)
    assert back.count() == 25 and back.select("file").distinct().count() == files
    want = sorted((bytes(r.data), r.ts, r.wire_len, 1) for r in raw.collect())
    assert sorted((bytes(r.data), r.ts, r.wire_len, r.linktype) for r in back.collect()) == want
    for f in back.select("file").distinct().collect():
        rows = back.filter(F.col("file") == f[0]).orderBy("number").collect()
        assert [r.number for r in rows] == list(range(len(rows))) and rows == sorted(rows, key=lambda r: r.ts)
    capture.write(raw.limit(2), out, container)
    assert capture.read(spark, out).count() == 2
    capture.write(raw.limit(0), out, container)
    assert capture.read(spark, out).count() == 0


def test_bytes_of_the_formats(spark, tmp_path):
    capture.write(w.frame(spark, b"abcde"), str(tmp_path / "a"), "pcap", linktype=228)
    data = next((tmp_path / "a").glob("*.pcap")).read_bytes()
    assert data == struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 101) + struct.pack("<IIII", 1704067200, 0, 5, 5) + b"abcde"
    capture.write(w.frame(spark, b"abcde"), str(tmp_path / "b"), "pcapng")
    data = next((tmp_path / "b").glob("*.pcapng")).read_bytes()
    assert len(data) == 28 + 20 + 32 + 8 and data[:4] == b"\x0a\x0d\x0d\x0a" and data[48:52] == b"\6\0\0\0" and data[-4:] == struct.pack("<I", 40)


def read_bytes(spark, tmp_path, data):
    (tmp_path / "x.cap").write_bytes(data)
    return capture.read(spark, str(tmp_path / "x.cap")).orderBy("number").collect()


def test_byte_orders_units_and_cut_files(spark, tmp_path):
    rec = struct.pack(">IIII", 5, 7000, 3, 9) + b"abc"
    r = read_bytes(spark, tmp_path, struct.pack(">IHHiIII", 0xA1B23C4D, 2, 4, 0, 0, 65535, 1) + rec + rec[:-1])
    assert len(r) == 1 and r[0].ts.microsecond == 7 and r[0].wire_len == 9 and bytes(r[0].data) == b"abc"
    nano = struct.pack("<IIHHI", 1, 28, 101, 0, 0) + struct.pack("<HHBxxx", 9, 1, 9) + struct.pack("<I", 28)
    ns = 5_000_000_123
    epb = struct.pack("<IIIIIII", 6, 36, 0, ns >> 32, ns & 0xFFFFFFFF, 4, 4) + b"data" + struct.pack("<I", 36)
    other = struct.pack("<II", 0xBAD, 16) + b"skip" + struct.pack("<I", 16)
    r = read_bytes(spark, tmp_path, capture.pcapng_header(1, 0)[:28] + nano + other + epb)
    assert [(x.linktype, bytes(x.data), x.ts.microsecond, x.ts.second) for x in r] == [(101, b"data", 0, 5)]
    with pytest.raises(Exception, match="no capture file"):
        read_bytes(spark, tmp_path, b"GIF89a..")


def test_pushed_number_bound_and_capture_filter(spark, tmp_path):
    out = str(tmp_path / "c")
    capture.write(w.frame(spark, *frames()), out)
    rows = capture.read(spark, out)
    assert sorted(r.number for r in rows.filter("number < 3").collect()) == [0, 1, 2] and rows.filter("number <= 3 and wire_len > 0").count() == 4
    assert capture.read(spark, out, "src port 1003").count() == 1
    assert [tuple(r) for r in capture.interfaces(spark, out).select("linktype", "packets").collect()] == [(1, 25)]


def test_stream_of_rotated_files(spark, tmp_path):
    for i in range(3):
        capture.write(w.frame(spark, *frames(4)), str(tmp_path / "in" / f"d{i}"))
    q = capture.stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("rotated").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("rotated").count() == 12


def test_json_lines(spark):
    mixed = [
        w.eth(0x0800, w.ip4(6, w.tcp(5, 80, 0x18, b"GET / HTTP/1.1\r\nHost: h\r\n\r\n"))),
        w.eth(0x0800, w.ip4(17, w.udp(53, 9, w.dns(answers=w.rr(1, b"\1\2\3\4") + w.rr(15, b"\0\5\xc0\x0c") + w.rr(99, b"z"), n=3, response=True)))),
        w.eth(0x0800, w.ip4(6, w.tcp(5, 9, body=w.record(11, b"\0\0\0")))),
        w.eth(0x0806, bytes.fromhex("0001080006040001001122334455c0a80101000000000000c0a80102")),
        w.eth(0x86DD, w.ip6(17, w.udp(5, 6, bytes.fromhex("c00000000104010203040000")))),
    ]
    got = [json.loads(r.value) for r in json_lines.lines(decode(w.frame(spark, *mixed))).collect()]
    got.sort(key=lambda g: g["number"])
    tags = [[next(iter(x)) for x in g["layers"]] for g in got]
    assert tags == [["Ethernet", "Ipv4", "Tcp", "Http", "Payload"], ["Ethernet", "Ipv4", "Udp", "Dns", "Payload"], ["Ethernet", "Ipv4", "Tcp", "TlsHandshake", "Payload"], ["Ethernet", "Arp"], ["Ethernet", "Ipv6", "Udp", "Quic", "Payload"]]
    first = got[0]
    assert first["timestamp"] == "2024-01-01T00:00:00Z" and first["data"] == list(mixed[0]) and first["process"] is None and first["retransmission"] is False
    assert first["layers"][0]["Ethernet"]["src_mac"] == [0x11, 0x22, 0x33, 0x44, 0x55, 0x66] and first["layers"][0]["Ethernet"]["header_range"] == [0, 14]
    assert first["layers"][1]["Ipv4"]["src_ip"] == "10.0.0.1" and first["layers"][3]["Http"]["headers"] == [["Host", "h"]] and first["layers"][4]["Payload"] == {"offset": 54, "len": 27}
    answers = got[1]["layers"][3]["Dns"]["answers"]
    assert [a["rdata"] for a in answers] == [{"A": "1.2.3.4"}, {"Mx": {"preference": 5, "exchange": "example.com"}}, {"Unknown": {"rtype": 99, "data": [122]}}]
    assert got[2]["layers"][3]["TlsHandshake"]["messages"] == [{"Certificate": {"cert_count": 0}}] and got[4]["layers"][3]["Quic"]["dcid"] == [1, 2, 3, 4]
    assert first["summary"] == {"source": "10.0.0.1", "destination": "192.168.1.1", "protocol": "HTTP", "length": len(mixed[0]), "info": "GET h/", "color_hint": "Tcp"}


def lines(spark, text, **more):
    rows = [(i, v, *more.values()) for i, v in enumerate(text.strip("\n").split("\n"))]
    return spark.createDataFrame(rows, ", ".join(["line_no int", "value string", *[f"{k} {'boolean' if isinstance(v, bool) else 'string'}" for k, v in more.items()]]))


def shown(df):
    from wireloom.functions.bytes import ip_text

    return sorted(map(tuple, df.withColumn("addr", ip_text(F.col("addr"))).collect()), key=repr)


def test_proc_net(spark):
    text = "  sl  local_address rem_address st\n   0: 0100007F:1F90 00000000:0000 0A 0:0 0:0 0 0 0 4711 1\n   1: 0100007F:1F91 00000000:0000 0A 0:0 0:0 0 0 0 0 1\n   2: zz:1 x\n   3: 000080FE00000000000000000100000A:0035 00000000000000000000000000000000:0000 0A 0:0 0:0 0 0 0 99 1"
    sockets = host.proc_net(lines(spark, text, file="/proc/net/tcp6"))
    assert shown(sockets) == sorted([(6, "127.0.0.1", 8080, 4711), (6, "fe80::a00:1", 53, 99)], key=repr)
    links = spark.createDataFrame([(4711, 12, "nginx", "/usr/sbin/nginx")], "inode long, pid long, name string, exe_path string")
    assert {(r.port, r.name) for r in host.with_programs(sockets, links).collect()} == {(8080, "nginx"), (53, None)}


def test_lsof(spark):
    text = "p100\nccurl\nf5\nPTCP\nn10.0.0.1:5000->1.1.1.1:443\nf6\nn10.0.0.1:9\nPUDP\nn[::1]:53\nn*:80\np200\nn10.0.0.2:7\ncssh\nf1\nPTCP\nn[fe80::1]:22"
    got = shown(host.lsof(lines(spark, text, snapshot="s")))
    assert got == sorted([(6, "10.0.0.1", 5000, 100, "curl"), (17, "::1", 53, 100, "curl"), (6, "fe80::1", 22, 200, "ssh")], key=repr)


def test_netstat_and_tasklist(spark):
    text = "Active Connections\n  Proto  Local Address  Foreign Address  State  PID\n  TCP    10.0.0.1:5000  1.1.1.1:443  ESTABLISHED  77\n  UDP    [fe80::1%12]:53  *:*   88\n  TCP    *:80  x  LISTENING  9\n  TCP  1.2.3.4:5  x  nope"
    assert shown(host.netstat(lines(spark, text))) == sorted([(6, "10.0.0.1", 5000, 77), (17, "fe80::1", 53, 88)], key=repr)
    text = '"curl.exe","77","Console","1","5,000 K"\n"System","4","Services","0","1 K"\nbroken'
    assert {tuple(r) for r in host.tasklist(lines(spark, text)).collect()} == {(77, "curl.exe"), (4, "System")}


def test_identities(spark, tmp_path):
    (tmp_path / "bin").write_bytes(b"hello")
    import hashlib

    r = host.file_identities(spark, str(tmp_path)).head()
    assert r.value == hashlib.sha256(b"hello").hexdigest() and r.kind == "Sha256"
    text = "Identifier=com.a\nCDHash=abc\nAuthority=One\nAuthority=Two\nTeamIdentifier=not set\nflags=0x2(adhoc)"
    r = host.codesign(lines(spark, text, path="/x", success=True)).head()
    assert (r.signing_id, r.value, r.authority, r.team_id, r.status) == ("com.a", "abc", "One", None, "AdHoc")


def test_ranges_and_settings(spark, tmp_path):
    (tmp_path / "c.csv").write_text("1.0.0.0,1.0.0.255,AU\n2001:db8::,2001:db8::ff,ZZ\n")
    r = host.ranges(spark, str(tmp_path / "c.csv"), "country string").collect()
    assert [(bytes(x.start_ip)[:2], len(x.end_ip), x.country) for x in r] == [(b"\1\0", 4, "AU"), (b"\x20\1", 16, "ZZ")]
    assert host.ranges(spark, None, "country string") is None and host.ranges(spark, str(tmp_path / "nope.parquet"), "country string") is None
    (tmp_path / "s.toml").write_text('default_interface = "en0"\n[filters]\nweb = "tcp.port == 443"\n')
    assert host.Settings.load(tmp_path / "s.toml") == host.Settings("en0", "default", {"web": "tcp.port == 443"})
    assert host.Settings.load(tmp_path / "none.toml") == host.Settings()
    (tmp_path / "bad.toml").write_text("= nothing")
    with pytest.warns(UserWarning):
        assert host.Settings.load(tmp_path / "bad.toml") == host.Settings()

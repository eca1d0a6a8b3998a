import pytest
from pyspark.sql import functions as F

from wireloom.operators import app
from wireloom.operators.decode import LAYERS, decode, icmp_text, quic

from . import wire as w


def one(spark, data, linktype=1):
    return decode(w.frame(spark, data, linktype=linktype)).head()


def present(row):
    return [x for x in LAYERS if row[x] is not None]


def test_ethernet(spark):
    r = one(spark, w.eth(0xFFFF, b"zz"))
    assert present(r) == ["eth"] and r.eth.ethertype == 0xFFFF and bytes(r.eth.src_mac).hex() == "112233445566" and tuple(r.eth.header_range) == (0, 14)
    assert (r.summary.source, r.summary.destination, r.summary.protocol) == ("11:22:33:44:55:66", "aa:bb:cc:dd:ee:ff", "???")
    assert present(one(spark, b"\0" * 13)) == []


def test_ipv4_and_bad_versions(spark):
    raw = bytes.fromhex("4500003cabcd4000400600000a000001c0a80101")
    r = one(spark, w.eth(0x0800, raw))
    assert present(r) == ["eth", "ipv4"]
    assert (r.ipv4.ttl, r.ipv4.protocol, r.ipv4.total_length, r.ipv4.identification, r.ipv4.flags, r.ipv4.ihl) == (64, 6, 60, 0xABCD, 2, 5)
    assert bytes(r.ipv4.src_ip) == bytes([10, 0, 0, 1]) and r.summary.destination == "192.168.1.1"
    for bad in (b"\x65" + raw[1:], b"\x44" + raw[1:], raw[:19], b"\x46" + raw[1:]):
        assert present(one(spark, w.eth(0x0800, bad))) == ["eth"]


def test_options_move_the_transport_header(spark):
    raw = bytes.fromhex("46000040") + bytes(5) + b"\x06" + bytes(2) + bytes([1, 2, 3, 4, 5, 6, 7, 8]) + b"\1\1\1\1" + w.tcp(1, 2, body=b"hey")
    r = one(spark, w.eth(0x0800, raw))
    assert r.tcp.src_port == 1 and r.tcp.payload_len == 3 and tuple(r.tcp.header_range) == (38, 58) and tuple(r.payload) == (58, 3)


@pytest.mark.parametrize(("proto", "layer", "body"), [(6, "tcp", w.tcp(1, 2)), (17, "udp", w.udp(1, 2)), (58, "icmpv6", b"\x80\0\0\0\0\0\0\0")])
def test_ipv6(spark, proto, layer, body):
    r = one(spark, w.eth(0x86DD, w.ip6(proto, body)))
    assert present(r) == ["eth", "ipv6", layer] and (r.summary.source, r.summary.destination) == ("::1", "::2") and r.ipv6.hop_limit == 64


def test_icmp_stays_with_its_version(spark):
    assert present(one(spark, w.eth(0x86DD, w.ip6(1, bytes(8))))) == ["eth", "ipv6"]
    assert present(one(spark, w.eth(0x0800, w.ip4(58, bytes(8))))) == ["eth", "ipv4"]
    assert present(one(spark, w.eth(0x0800, w.ip4(1, b"\x08\0" + bytes(6))))) == ["eth", "ipv4", "icmp"]


def test_tcp_flags_and_padding(spark):
    r = one(spark, w.eth(0x0800, w.ip4(6, w.tcp(80, 12345, 0x12)) + b"\0" * 6))
    assert r.summary.info == "80 → 12345 [SYN, ACK] Seq=1000 Ack=500 Len=6"  # padding counts
    r = one(spark, w.eth(0x0800, w.ip4(6, w.tcp(80, 12345, 0xFF))))
    assert "[SYN, ACK, FIN, RST, PSH, URG, ECE, CWR]" in r.summary.info and r.payload is None
    short = bytearray(w.tcp(1, 2))
    short[12] = 0x40
    assert present(one(spark, w.eth(0x0800, w.ip4(6, bytes(short))))) == ["eth", "ipv4"]


def test_raw_ip_and_other_links(spark):
    assert present(one(spark, w.ip4(17, w.udp(1, 2)), 101)) == ["ipv4", "udp"]
    assert present(one(spark, w.ip6(17, w.udp(1, 2)), 228)) == ["ipv6", "udp"]
    assert present(one(spark, w.ip4(17, w.udp(1, 2)), 105)) == [] and present(one(spark, b"", 101)) == []
    r = one(spark, None)
    assert present(r) == [] and r.summary.protocol == "???"


def test_arp(spark):
    body = bytes.fromhex("0001080006040001001122334455c0a80101000000000000c0a80102")
    r = one(spark, w.eth(0x0806, body))
    assert r.arp.operation == 1 and r.summary.info == "Who has 192.168.1.2? Tell 192.168.1.1" and r.summary.color_hint == "Arp"
    r = one(spark, w.eth(0x0806, body[:7] + b"\2" + body[8:]))
    assert r.summary.info == "192.168.1.1 is at 00:11:22:33:44:55"
    assert one(spark, w.eth(0x0806, body[:7] + b"\5" + body[8:])).summary.info == "op=5"


def test_dispatch(spark):
    get = b"GET / HTTP/1.1\r\nHost: h\r\n\r\n"
    assert present(one(spark, w.eth(0x0800, w.ip4(6, w.tcp(5, 80, body=get)))))[3:] == ["http", "payload"]
    assert present(one(spark, w.eth(0x0800, w.ip4(6, w.tcp(5, 53, body=get)))))[3:] == ["payload"]  # port 53 is only DNS
    assert present(one(spark, w.eth(0x0800, w.ip4(6, w.tcp(53, 5, body=w.dns())))))[3:] == ["dns", "payload"]
    assert present(one(spark, w.eth(0x0800, w.ip4(17, w.udp(5, 80, get)))))[3:] == ["payload"]  # other UDP is only QUIC
    assert present(one(spark, w.eth(0x0800, w.ip4(6, w.tcp(5, 9, body=w.hello("a.b"))))))[3:] == ["tls_client_hello", "payload"]
    r = one(spark, w.eth(0x0800, w.ip4(6, w.tcp(5, 9, body=w.hello("a.b")))))
    assert r.summary.info == "TLS → a.b" and r.summary.color_hint == "Tls"


def test_icmp_texts(spark):
    df = spark.createDataFrame([(0, 9), (3, 0), (3, 1), (3, 2), (3, 3), (8, 0), (11, 1), (5, 7)], "t int, c int")
    got = [r[0] for r in df.select(icmp_text(F.col("t"), F.col("c"))).collect()]
    assert got == ["Echo Reply", "Destination Net Unreachable", "Destination Host Unreachable", "Destination Unreachable (code=2)", "Destination Port Unreachable", "Echo Request", "Time Exceeded", "Type=5 Code=7"]


# --- parsers -------------------------------------------------------------


def test_dns_records():
    pointer = b"\xc0\x0c"
    answers = w.rr(1, b"\1\2\3\4") + w.rr(28, bytes(15) + b"\1") + w.rr(5, b"\3www" + pointer) + w.rr(15, b"\0\5" + pointer) + w.rr(16, b"\2hi\1x\x09") + w.rr(33, b"\0\1\0\2\0\3" + pointer)
    answers += w.rr(6, pointer + pointer + b"".join(i.to_bytes(4, "big") for i in range(5))) + w.rr(99, b"raw") + w.rr(1, b"\1\2\3")
    head = b"\0" * 42
    got = app.dns(head + w.dns(answers=answers, n=9, response=True), 42)
    assert got["transaction_id"] == 0xABCD and got["is_response"] and got["questions"] == [{"qname": "example.com", "qtype": 1, "qclass": 1}]
    a = [x["rdata"] for x in got["answers"]]
    assert [x["name"] for x in got["answers"]] == ["example.com"] * 9
    assert a[0] == {"kind": "A", "ip": "1.2.3.4"} and a[1]["ip"] == "::1" and a[2] == {"kind": "Cname", "name": "www.example.com"} and a[3] == {"kind": "Mx", "preference": 5, "name": "example.com"}
    assert a[4]["strings"] == ["hi", "x"] and a[5]["port"] == 3 and a[6]["minimum"] == 4 and a[6]["rname"] == "example.com" and a[7] == {"kind": "Unknown", "rtype": 99, "data": b"raw"} and a[8]["kind"] == "Unknown"


def test_dns_limits():
    whole = w.dns()
    assert app.dns(whole[:11], 0) is None
    assert app.dns(whole[:4] + b"\0\0" + whole[6:], 0) is None  # no question
    assert app.dns(whole[:4] + b"\0\x65" + whole[6:], 0) is None  # 101 questions
    assert app.dns(whole[:6] + b"\x10\1" + whole[8:], 0) is None  # 4097 answers
    assert app.dns(whole[:12] + b"\x3fbad", 0) is None
    loop = whole[:12] + b"\xc0\x0c\0\1\0\1"
    assert app.dns(loop, 0) is None
    cut = app.dns(w.dns(answers=w.rr(1, b"\1\2\3\4") + b"\xc0", n=2), 0)
    assert len(cut["answers"]) == 1 and cut["authorities"] == []
    root = w.dns(answers=w.rr(5, b"\1a\xc0" + bytes([12 + len(w.name("example.com")) - 1])), n=1, response=True)
    assert app.dns(root, 0)["answers"][0]["rdata"]["name"] == "a."  # a pointer to the root leaves the dot


def test_client_hello():
    more = w.extension(10, w.sized(w.u16s(0x1A1A, 23))) + w.extension(11, w.sized(b"\0", 1)) + w.extension(13, w.sized(w.u16s(0x0403))) + w.extension(43, w.sized(w.u16s(0x0A0A, 0x0304), 1)) + w.extension(0x2A2A, b"")
    got = app.client_hello(b"__" + w.hello("example.com", ("h2", "http/1.1"), (0x0A0A, 0x1301, 0x002F), more), 2)
    assert got["sni"] == "example.com" and got["alpn"] == ["h2", "http/1.1"] and got["cipher_suites"] == [0x0A0A, 0x1301, 0x002F] and got["extensions"] == [0, 16, 10, 11, 13, 43, 0x2A2A]
    import hashlib

    assert got["ja3"] == hashlib.md5(b"771,4865-47,0-16-10-11-13-43,23,0").hexdigest()
    assert got["ja4"].startswith("t13d0206h2_") and [len(x) for x in got["ja4"].split("_")] == [10, 12, 12]


def test_hello_edges():
    assert app.client_hello(b"\x17" + w.hello()[1:], 0) is None and app.client_hello(w.hello()[:-1], 0) is None
    bare = app.client_hello(w.record(1, b"\3\3short"), 0)
    assert bare["legacy_version"] == 0 and bare["ja3"] is None
    got = app.client_hello(w.record(1, w.u16s(0x0303) + bytes(32) + b"\x20"), 0)
    assert got["legacy_version"] == 0x0303 and got["ja4"] is None
    assert app.client_hello(w.hello(None), 0)["ja4"].startswith("t12i0100")
    bad = w.extension(0, w.sized(b"\0" + w.sized(b"\xff\xfe")))
    assert app.client_hello(w.hello(None, more=bad), 0)["sni"] is None


def test_other_handshakes():
    server = w.record(2, w.u16s(0x0303) + bytes(32) + b"\0" + w.u16s(0x1301) + b"\0" + w.sized(w.extension(43, w.u16s(0x0304)) + w.extension(16, w.sized(w.sized(b"h2", 1)))))
    m = app.handshake(server, 0)["messages"][0]
    assert (m["kind"], m["cipher_suite"], m["alpn"]) == ("ServerHello", 0x1301, ["h2"])
    certs = w.sized(w.sized(b"one", 3) + w.sized(b"two", 3), 3)
    assert app.handshake(w.record(11, certs), 0)["messages"][0] == {"kind": "Certificate", "cert_count": 2}
    assert app.handshake(w.record(14, b""), 0)["messages"][0] == {"kind": "Other", "msg_type": 14}
    assert app.handshake(w.hello(), 0) is None


@pytest.mark.parametrize(
    ("c", "e", "want"),
    [([47, 53], [0, 11], "771,47-53,0-11,23,0"), ([0x0A0A, 47], [0x1A1A, 0], "771,47,0,23,0")],
)
def test_ja3_strings(spark, c, e, want):
    from wireloom.functions import fingerprint as fp

    assert app.ja3_text(771, c, e, [23], [0]) == want
    df = spark.createDataFrame([(c, e)], "c array<int>, e array<int>")
    r = df.select(fp.ja3_string(F.lit(771), F.col("c"), F.col("e"), F.array(F.lit(23)), F.array(F.lit(0))), fp.ja4(F.lit(0x0304), F.lit(True), F.col("c"), F.col("e"), F.array(F.lit(0x0403)), F.lit("h2"))).head()
    assert r[0] == want and r[1] == app.ja4_text(0x0304, True, c, e, [0x0403], "h2")


def test_ja4_without_anything(spark):
    from wireloom.functions import fingerprint as fp

    none = F.array().cast("array<int>")
    got = spark.range(1).select(fp.ja4(F.lit(0x0303), F.lit(False), none, none, none, F.lit(None).cast("string"))).head()[0]
    assert got == app.ja4_text(0x0303, False, [], [], [], None) == "t12i000000_000000000000_000000000000"


def test_http():
    r = app.http(b"POST /x HTTP/1.0\r\nhost: one\r\nHost: two\r\nTransfer-Encoding: Chunked\r\nContent-Length: 5\r\nbroken\r\n\r\nbody: no\r\n")
    assert (r["method"], r["uri"], r["host"], r["chunked"], r["content_length"]) == ("POST", "/x", "two", True, 5) and len(r["headers"]) == 4
    assert app.http(b"HTTP/1.1 404 Not Found\r\n\r\n")["status_code"] == 404
    for bad in (b"", b"HTTP/1.1 abc\r\n\r\n", b"BREW / HTTP/1.1\r\n\r\n", b"GET /\r\n\r\n", b"GET / FTP/1\r\n\r\n", b"GET /\xff HTTP/1.1\r\n\r\n"):
        assert app.http(bad) is None


def test_http2():
    headers = bytes.fromhex("8240017801798241")  # :method GET, x: y, and two more indexed
    frames = b"\0\0" + bytes([len(headers)]) + b"\1\4\x80\0\0\1" + headers + b"\0\0\1\1\x24\0\0\0\1\x82" + b"\0\0\1\1\4\0\0\0\3\xbe" + b"\0\0\x09"
    got = app.http2(app.PREFACE + frames)["frames"]
    assert [f["stream_id"] for f in got] == [1, 1, 3]
    assert got[0]["headers"][:2] == [{"name": ":method", "value": "GET"}, {"name": "x", "value": "y"}]
    assert got[1]["headers"] == [] and got[2]["headers"] == [{"name": "x", "value": "y"}]
    assert app.http2(b"GET") is None and len(app.STATIC) == 61 and app.STATIC[60] == ("www-authenticate", "")


@pytest.mark.parametrize(("raw", "prefix", "want"), [("0a", 5, 10), ("1f9a0a", 5, 1337), ("2a", 8, 42)])
def test_hpack_integers(raw, prefix, want):
    assert app.HeaderTable.integer(app.Cursor(bytes.fromhex(raw)), prefix) == want


def test_hpack_table_shrinks_and_huffman():
    t = app.HeaderTable()
    assert t.decode(bytes.fromhex("40") + b"\x82ab" + b"\1v") == [{"name": "<huffman:2b>", "value": "v"}]
    assert t.decode(b"\xbe") == [{"name": "<huffman:2b>", "value": "v"}]
    assert t.decode(b"\x20\xbe") == [] and t.decode(b"\x80\x82") == []


def test_quic():
    long = bytes.fromhex("c00000000104010203040000")
    got = quic(b"##" + long, 2)
    assert (got["version"], got["packet_type"], got["dcid"], got["scid"]) == (1, "Initial", b"\1\2\3\4", b"")
    assert quic(bytes.fromhex("80000000000000"), 0)["packet_type"] == "VersionNegotiation"
    assert quic(b"\x40" + long[1:], 0) is None and quic(long[:5], 0) is None and quic(b"\xc0\0\0\0\1\x15" + bytes(40), 0) is None

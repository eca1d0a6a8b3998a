import ipaddress

import pytest

from wireloom.operators.decode import decode
from wireloom.plans import bpf
from wireloom.plans.display_filter import And, Compare, Contains, FilterError, Not, Or, Present, matching, parse

from . import wire as w

TCP, UDP, DNS = Present("tcp"), Present("udp"), Present("dns")


@pytest.mark.parametrize(
    ("text", "tree"),
    [
        ("tcp", TCP), (" icmpv6 ", Present("icmpv6")), ("tcp.port == 443", Compare("tcp.port", "==", 443)), ("ip.src==10.0.0.1", Compare("ip.src", "==", ipaddress.IPv4Address("10.0.0.1"))),
        ("dns.qname contains exa.mple", Contains("dns.qname", "exa.mple")), ("tcp and udp", And(TCP, UDP)), ("tcp && udp or dns", Or(And(TCP, UDP), DNS)), ("tcp or udp and dns", Or(TCP, And(UDP, DNS))),
        ("not tcp", Not(TCP)), ("! ! tcp", Not(Not(TCP))), ("not tcp and udp", And(Not(TCP), UDP)), ("(tcp or udp) and dns", And(Or(TCP, UDP), DNS)), ("tcp.port != 80", Compare("tcp.port", "!=", 80)),
        ("nottcp", Not(TCP)), ("tcporudp", Or(TCP, UDP)), ("tcp or udp or dns", Or(Or(TCP, UDP), DNS)), ("tls.sni == abc", Compare("tls.sni", "==", "abc")), ("a.b.c_d == x", Compare("a.b.c_d", "==", "x")),
        ("tls.sni contains 1e100.net", Contains("tls.sni", "1e100.net")), ("ip.src == fe80::1", Compare("ip.src", "==", "fe80::1")),
    ],
)
def test_parse(text, tree):
    assert parse(text) == tree


@pytest.mark.parametrize("text", ["", "  ", "tcp udp", "tcp.port ==", "(tcp", "frame", "ip.src == 10.0.0.0/8", "tls.sni == 1e100.net", "ip.src == 2001:db8::1", "tls.sni == 8.8.8.8.in-addr.arpa", "TCP", "tcp and", "tcp.port = 5", "ip.src == 300.1.1.1"])
def test_refused(text):
    with pytest.raises(FilterError):
        parse(text)


@pytest.fixture(scope="module")
def packets(spark):
    frames = [
        w.eth(0x0806, bytes.fromhex("0001080006040001001122334455c0a80101000000000000c0a80102")),
        w.eth(0x0800, w.ip4(6, w.tcp(50000, 443, body=w.hello("api.example.com")))),
        w.eth(0x0800, w.ip4(17, w.udp(5000, 53, w.dns(asked="www.example.com")))),
        w.eth(0x0800, w.ip4(6, w.tcp(80, 80))),
        w.eth(0x86DD, w.ip6(58, b"\x80\0" + bytes(6))),
        w.eth(0x0800, w.ip4(1, b"\x08\0" + bytes(6))),
    ]
    return decode(w.frame(spark, *frames)).cache()


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("tcp", [1, 3]), ("dns", [2]), ("tls", [1]), ("arp", [0]), ("ip", [1, 2, 3, 4, 5]), ("ipv6", [4]), ("icmp", [5]), ("icmpv6", [4]), ("eth", [0, 1, 2, 3, 4, 5]),
        ("tcp.port == 443", [1]), ("tcp.port != 80", [1]), ("not tcp.port == 443", [0, 2, 3, 4, 5]), ("udp.port == 53", [2]), ("dns.qname contains example", [2]), ("dns.qname == www.example.com", [2]),
        ("not dns.qname contains example", [0, 1, 3, 4, 5]), ("tls.sni contains api", [1]), ("tls.sni == api", []), ("icmp.type == 8", [5]), ("icmp.code == 0", [5]), ("arp.sender.ip == 192.168.1.1", [0]),
        ("ip.src == 10.0.0.1", [1, 2, 3, 5]), ("ip.src != 10.0.0.1", [4]), ("ip.src == word", []), ("ip.src != word", [1, 2, 3, 4, 5]), ("tcp.srcport != word", [1, 3]), ("tcp.srcport contains 5", []), ("frame.length == 1", []), ("not frame.length == 1", [0, 1, 2, 3, 4, 5]),
        ("tcp.srcport == 50000 and tcp.dstport == 443", [1]), ("arp or dns", [0, 2]),
    ],
)
def test_matching(packets, text, want):
    assert sorted(r.number for r in matching(packets, text).select("number").collect()) == want


def test_saved_filters(packets):
    assert matching(packets, ":web", {"web": "tcp.port == 443"}).count() == 1
    with pytest.raises(FilterError):
        matching(packets, ":none", {})


@pytest.mark.parametrize(
    ("text", "want"),
    [("", [0, 1, 2, 3, 4, 5]), ("tcp", [1, 3]), ("tcp port 443", [1]), ("port 53", [2]), ("src port 80", [3]), ("host 192.168.1.1", [0, 1, 2, 3, 5]), ("dst host 192.168.1.1 and not tcp", [2, 5]), ("arp or icmp6", [0, 4]), ("not (tcp or udp)", [0, 4, 5]), ("ip && ! port 80", [1, 2, 5])],
)
def test_capture_filter(spark, packets, text, want):
    raw = packets.select("number", "ts", "wire_len", "data", "linktype")
    got = bpf.captured(raw, text)
    assert got.columns == raw.columns and sorted(r.number for r in got.collect()) == want


@pytest.mark.parametrize("text", ["vlan", "net 10.0.0.0/8", "tcp[13] & 2 != 0", "port http", "(tcp", "tcp udp", "arp port 5", "host nowhere"])
def test_capture_filter_refuses(text):
    with pytest.raises(bpf.CaptureFilterError):
        bpf.compile_bpf(text)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("portrange 400-500", [1]), ("tcp dst portrange 443-80", [1, 3]), ("udp portrange 80-443", []), ("src portrange 80-80", [3]), ("arp host 192.168.1.1", [0]), ("ip host 192.168.1.1", [1, 2, 3, 5]), ("ip src host 192.168.1.1", []),
        ("less 100000", [0, 1, 2, 3, 4, 5]), ("greater 100000", []), ("not greater 0 or tcp port 443", [1]), ("ip6 host ::1:2:3", []),
    ],
)
def test_capture_filter_ranges_lengths_and_hosts(spark, packets, text, want):
    raw = packets.select("number", "ts", "wire_len", "data", "linktype")
    assert sorted(r.number for r in bpf.captured(raw, text).collect()) == want


def test_capture_filter_by_length_and_version_6_address(spark, packets):
    raw = packets.select("number", "ts", "wire_len", "data", "linktype")
    size = {r.number: r.wire_len for r in raw.collect()}
    for n in set(size.values()):
        assert {r.number for r in bpf.captured(raw, f"less {n}").collect()} == {k for k, v in size.items() if v <= n}
        assert {r.number for r in bpf.captured(raw, f"greater {n}").collect()} == {k for k, v in size.items() if v >= n}
    six = packets.filter("number = 4").selectExpr("ipv6.src_ip s", "ipv6.dst_ip d").first()
    for text in (f"host {ipaddress.ip_address(bytes(six.s))}", f"ip6 dst host {ipaddress.ip_address(bytes(six.d))}"):
        assert [r.number for r in bpf.captured(raw, text).collect()] == [4]


@pytest.mark.parametrize("text", ["port 1-2", "portrange 5", "portrange a-b", "less x", "greater", "ip6 host 10.0.0.1", "ip host ::1", "tcp host 10.0.0.1", "icmp portrange 1-2", "net 10", "less -5"])
def test_capture_filter_refuses_what_does_not_fit(text):
    with pytest.raises(bpf.CaptureFilterError):
        bpf.compile_bpf(text)

import ipaddress

import pytest

from wireloom.operators.correlate import located
from wireloom.sources import host, mmdb


def packed(x):
    """A record as the format writes it."""

    def head(kind, size):
        first, more = (kind << 5, b"") if kind < 8 else (0, bytes([kind - 7]))
        if size < 29:
            return bytes([first | size]) + more
        if size < 285:
            return bytes([first | 29]) + more + bytes([size - 29])
        return bytes([first | 30]) + more + (size - 285).to_bytes(2, "big")

    if isinstance(x, bool):
        return head(14, int(x))
    if isinstance(x, str):
        return head(2, len(x.encode())) + x.encode()
    if isinstance(x, int):
        raw = x.to_bytes((x.bit_length() + 7) // 8, "big")
        return head(6, len(raw)) + raw
    if isinstance(x, list):
        return head(11, len(x)) + b"".join(map(packed, x))
    return head(7, len(x)) + b"".join(packed(k) + packed(v) for k, v in x.items())


def database(nets, bits=24, version=6, alias=False):
    """A file of (network text, record) pairs, each record written once."""
    data, at, tree = b"", {}, [[None, None]]
    for text, record in nets:
        raw = packed(record)
        if raw not in at:
            at[raw] = len(data)
            data += raw
        net = ipaddress.ip_network(text)
        path = format(int(net.network_address), f"0{net.max_prefixlen}b")[: net.prefixlen]
        if version == 6 and net.version == 4:
            path = "0" * 96 + path
        node = 0
        for b in path[:-1]:
            if tree[node][int(b)] is None:
                tree[node][int(b)] = len(tree)
                tree.append([None, None])
            node = tree[node][int(b)]
        tree[node][int(path[-1])] = ("data", at[raw])
    n = len(tree)

    def number(x):
        return n if x is None else n + 16 + x[1] if isinstance(x, tuple) else x

    out = b""
    for l, r in ([number(x) for x in pair] for pair in tree):
        if bits == 28:
            out += (l & 0xFFFFFF).to_bytes(3, "big") + bytes([l >> 24 << 4 | r >> 24]) + (r & 0xFFFFFF).to_bytes(3, "big")
        else:
            out += l.to_bytes(bits // 8, "big") + r.to_bytes(bits // 8, "big")
    return out + bytes(16) + data + mmdb.MARK + packed({"node_count": n, "record_size": bits, "ip_version": version, "database_type": "test", "languages": ["en"], "description": {"en": "d" * 300}})


LAND = [("1.0.0.0/24", {"country": {"iso_code": "AU", "eu": False}}), ("8.0.0.0/6", {"country": {"iso_code": "US"}}), ("9.9.9.9/32", {"country": {"iso_code": "CH"}})]
SIX = [("2001:db8::/33", {"country": {"iso_code": "DE"}}), ("2a00::/12", {"country": {"iso_code": "FR"}}), ("2600::/16", {"other": "x"})]


def ranges(spark, path, columns="country string"):
    return sorted((str(ipaddress.ip_address(bytes(r[0]))), str(ipaddress.ip_address(bytes(r[1]))), *r[2:]) for r in host.ranges(spark, str(path), columns).collect())


@pytest.mark.parametrize("bits", [24, 28, 32])
def test_networks(spark, tmp_path, bits):
    p = tmp_path / f"six{bits}.mmdb"
    p.write_bytes(database([LAND[0], *SIX], bits))
    got = [r for r in ranges(spark, p) if ":" not in r[0]]
    assert got == [("1.0.0.0", "1.0.0.255", "AU")]
    six = [r for r in ranges(spark, p) if r[0].startswith("2")]
    # a network over several first octets would be cut; these aren't, and one has no country
    assert six == [("2001:db8::", "2001:db8:7fff:ffff:ffff:ffff:ffff:ffff", "DE"), ("2a00::", "2a0f:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "FR")]


def test_a_wide_network_is_cut_at_first_octets(spark, tmp_path):
    p = tmp_path / "four.mmdb"
    p.write_bytes(database([LAND[1]], version=4))
    assert ranges(spark, p) == [(f"{i}.0.0.0", f"{i}.255.255.255", "US") for i in sorted(range(8, 12), key=str)]


def test_lookup_against_the_networks(spark, tmp_path):
    p, q = tmp_path / "land.mmdb", tmp_path / "net.mmdb"
    p.write_bytes(database([LAND[0], ("8.8.0.0/16", LAND[1][1]), LAND[2], *SIX]))
    org = "An organisation with a name of more than twenty-eight bytes"
    q.write_bytes(database([("8.8.8.0/24", {"autonomous_system_number": 15169, "autonomous_system_organization": org})], version=4))
    asked = ["1.0.0.7", "1.0.1.0", "8.8.8.8", "8.8.4.4", "9.9.9.9", "10.0.0.1", "2001:db8::1", "2001:db8:8000::1", "2a05::2", "2600::1"]
    rows = spark.createDataFrame([(a, bytearray(ipaddress.ip_address(a).packed)) for a in asked] + [("null", None)], "t string, ip binary")
    got = {r.t: (r.country, r.asn, r.as_org) for r in located(rows, "ip", host.ranges(spark, str(p), "country string"), host.ranges(spark, str(q), "asn long, as_org string")).collect()}
    none = (None, None, None)
    assert got == {
        "1.0.0.7": ("AU", None, None), "1.0.1.0": none, "8.8.8.8": ("US", 15169, org), "8.8.4.4": ("US", None, None), "9.9.9.9": ("CH", None, None), "10.0.0.1": none,
        "2001:db8::1": ("DE", None, None), "2001:db8:8000::1": none, "2a05::2": ("FR", None, None), "2600::1": none, "null": none,
    }


def test_files_that_give_no_data(spark, tmp_path):
    good = database(LAND[:1])
    for name, raw in (("empty", b""), ("text", b"no database" * 50), ("cut", good[-60:]), ("bits", good.replace(packed({"record_size": 24})[1:], packed({"record_size": 25})[1:]))):
        (tmp_path / f"{name}.mmdb").write_bytes(raw)
        assert host.ranges(spark, str(tmp_path / f"{name}.mmdb"), "country string") is None
    assert host.ranges(spark, str(tmp_path / "nowhere.mmdb"), "country string") is None
    with pytest.raises(ValueError, match="no such field"):
        mmdb.networks(spark, "x.mmdb", "city string")


def test_record_kinds():
    read = lambda raw, at=0: mmdb.Records(raw, 0).read(at)
    assert read(b"\x42ab\x20\x00", 3) == "ab" and read(b"\x28\x00\x00" + bytes(2045) + b"\x41z") == "z" and read(b"\x38\x00\x00\x00\x05\x41z") == "z"
    assert read(b"\x44\xe2\x82\xacx") == "€x" and read(b"\x01\x07") is True and read(b"\x04\x01\xff\xff\xff\xfe") == -2
    assert read(b"\x02\x04\x41a\xa1\x07") == ["a", 7] and read(b"\x68\x3f\xf8" + bytes(6)) == 1.5 and read(b"\xe1\x41k\x20\x01") == {"k": "k"}
    for broken in (b"\x20\x00", b"\x45ab", b"\x00\xff", b""):  # a pointer to itself, two short ones, no record
        with pytest.raises(mmdb.BadDatabase):
            read(broken)


def test_long_sizes():
    for n in (28, 29, 284, 285, 65820):
        assert mmdb.Records(packed("é" * (n // 2) + "x" * (n % 2)), 0).read(0) == "é" * (n // 2) + "x" * (n % 2)
    n = 65821 + 300
    assert mmdb.Records(b"\x5f" + (300).to_bytes(3, "big") + b"y" * n, 0).read(0) == "y" * n

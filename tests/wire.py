"""Frames for tests, built by hand."""

import datetime as dt

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
RAW = "number long, ts timestamp, wire_len long, data binary, linktype int"


def eth(kind, body, src="112233445566", dst="aabbccddeeff"):
    return bytes.fromhex(dst + src) + kind.to_bytes(2, "big") + body


def ip4(proto, body, src="10.0.0.1", dst="192.168.1.1"):
    quad = lambda s: bytes(map(int, s.split(".")))
    return bytes.fromhex("4500") + (20 + len(body)).to_bytes(2, "big") + bytes.fromhex("abcd4000") + bytes([64, proto]) + b"\0\0" + quad(src) + quad(dst) + body


def ip6(proto, body, src="::1", dst="::2"):
    import ipaddress

    return bytes.fromhex("60000000") + len(body).to_bytes(2, "big") + bytes([proto, 64]) + ipaddress.ip_address(src).packed + ipaddress.ip_address(dst).packed + body


def tcp(sp, dp, flags=0x10, body=b"", seq=1000, ack=500):
    return sp.to_bytes(2, "big") + dp.to_bytes(2, "big") + seq.to_bytes(4, "big") + ack.to_bytes(4, "big") + bytes([0x50, flags]) + b"\xff\xff\0\0\0\0" + body


def udp(sp, dp, body=b""):
    return sp.to_bytes(2, "big") + dp.to_bytes(2, "big") + (8 + len(body)).to_bytes(2, "big") + b"\0\0" + body


def name(text):
    return b"".join(bytes([len(x)]) + x.encode() for x in text.split(".")) + b"\0"


def dns(txid=0xABCD, asked="example.com", answers=b"", n=0, response=False):
    return txid.to_bytes(2, "big") + (b"\x81\x80" if response else b"\x01\0") + b"\0\1" + n.to_bytes(2, "big") + b"\0\0\0\0" + name(asked) + b"\0\1\0\1" + answers


def rr(kind, data, owner=b"\xc0\x0c", ttl=300):
    return owner + kind.to_bytes(2, "big") + b"\0\1" + ttl.to_bytes(4, "big") + len(data).to_bytes(2, "big") + data


def extension(kind, body):
    return kind.to_bytes(2, "big") + len(body).to_bytes(2, "big") + body


def u16s(*values):
    return b"".join(v.to_bytes(2, "big") for v in values)


def sized(body, n=2):
    return len(body).to_bytes(n, "big") + body


def hello(sni=None, alpn=(), ciphers=(0x002F,), more=b"", version=0x0303):
    exts = extension(0, sized(b"\0" + sized(sni.encode()))) if sni is not None else b""
    if alpn:
        exts += extension(16, sized(b"".join(sized(a.encode(), 1) for a in alpn)))
    body = u16s(version) + bytes(32) + b"\0" + sized(u16s(*ciphers)) + b"\1\0" + sized(exts + more)
    return record(1, body)


def record(kind, body):
    inner = bytes([kind]) + sized(body, 3)
    return b"\x16\x03\x01" + sized(inner)


def rows(*frames, linktype=1):
    return [(i, T0 + dt.timedelta(seconds=i), len(f or b""), None if f is None else bytearray(f), linktype) for i, f in enumerate(frames)]


def frame(spark, *frames, linktype=1):
    return spark.createDataFrame(rows(*frames, linktype=linktype), RAW)

"""Application layers that take a loop to parse: DNS, TLS, HTTP/1 and HTTP/2.

Plain Python functions over bytes.  Each returns None where the bytes aren't its protocol;
a broken tail ends what was found so far.  Reads raise Short beyond the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa

RANGE = pa.struct([("start", pa.int32()), ("end", pa.int32())])
RDATA = pa.struct(
    [("kind", pa.string()), ("ip", pa.string()), ("name", pa.string()), ("preference", pa.int32()), ("strings", pa.list_(pa.string())), ("priority", pa.int32()), ("weight", pa.int32()), ("port", pa.int32())]
    + [(x, pa.string()) for x in ("mname", "rname")]
    + [(x, pa.int64()) for x in ("serial", "refresh", "retry", "expire", "minimum")]
    + [("rtype", pa.int32()), ("data", pa.binary())]
)
RECORD = pa.struct([("name", pa.string()), ("rtype", pa.int32()), ("rclass", pa.int32()), ("ttl", pa.int64()), ("rdata", RDATA)])
DNS = pa.struct(
    [("transaction_id", pa.int32()), ("is_response", pa.bool_()), ("rcode", pa.int32())]
    + [("questions", pa.list_(pa.struct([("qname", pa.string()), ("qtype", pa.int32()), ("qclass", pa.int32())])))]
    + [(x, pa.list_(RECORD)) for x in ("answers", "authorities", "additionals")]
    + [("header_range", RANGE)]
)
U16S = pa.list_(pa.int32())
HELLO = pa.struct(
    [("sni", pa.string()), ("alpn", pa.list_(pa.string()))]
    + [(x, U16S) for x in ("cipher_suites", "extensions", "supported_groups", "ec_point_formats", "signature_algorithms", "supported_versions")]
    + [("legacy_version", pa.int32()), ("ja3", pa.string()), ("ja4", pa.string()), ("header_range", RANGE)]
)
MESSAGE = pa.struct([("kind", pa.string()), ("version", pa.int32()), ("cipher_suite", pa.int32()), ("alpn", pa.list_(pa.string())), ("cert_count", pa.int32()), ("msg_type", pa.int32())])
HANDSHAKE = pa.struct([("messages", pa.list_(MESSAGE)), ("header_range", RANGE)])
PAIRS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
HTTP = pa.struct(
    [("is_request", pa.bool_()), ("method", pa.string()), ("uri", pa.string()), ("version", pa.string()), ("status_code", pa.int32()), ("headers", PAIRS), ("host", pa.string()), ("content_length", pa.int64()), ("chunked", pa.bool_()), ("header_range", RANGE)]
)
HTTP2 = pa.struct([("frames", pa.list_(pa.struct([("stream_id", pa.int64()), ("frame_type", pa.int32()), ("flags", pa.int32()), ("length", pa.int64()), ("headers", PAIRS)])))])


class Short(Exception):
    """A read beyond the end."""


class Cursor:
    """Reads forward through bytes, up to ``end``."""

    __slots__ = ("at", "data", "end")

    def __init__(self, data: bytes, at: int = 0, end: int | None = None) -> None:
        self.data, self.at, self.end = data, at, len(data) if end is None else end

    def take(self, n: int) -> bytes:
        if self.at + n > self.end:
            raise Short
        self.at += n
        return self.data[self.at - n : self.at]

    def num(self, n: int) -> int:
        return int.from_bytes(self.take(n), "big")

    def rest(self) -> int:
        return self.end - self.at


def _range(a: int, b: int) -> dict:
    return {"start": a, "end": b}


def _text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


# --- DNS ---------------------------------------------------------------

NESTING = 128
MOST_QUESTIONS, MOST_RECORDS = 100, 4096


def dns_name(c: Cursor, base: int, depth: int = 0) -> str:
    """A possibly compressed name; the cursor ends after its part in the stream.

    Pointers count from the message start.  Only length bytes with both top bits
    set are pointers.  A pointer to the root after labels leaves a dot at the end.
    """
    if depth > NESTING:
        raise Short
    labels: list[str] = []
    while (n := c.num(1)) != 0:
        if n >= 0xC0:
            target = (n & 0x3F) << 8 | c.num(1)
            labels.append(dns_name(Cursor(c.data, base + target, c.end), base, depth + 1))
            break
        labels.append(_text(c.take(n)))
    return ".".join(labels)


def _addresses(raw: bytes) -> str:
    import ipaddress

    return str(ipaddress.ip_address(raw))


def dns_rdata(c: Cursor, base: int, rtype: int, size: int) -> dict:
    """What a record holds (D8a); anything that doesn't parse is kept as bytes."""
    at, end = c.at, c.at + size
    inner = Cursor(c.data, at, c.end)
    try:
        if (rtype, size) in ((1, 4), (28, 16)):
            return {"kind": "A" if rtype == 1 else "Aaaa", "ip": _addresses(c.data[at:end])}
        if rtype in (2, 5, 12):
            return {"kind": {2: "Ns", 5: "Cname", 12: "Ptr"}[rtype], "name": dns_name(inner, base)}
        if rtype == 15 and size >= 3:
            return {"kind": "Mx", "preference": inner.num(2), "name": dns_name(inner, base)}
        if rtype == 16:
            inner.end, strings = end, []
            try:
                while inner.rest():
                    strings.append(_text(inner.take(inner.num(1))))
            except Short:
                pass
            return {"kind": "Txt", "strings": strings}
        if rtype == 33 and size >= 6:
            return {"kind": "Srv", "priority": inner.num(2), "weight": inner.num(2), "port": inner.num(2), "name": dns_name(inner, base)}
        if rtype == 6:
            names = {"mname": dns_name(inner, base), "rname": dns_name(inner, base)}
            return {"kind": "Soa", **names, **{k: inner.num(4) for k in ("serial", "refresh", "retry", "expire", "minimum")}}
    except Short:
        pass
    return {"kind": "Unknown", "rtype": rtype, "data": c.data[at:end]}


def dns(data: bytes, at: int) -> dict | None:
    """A DNS message at ``at`` (D8): None without a header or a question, with too many records, or a broken question name."""
    c = Cursor(data, at)
    try:
        ident, flags, *counts = (c.num(2) for _ in range(6))
        if counts[0] > MOST_QUESTIONS or max(counts[1:]) > MOST_RECORDS:
            return None
        questions = []
        for _ in range(counts[0]):
            name = dns_name(c, at)
            if c.rest() < 4:
                break
            questions.append({"qname": name, "qtype": c.num(2), "qclass": c.num(2)})
    except Short:
        return None
    if not questions:
        return None
    sections: list[list[dict]] = []
    for n in counts[1:]:
        sections.append([])
        for _ in range(n):
            before = c.at
            try:
                name, rtype, rclass, ttl, size = dns_name(c, at), c.num(2), c.num(2), c.num(4), c.num(2)
                if c.rest() < size:
                    raise Short
            except Short:
                c.at = before
                break
            sections[-1].append({"name": name, "rtype": rtype, "rclass": rclass, "ttl": ttl, "rdata": dns_rdata(c, at, rtype, size)})
            c.at += size
    found = {"transaction_id": ident, "is_response": flags >= 0x8000, "rcode": flags & 15, "questions": questions}
    return found | dict(zip(("answers", "authorities", "additionals"), sections)) | {"header_range": _range(at, min(c.at, len(data)))}


# --- TLS ---------------------------------------------------------------


def _grease(v: int) -> bool:
    return v >> 8 == v & 255 and v & 15 == 10


def ja3_text(version: int, ciphers: list[int], extensions: list[int], groups: list[int], formats: list[int]) -> str:
    """The JA3 string of parsed fields; :mod:`wireloom.functions.fingerprint` has the Column form."""
    lists = [[v for v in xs if not _grease(v)] for xs in (ciphers, extensions, groups)] + [formats]
    return ",".join([str(version), *("-".join(map(str, xs)) for xs in lists)])


def ja4_text(version: int, sni: bool, ciphers: list[int], extensions: list[int], signatures: list[int], alpn: str | None) -> str:
    """The JA4 text of parsed fields."""
    from ..functions.fingerprint import VERSION_CODES

    c, e = ([v for v in xs if not _grease(v)] for xs in (ciphers, extensions))
    raw = (alpn or "").encode()
    ends = (raw[:1] + raw[-1:]).decode("latin-1") if raw else "00"
    digest = lambda text, none: "0" * 12 if none else hashlib.sha256(text.encode()).hexdigest()[:12]
    words = lambda xs: ",".join(f"{v:04x}" for v in xs)
    other = sorted(v for v in e if v not in (0, 16))
    head = f"t{VERSION_CODES.get(version, '00')}{'d' if sni else 'i'}{min(99, len(c)):02}{min(99, len(e)):02}{ends}"
    return "_".join((head, digest(words(sorted(c)), not c), digest(f"{words(other)}_{words(signatures)}", not other and not signatures)))


def _record(data: bytes, at: int) -> tuple[int, Cursor] | None:
    """(handshake type, its body) of a whole handshake record."""
    c = Cursor(data, at)
    try:
        kind, _, size = c.num(1), c.take(2), c.num(2)
        if kind != 0x16 or size < 4 or c.rest() < size:
            return None
        message, length = c.num(1), c.num(3)
    except Short:
        return None
    return (message, Cursor(data, c.at, c.at + length)) if length <= c.rest() else None


def _list(c: Cursor, prefix: int, width: int) -> list[int]:
    """Numbers after a byte count; a count beyond the end means up to the end."""
    if c.rest() < prefix:
        return []
    n = min(c.num(prefix), c.rest())
    return [c.num(width) for _ in range(n // width)]


def _server_name(c: Cursor) -> str | None:
    try:
        if c.rest() < 5:
            return None
        c.take(2)
        while c.rest() >= 3:
            kind, name = c.num(1), c.take(c.num(2))
            if kind == 0:
                return name.decode()
    except (Short, UnicodeDecodeError):
        pass
    return None


def _protocols(c: Cursor) -> list[str]:
    out: list[str] = []
    try:
        c.take(2)
        while c.rest():
            out.append(_text(c.take(c.num(1))))
    except Short:
        pass
    return out


# The extensions that are looked into, and how.
_EXTENSIONS: dict[int, tuple[str, Callable[[Cursor], object]]] = {
    0: ("sni", _server_name),
    10: ("supported_groups", lambda c: _list(c, 2, 2)),
    11: ("ec_point_formats", lambda c: _list(c, 1, 1)),
    13: ("signature_algorithms", lambda c: _list(c, 2, 2)),
    16: ("alpn", _protocols),
    43: ("supported_versions", lambda c: _list(c, 1, 2)),
}


def extensions(c: Cursor) -> dict:
    """Types in order, and the contents of the known ones; stops at one that overruns."""
    out: dict = {"extensions": [], "sni": None, "alpn": []} | {k: [] for k in ("supported_groups", "ec_point_formats", "signature_algorithms", "supported_versions")}
    if c.rest() < 2:
        return out
    c.end = min(c.end, c.at + 2 + int.from_bytes(c.data[c.at : c.at + 2], "big"))
    c.take(2)
    try:
        while c.rest() >= 4:
            kind, size = c.num(2), c.num(2)
            inner = Cursor(c.data, c.at, c.at + size)
            c.take(size)
            out["extensions"].append(kind)
            if kind in _EXTENSIONS:
                name, read = _EXTENSIONS[kind]
                out[name] = read(inner)
    except Short:
        pass
    return out


def client_hello(data: bytes, at: int) -> dict | None:
    """A ClientHello (D9a); one too short for its lists has only its version, and no fingerprints."""
    got = _record(data, at)
    if got is None or got[0] != 1:
        return None
    c = got[1]
    where = {"header_range": _range(at, c.end)}
    bare = {"sni": None, "ja3": None, "ja4": None} | {k: [] for k in ("alpn", "cipher_suites", "extensions", "supported_groups", "ec_point_formats", "signature_algorithms", "supported_versions")}
    if c.rest() < 34:
        return bare | where | {"legacy_version": 0}
    version = c.num(2)
    bare |= where | {"legacy_version": version}
    try:
        c.take(32)
        c.take(c.num(1))
        raw = c.take(c.num(2))
        skip = c.num(1)
    except Short:
        return bare
    ciphers = [int.from_bytes(raw[i : i + 2], "big") for i in range(0, len(raw) - 1, 2)]
    c.at += skip
    found = extensions(c)
    best = max((v for v in found["supported_versions"] if not _grease(v)), default=version)
    text = ja3_text(version, ciphers, found["extensions"], found["supported_groups"], found["ec_point_formats"])
    mark = ja4_text(best, found["sni"] is not None, ciphers, found["extensions"], found["signature_algorithms"], next(iter(found["alpn"]), None))
    return bare | found | {"cipher_suites": ciphers, "ja3": hashlib.md5(text.encode()).hexdigest(), "ja4": mark}


def _server_hello(c: Cursor) -> dict:
    out = {"kind": "ServerHello", "version": 0, "cipher_suite": 0, "alpn": []}
    if c.rest() < 34:
        return out
    out["version"] = c.num(2)
    try:
        c.take(32)
        c.take(c.num(1))
        out["cipher_suite"] = c.num(2)
        c.take(1)
    except Short:
        return out
    found = extensions(c)
    out["alpn"] = found["alpn"]
    out["version"] = next((v for v in found["supported_versions"] if not _grease(v)), out["version"])
    return out


def _certificates(c: Cursor) -> int:
    n = 0
    try:
        c.end = min(c.end, c.at + 3 + c.num(3)) if c.rest() >= 3 else c.at
        while c.rest() >= 3:
            c.take(c.num(3))
            n += 1
    except Short:
        pass
    return n


def handshake(data: bytes, at: int) -> dict | None:
    """Any other handshake message."""
    got = _record(data, at)
    if got is None or got[0] == 1:
        return None
    kind, c = got
    end = c.end
    if kind == 2:
        message = _server_hello(c)
    elif kind == 11:
        message = {"kind": "Certificate", "cert_count": _certificates(c)}
    else:
        message = {"kind": "Other", "msg_type": kind}
    return {"messages": [message], "header_range": _range(at, end)}


# --- HTTP/1 ------------------------------------------------------------

# Request methods, and how much is looked at without an end of head.
METHODS = ("GET", "POST", "PUT", "DELETE", "HEAD", "OPTIONS", "PATCH", "TRACE", "CONNECT")
HEAD_MOST = 8192


def _number(text: str, most: int) -> int | None:
    digits = text[1:] if text[:1] == "+" else text
    return n if digits.isascii() and digits.isdigit() and (n := int(digits)) <= most else None


def http(stream: bytes) -> dict | None:
    """A request or response head (D12); it has to be UTF-8, a status numeric, a request's version ``HTTP/``."""
    stop = stream.find(b"\r\n\r\n")
    size = stop + 2 if stop >= 0 else min(len(stream), HEAD_MOST)
    try:
        first, *lines = stream[:size].decode().split("\r\n")
    except UnicodeDecodeError:
        return None
    out: dict = {"is_request": False, "method": None, "uri": None, "status_code": None, "headers": [], "host": None, "content_length": None, "chunked": False, "header_range": _range(0, size)}
    if first.startswith("HTTP/"):
        version, _, rest = first.partition(" ")
        code = _number(rest.split(" ")[0], 65535)
        if code is None:
            return None
        out |= {"version": version, "status_code": code}
    else:
        parts = first.split(" ", 2)
        if len(parts) < 3 or parts[0] not in METHODS or not parts[2].startswith("HTTP/"):
            return None
        out |= {"is_request": True} | dict(zip(("method", "uri", "version"), parts))
    for line in lines:
        if not line:
            break
        name, colon, value = line.partition(":")
        if not colon:
            continue
        name, value = name.strip(), value.strip()
        out["headers"].append({"name": name, "value": value})
        match name.lower():
            case "host":
                out["host"] = value
            case "content-length":
                out["content_length"] = _number(value, 2**63 - 1)
            case "transfer-encoding" if value.lower() == "chunked":
                out["chunked"] = True
    return out


# --- HTTP/2 ------------------------------------------------------------

PREFACE = b"PRI * HTTP/2.0\r\n\r\nSM\r\n\r\n"
MOST_FRAMES = 128
# The static header table of RFC 7541, appendix A, in order.
STATIC = (
    (":authority", ""), (":method", "GET"), (":method", "POST"), (":path", "/"), (":path", "/index.html"), (":scheme", "http"), (":scheme", "https"),
    *((":status", x) for x in ("200", "204", "206", "304", "400", "404", "500")),
    ("accept-charset", ""), ("accept-encoding", "gzip, deflate"),
    *((x, "") for x in (
        "accept-language", "accept-ranges", "accept", "access-control-allow-origin", "age", "allow", "authorization", "cache-control", "content-disposition", "content-encoding", "content-language",
        "content-length", "content-location", "content-range", "content-type", "cookie", "date", "etag", "expect", "expires", "from", "host", "if-match", "if-modified-since", "if-none-match", "if-range",
        "if-unmodified-since", "last-modified", "link", "location", "max-forwards", "proxy-authenticate", "proxy-authorization", "range", "referer", "refresh", "retry-after", "server", "set-cookie",
        "strict-transport-security", "transfer-encoding", "user-agent", "vary", "via", "www-authenticate",
    )),
)


class HeaderTable:
    """HPACK decoding with the static and a dynamic table (D13a); Huffman strings are shown by their length."""

    def __init__(self, most: int = 4096) -> None:
        self.own: list[tuple[str, str]] = []  # newest first
        self.most = most

    def _shrink(self) -> None:
        size = sum(32 + len(n.encode()) + len(v.encode()) for n, v in self.own)
        while self.own and size > self.most:
            n, v = self.own.pop()
            size -= 32 + len(n.encode()) + len(v.encode())

    def entry(self, i: int) -> tuple[str, str] | None:
        table = STATIC if i <= len(STATIC) else self.own
        i -= 1 if i <= len(STATIC) else 1 + len(STATIC)
        return table[i] if 0 <= i < len(table) else None

    @staticmethod
    def integer(c: Cursor, prefix: int) -> int:
        most = (1 << prefix) - 1
        value = c.num(1) & most
        if value < most:
            return value
        for shift in range(0, 36, 7):
            b = c.num(1)
            value += (b & 127) << shift
            if b < 128:
                return value
            if shift >= 28:
                break
        raise Short

    def string(self, c: Cursor) -> str:
        if not c.rest():
            raise Short
        packed = c.data[c.at] >= 128
        raw = c.take(self.integer(c, 7))
        return f"<huffman:{len(raw)}b>" if packed else _text(raw)

    def literal(self, c: Cursor, prefix: int) -> tuple[str, str]:
        i = self.integer(c, prefix)
        if i:
            known = self.entry(i)
            if known is None:
                raise Short
            return known[0], self.string(c)
        return self.string(c), self.string(c)

    def decode(self, block: bytes) -> list[dict]:
        """The headers of a block, up to what can't be read."""
        c, out = Cursor(block), []
        try:
            while c.rest():
                b = block[c.at]
                if b >= 0x80:
                    i = self.integer(c, 7)
                    if not i:
                        break
                    found = self.entry(i)
                    if found is None:
                        continue
                elif b >= 0x40:
                    found = self.literal(c, 6)
                    self.own.insert(0, found)
                    self._shrink()
                elif b >= 0x20:
                    self.most = self.integer(c, 5)
                    self._shrink()
                    continue
                else:
                    found = self.literal(c, 4)
                out.append({"name": found[0], "value": found[1]})
        except Short:
            pass
        return out


def http2(stream: bytes) -> dict | None:
    """The frames after a connection preface (D13); header blocks are read unless padded or with a priority."""
    if not stream.startswith(PREFACE):
        return None
    c, table, frames = Cursor(stream, len(PREFACE)), HeaderTable(), []
    try:
        while c.rest() >= 9 and len(frames) < MOST_FRAMES:
            size, kind, flags, stream_id = c.num(3), c.num(1), c.num(1), c.num(4) & 0x7FFFFFFF
            body = c.take(size)
            plain = kind == 1 and not flags & 0x28
            frames.append({"stream_id": stream_id, "frame_type": kind, "flags": flags, "length": size, "headers": table.decode(body) if plain else []})
    except Short:
        pass
    return {"frames": frames}


def parse_one(data: bytes, at: int) -> dict:
    """The application layer of a TCP payload, the first of the four that fits."""
    for name, got in (("tls_client_hello", client_hello), ("tls_handshake", handshake), ("http2", lambda d, a: http2(d[a:])), ("http", lambda d, a: http(d[a:]))):
        found = got(data, at)
        if found is not None:
            return {name: found}
    return {}

"""WARC archives: written by Spark, read back by boundary-chain verification.

Reading.  A file is cut into chunks of bytes.  A task takes some hundred MB of chunks, one
after another, and looks for the magic line in each; every hit with a readable header is a candidate whose successor is
where its Content-Length says.  The magic may well stand inside a payload, so a
candidate is only a claim.  Within the chunk the task follows each candidate
to the first offset beyond the chunk; between chunks, pointers are doubled
from the start of the file, and only what is reached from there is a record.

Writing.  A record is a line of text whose separator is the two empty lines that
end a record, so Spark's own text writer (with its commit protocol, on any
file system) makes the archives.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Fixed values of the format.
VERSION = "WARC/1.1"
MAGIC = b"WARC/1.1\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:wireloom:page:"

#: Payloads from this size on are stored once.
REVISIT_LEAST = 100
#: Bytes of an archive that are looked through for candidates at a time, and bytes of chunks that one task gets.
CHUNK, TASK = 8 << 20, 256 << 20
#: Tasks for each core of the cluster at most, however large the archives are.
WAVES = 20
#: Bytes read beyond a chunk for headers that start in it, and at once for an HTTP header; longer WARC headers are read on to their end.
AHEAD = 64 << 10
#: Rows of a table of repeats up to which it goes to every executor whole (some 200 bytes each).
REPEATS_BOUND = 200_000


def _header(name: str, value: Column) -> Column:
    """A header line; line ends and other control characters in a value are percent-encoded; null: no line."""
    safe = value.cast("string")
    for c in ("\r", "\n", "\0", "\x0b", "\x0c"):
        safe = F.replace(safe, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return F.coalesce(F.concat(F.lit(name + ": "), safe, F.lit("\r\n")), F.lit(""))


def _roles(rows: DataFrame) -> DataFrame:
    """(rid, rurl, rdigest, of, copies) of the different (id, url, digest) that share a payload.

    ``of`` is the id of the payload's holder; null for the holder itself, which is
    listed only if ``copies`` rows agree in all three.
    """
    seen = rows.filter(F.col("size") >= REVISIT_LEAST).groupBy("digest", "id", "url").agg(F.count("*").alias("copies"))
    seen = common.written(seen, "warc-digests")
    order = F.struct(F.col("id").isNull().alias("n"), "id", F.col("url").isNull().alias("u"), "url")
    first = seen.groupBy("digest").agg(F.min(order).alias("first"), F.sum("copies").alias("rows")).filter("rows > 1")
    mine = F.col("id").eqNullSafe(F.col("first.id")) & F.col("url").eqNullSafe(F.col("first.url"))
    of = F.when(~mine, F.coalesce(F.col("first.id").cast("string"), F.lit("null")))
    out = seen.join(first, "digest").filter(~mine | (F.col("copies") > 1))
    return common.written(out.select(F.col("id").alias("rid"), F.col("url").alias("rurl"), F.col("digest").alias("rdigest"), of.alias("of"), "copies"), "warc-repeats")


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(record): the text of a WARC record per row, without the two empty lines at its end.

    Among rows of equal payloads of REVISIT_LEAST bytes or more the one with the
    smallest id holds it (of rows that share that id, the one with the smallest
    URL; of wholly equal rows, one); the others are revisits that refer to it.
    A null id comes after all others, a null payload is empty.  Payloads are
    compared by SHA-256.  Only digests are shuffled, unless the table of repeats
    is over REPEATS_BOUND rows; holders that stand there more than once are brought
    together as one row with a count.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    roles = _roles(rows)
    counts = roles.agg(F.count("*"), F.count(F.when(F.col("of").isNull(), 1))).head()
    hint = F.broadcast(roles) if counts[0] <= REPEATS_BOUND else roles
    same = F.col("id").eqNullSafe(F.col("rid")) & F.col("url").eqNullSafe(F.col("rurl")) & (F.col("digest") == F.col("rdigest"))
    rows = rows.join(hint, same, "left").select("id", "url", "payload", "size", "digest", "of", "copies")
    if counts[1]:
        held = F.col("copies").isNotNull() & F.col("of").isNull()
        twice = rows.filter(held).groupBy("id", "url", "size", "digest").agg(F.first("payload").alias("payload"), F.first("copies").alias("copies"))
        twice = twice.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        twice = twice.withColumn("of", F.when(F.col("k") > 1, F.coalesce(F.col("id").cast("string"), F.lit("null"))))
        rows = rows.filter(~held).unionByName(twice.drop("k"))
    again = F.col("of").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), _header("Content-Length", F.col("size")), F.lit("\r\n"))
    block = F.when(again, http).otherwise(F.concat(http, F.col("payload")))
    name = F.concat(F.lit(f"<{ID}"), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(">"))
    head = F.concat(
        F.lit(VERSION + "\r\n"),
        _header("WARC-Type", F.when(again, "revisit").otherwise("response")),
        _header("WARC-Record-ID", name),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(again, F.concat(_header("WARC-Profile", F.lit(PROFILE)), _header("WARC-Refers-To", F.concat(F.lit(f"<{ID}"), F.col("of"), F.lit(">"))))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
        _header("Content-Length", F.octet_length(block)),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(head, block).alias("record"))


def write(pages: DataFrame, folder: str, **columns: str) -> None:
    """Archives of ``pages`` in ``folder``, one file per task; see :func:`records`."""
    records(pages, **columns).write.option("lineSep", END).text(folder)


class Header:
    """A record's header: its fields, where its block starts, and where the next record does."""

    __slots__ = ("block", "fields", "length", "next")

    def __init__(self, fields: dict[str, str], at: int, size: int) -> None:
        self.fields = fields
        self.length = int(fields["content-length"])
        self.block = at + size
        self.next = self.block + self.length + len(END)


_LENGTH = re.compile(r"[0-9]{1,18}")


def header(data: bytes, at: int, base: int = 0) -> Header | None:
    """The header at ``data[at:]`` or None; ``base`` is added to its offsets."""
    if data[at : at + len(MAGIC)] != MAGIC:
        return None
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return None
    fields: dict[str, str] = {}
    for line in data[at + len(MAGIC) : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields.setdefault(name.strip().lower().decode("latin-1"), value.strip().decode("utf-8", "replace"))
    if not _LENGTH.fullmatch(fields.get("content-length", "")):
        return None
    return Header(fields, base + at, end + 4 - at)


def header_at(f, off: int, step: int = 2048) -> Header | None:
    """The header at an offset of an open file, however long it is: twice as much is read until its end is there.

    A record ends with two empty lines, so the search ends within the record
    whatever the bytes at ``off`` are.
    """
    while True:
        f.seek(off)
        data = f.read(step)
        if data[: len(MAGIC)] != MAGIC:
            return None
        if b"\r\n\r\n" in data or len(data) < step:
            return header(data, 0, off)
        step *= 2


def _length(line: bytes) -> bytes | None:
    """The value of a header line if it is the block's length."""
    name, _, value = line.partition(b":")
    return value.strip() if name.strip().lower() == b"content-length" else None


class _Rest:
    """What a header says from some line on: where it ends, whether every line is a field, and the first length among them."""

    __slots__ = ("end", "length", "sound")

    def __init__(self, end: int, sound: bool = True, length: bytes | None = None) -> None:
        self.end, self.sound, self.length = end, sound, length

    def before(self, lines: list[bytes]) -> _Rest:
        """The same from ``lines`` on, which come right before."""
        stated = (x for line in lines if (x := _length(line)) is not None)
        return _Rest(self.end, self.sound and all(b":" in line for line in lines), next(stated, self.length))


def _beyond(f, at: int, size: int) -> _Rest | None:
    """The header from its fields at offset ``at`` on, read in pieces; None as soon as a line isn't a field, or at the file's end.

    Of a line of more than AHEAD bytes only its colon counts.
    """
    f.seek(at)
    kept, end, cut, colon, length = b"", at, False, False, None
    while piece := f.read(min(AHEAD, max(0, size - f.tell()))):
        *whole, kept = (kept + piece).split(b"\r\n")
        for line in whole:
            end += len(line) + 2
            if not line and not cut:
                return _Rest(end, True, length)
            if not colon and b":" not in line:
                return None
            length = _length(line) if length is None and not cut else length
            cut = colon = False
        if len(kept) > AHEAD:
            cut, colon, end, kept = True, colon or b":" in kept, end + len(kept) - 1, kept[-1:]
    return None


def candidates(f, lo: int, hi: int, size: int) -> list[tuple[int, int]]:
    """(offset, successor) claims of the records that start in the bytes ``lo`` to ``hi`` of an open file.

    Hits are taken from the last to the first.  Hits whose header runs to the
    same empty line share the fields behind the later one, so every byte is
    split into fields once however many hits there are, and a header that
    leaves the bytes at hand is read on once for all of them.
    """
    f.seek(lo)
    data = f.read(min(size, hi + AHEAD) - lo)
    hits, at = [], data.find(MAGIC)
    while 0 <= at < hi - lo:
        hits.append(at)
        at = data.find(MAGIC, at + 1)
    out: list[tuple[int, int]] = []
    rest: _Rest | None = None
    until = len(data)  # where the hit after this one stands
    for at in reversed(hits):
        fields = at + len(MAGIC)
        end = data.find(b"\r\n\r\n", at, min(len(data), until + 3))
        if end >= 0:
            rest = _Rest(lo + end + 4).before(data[fields:end].split(b"\r\n") if end >= fields else [])
        elif until == len(data):
            rest = _beyond(f, lo + fields, size)
        elif rest is not None:
            rest = rest.before(data[fields : until + len(MAGIC) - 2].split(b"\r\n"))
        until = at
        if rest is not None and rest.sound and rest.length is not None and _LENGTH.fullmatch(rest.length.decode("latin-1")):
            out.append((lo + at, rest.end + int(rest.length) + len(END)))
    return out[::-1]


def _claims(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk: every candidate with the offset beyond the chunk that following it leads to."""
    for b in batches:
        for path, size, lo in zip(*(b.column(i).to_pylist() for i in range(3))):
            hi = min(size, lo + CHUNK)
            fs, at = common.file_system(path)
            with fs.open_input_file(at) as f:
                found = candidates(f, lo, hi, size)
            leads: dict[int, int] = {}
            for off, nxt in reversed(found):  # a successor in the chunk stands later in it
                leads[off] = nxt if nxt >= hi else leads.get(nxt, -1)
            n = len(leads)
            yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(list(leads), pa.int64()), pa.array(list(leads.values()), pa.int64())], names=["path", "off", "out"])


def _tasks(spark: SparkSession, chunks: int) -> int:
    """How many tasks work through so many chunks: two a core at least if there are as many chunks, WAVES a core at most."""
    cores = spark.sparkContext.defaultParallelism
    return max(1, min(chunks, max(2 * cores, min(WAVES * cores, chunks * CHUNK // TASK))))


def _chunks(files: DataFrame) -> DataFrame:
    rows = files.filter("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(CHUNK).cast("long"))).alias("lo"))
    n = files.agg(F.coalesce(F.sum(F.ceil(F.col("length") / CHUNK)), F.lit(0))).head()[0]
    return rows.repartition(_tasks(files.sparkSession, int(n)))


def entries(files: DataFrame) -> DataFrame:
    """(path, off): of each chunk the first true record in it, for ``files(path, length)``.

    A candidate's pointer is where its chain leaves the chunk.  Pointers are
    doubled: what is reached in 2^k steps reaches as much again with pointers of
    2^k steps, so the rounds are the logarithm of a file's chunks.
    """
    claims = common.written(_chunks(files).mapInArrow(_claims, "path string, off long, out long"), "warc-claims")
    hop = claims.filter("out >= 0").select("path", "off", "out")
    start = files.filter("length > 0").select("path", F.lit(0).cast("long").alias("off"))
    reached = common.written(start.join(claims.select("path", "off"), ["path", "off"], "left_semi"), "warc-reached")
    while True:
        step = reached.join(hop, ["path", "off"]).select("path", F.col("out").alias("off"))
        more = step.join(claims.select("path", "off"), ["path", "off"], "left_semi")
        new = common.written(reached.union(more).distinct(), "warc-reached")
        grown = new.count() > reached.count()
        common.dropped(reached)
        reached = new
        if not grown:
            common.dropped(claims)
            common.dropped(hop)
            return reached
        on = hop.select("path", F.col("off").alias("out"), F.col("out").alias("far"))
        far = common.written(hop.join(on, ["path", "out"]).select("path", "off", F.col("far").alias("out")), "warc-hop")
        common.dropped(hop)
        hop = far


_HTTP_LENGTH = re.compile(rb"^content-length:[ \t]*([0-9]{1,18})[ \t]*\r?$", re.I | re.M)


def _payload(f, h: Header) -> tuple[int, int, str]:
    """(payload bytes in the block, the HTTP header's length claim or -1, SHA-256), read in pieces."""
    f.seek(h.block)
    left = h.length
    head = f.read(min(left, AHEAD))
    claim, sha, size = -1, hashlib.sha256(), 0
    if h.fields.get("content-type", "").startswith("application/http"):
        cut = head.find(b"\r\n\r\n")
        if cut >= 0:
            m = _HTTP_LENGTH.search(head[:cut])
            claim = int(m[1]) if m else -1
            left -= cut + 4
            head = head[cut + 4 :]
    while True:
        sha.update(head)
        size += len(head)
        left -= len(head)
        if left <= 0 or not (head := f.read(min(left, 1 << 20))):
            return size, claim, sha.hexdigest()


_FIELDS = "path string, off long, type string, record_id string, refers string, uri string, size long, claim long, digest string, stated string"


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _FIELDS.split(", ")]
    kinds = [pa.int64() if x.endswith("long") else pa.string() for x in _FIELDS.split(", ")]
    for b in batches:
        for path, size, off in zip(*(b.column(i).to_pylist() for i in range(3))):
            hi = min(size, off // CHUNK * CHUNK + CHUNK)
            fs, at = common.file_system(path)
            rows = []
            with fs.open_input_file(at) as f:
                while off < hi:
                    h = header_at(f, off)
                    if h is None:
                        break  # a damaged file: what its chain doesn't reach isn't a record
                    n, claim, sha = _payload(f, h)
                    g = h.fields.get
                    rows.append((path, off, g("warc-type"), g("warc-record-id"), g("warc-refers-to"), g("warc-target-uri"), n, claim, sha, g("warc-payload-digest")))
                    off = h.next
            cols = list(zip(*rows)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All records of the archives in ``folder``: place, type, ids, URI, payload size and digests.

    ``digest`` is of the payload bytes in the record, ``stated`` what the header
    says, ``size`` the payload's bytes there and ``claim`` the HTTP header's length.
    An empty folder gives an empty table.
    """
    common.shipped(spark)
    files = common.written(spark.read.format("binaryFile").load(folder).select("path", "length"), "warc-files")
    first = entries(files).join(files, "path").select("path", "length", "off")
    first = first.repartition(_tasks(spark, first.count()), "path", "off")
    return first.mapInArrow(_records, _FIELDS)


def resolved(found: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id_col, payload_bytes, payload_digest, record_type, refers_to): each record with its full payload's size and digest.

    A response's are of the bytes read; a revisit takes them from the response
    it refers to, met by the stated digest and the record id.
    """
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<{ID}(-?[0-9]+)>', 1) as long)")
    found = common.written(found, "warc-records")
    own = found.filter("type = 'response'").select(page("record_id").alias(id_col), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    again = found.filter("type = 'revisit'").select(page("record_id").alias(id_col), "refers", "stated")
    wanted = again.select("refers", "stated").distinct()
    held = found.filter("type = 'response'").select(F.col("record_id").alias("refers"), F.concat(F.lit("sha256:"), F.col("digest")).alias("stated"), "size", "digest")
    held = held.join(wanted, ["refers", "stated"], "left_semi").distinct()
    rest = again.join(held, ["refers", "stated"], "left").select(id_col, F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), page("refers").alias("refers_to"))
    return own.unionByName(rest)

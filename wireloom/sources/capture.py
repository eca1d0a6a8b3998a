"""Capture files: pcap and pcapng as a data source, a stream, and two sinks.

``spark.read.format("capture").load(path)`` gives (number, ts, wire_len, data,
linktype, file).  A file is one split, since its record boundaries need a walk;
numbers start from 0 in each file.  Reading goes by blocks, so a task holds one
block of records and not the file.
"""

from __future__ import annotations

import datetime as dt
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..session import input_bytes, ship

SCHEMA = "number long, ts timestamp, wire_len long, data binary, linktype int, file string"
BATCH = 2048
#: Bytes of input that go to one written file.
FILE_BYTES = 128 << 20
#: Larger records are damage, not packets: a file with one is refused.
MOST_RECORD = 1 << 26

# Fixed values of the two formats.
PCAP_MAGIC = {0xA1B2C3D4: 1, 0xA1B23C4D: 1000}
SECTION, INTERFACE, SIMPLE, ENHANCED, BYTE_ORDER = 0x0A0D0D0A, 1, 3, 6, 0x1A2B3C4D
SNAP_LENGTH = 65535


class CaptureError(ValueError):
    """Bytes that are no capture file."""


def _exact(f, n: int) -> bytes | None:
    """``n`` bytes, or None if fewer are left: a truncated tail ends the scan."""
    got = f.read(n)
    return got if len(got) == n else None


def _pcap(f, order: str, per_micro: int) -> Iterator[tuple[int, int, bytes, int]]:
    head = _exact(f, 20)
    if head is None:
        raise CaptureError("the file header is cut off")
    *_, linktype = struct.unpack(order + "HHiIII", head)
    record = struct.Struct(order + "IIII")
    while (raw := _exact(f, 16)) is not None:
        sec, frac, size, wire = record.unpack(raw)
        if size > MOST_RECORD:
            raise CaptureError(f"a record claims {size} bytes, which is over {MOST_RECORD}")
        if (data := _exact(f, size)) is None:
            return
        yield sec * 1_000_000 + frac // per_micro, wire, data, linktype & 0x0FFFFFFF


def _options(body: bytes, order: str) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 4 <= len(body):
        code, size = struct.unpack_from(order + "HH", body, at)
        if code == 0:
            return
        yield code, body[at + 4 : at + 4 + size]
        at += 4 + (size + 3) // 4 * 4


def _pcapng(f) -> Iterator[tuple[int, int, bytes, int]]:
    order, links = "<", []
    kind: bytes | None = struct.pack("<I", SECTION)
    while kind is not None:
        if kind == struct.pack("<I", SECTION):
            head = _exact(f, 8)
            if head is None:
                return
            order = "<" if struct.unpack("<I", head[4:])[0] == BYTE_ORDER else ">"
            size, links = struct.unpack(order + "I", head[:4])[0], []
            if _exact(f, size - 12) is None:
                return
        else:
            got = _exact(f, 4)
            if got is None:
                return
            size = struct.unpack(order + "I", got)[0]
            if not 12 <= size <= MOST_RECORD:
                raise CaptureError(f"a block claims {size} bytes, which isn't from 12 to {MOST_RECORD}")
            if (body := _exact(f, size - 8)) is None:
                return
            body, block = body[:-4], struct.unpack(order + "I", kind)[0]
            if block == INTERFACE:
                unit = 10**6
                for code, value in _options(body[8:], order):
                    if code == 9 and value:
                        unit = 1 << (value[0] & 127) if value[0] & 128 else 10 ** value[0]
                links.append((struct.unpack_from(order + "H", body)[0], unit))
            elif block == ENHANCED and len(body) >= 20:
                port, high, low, n, wire = struct.unpack_from(order + "IIIII", body)
                if port < len(links):
                    link, unit = links[port]
                    yield (high << 32 | low) * 10**6 // unit, wire, body[20 : 20 + n], link
            elif block == SIMPLE and links:
                wire = struct.unpack_from(order + "I", body)[0]
                yield 0, wire, body[4 : 4 + wire], links[0][0]
        kind = _exact(f, 4)


def records(f) -> Iterator[tuple[int, int, bytes, int]]:
    """(microseconds, wire length, bytes, linktype) of an open capture file of either format."""
    magic = _exact(f, 4)
    if magic is None:
        raise CaptureError("no capture file: it is empty")
    for order in "<>":
        unit = PCAP_MAGIC.get(struct.unpack(order + "I", magic)[0])
        if unit:
            return _pcap(f, order, unit)
    if magic == struct.pack("<I", SECTION):
        return _pcapng(f)
    raise CaptureError(f"no capture file: it starts with {magic.hex()}")


def file_system(uri: str):
    """(file system, path) of a URI or a plain path."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def batches(f, name: str, below: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of an open file, a few thousand at a time; numbers below ``below`` only."""
    rows: list[tuple] = []
    kinds = [pa.int64(), pa.timestamp("us", "UTC"), pa.int64(), pa.binary(), pa.int32(), pa.string()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def made() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        rows.clear()
        return out

    for i, (us, wire, data, link) in enumerate(records(f)):
        if below is not None and i >= below:
            break
        rows.append((i, us, wire, data, link, name))
        if len(rows) == BATCH:
            yield made()
    if rows:
        yield made()


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path, self.below = path, None

    def pushFilters(self, filters):
        """An upper bound on the number ends the walk early; other filters stay with Spark."""
        for f in filters:
            if isinstance(f, LessThan | LessThanOrEqual) and f.attribute == ("number",):
                n = f.value + isinstance(f, LessThanOrEqual)
                self.below = n if self.below is None else min(self.below, n)
            yield f

    def partitions(self):
        from pyarrow import fs as pafs

        fs, at = file_system(self.path)
        info = fs.get_file_info(at)
        if info.type == pafs.FileType.Directory:
            found = [i.path for i in fs.get_file_info(pafs.FileSelector(at)) if i.type == pafs.FileType.File and not i.base_name.startswith(("_", "."))]
        else:
            found = [at]
        self.scheme = self.path.split("://")[0] + "://" if "://" in self.path and not self.path.startswith("file:") else ""
        return [_File(self.scheme + p) for p in sorted(found)] or [_File("")]

    def read(self, partition):
        if partition.path:
            fs, at = file_system(partition.path)
            with fs.open_input_stream(at) as f:
                yield from batches(f, partition.path.rsplit("/", 1)[-1], self.below)


def pcap_header(linktype: int, snaplen: int) -> bytes:
    return struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, snaplen, linktype)


def pcap_record(us: int, wire: int, data: bytes) -> bytes:
    return struct.pack("<IIII", us // 1_000_000, us % 1_000_000, len(data), wire) + data


def pcapng_header(linktype: int, snaplen: int) -> bytes:
    return struct.pack("<IIIHHqI", SECTION, 28, BYTE_ORDER, 1, 0, -1, 28) + struct.pack("<IIHHII", INTERFACE, 20, linktype, 0, snaplen, 20)


def pcapng_record(us: int, wire: int, data: bytes) -> bytes:
    pad, us = -len(data) % 4, max(0, us)
    size = 32 + len(data) + pad
    return struct.pack("<IIIIIII", ENHANCED, size, 0, us >> 32, us & 0xFFFFFFFF, len(data), wire) + data + bytes(pad) + struct.pack("<I", size)


FORMATS = {"pcap": (pcap_header, pcap_record), "pcapng": (pcapng_header, pcapng_record)}


@dataclass
class _Written(WriterCommitMessage):
    tmp: str
    final: str


class _Writer(DataSourceWriter):
    """A file per task, under a name of the attempt until the job commits."""

    def __init__(self, options: dict, columns: list[str], overwrite: bool) -> None:
        self.folder = options["path"]
        self.kind = options.get("container", "pcap")
        if self.kind not in FORMATS:
            raise ValueError(f"container is pcap or pcapng, not {self.kind!r}")
        self.linktype, self.snaplen = int(options.get("linktype", 1)), int(options.get("snaplen", SNAP_LENGTH))
        self.columns, self.overwrite = columns, overwrite

    def write(self, iterator):
        from pyspark import TaskContext

        fs, base = file_system(self.folder)
        part = TaskContext.get().partitionId()
        fs.create_dir(f"{base}/_tmp", recursive=True)
        tmp = f"{base}/_tmp/{uuid.uuid4().hex}"
        head, record = FORMATS[self.kind]
        epoch = dt.datetime(1970, 1, 1)
        n = 0
        with fs.open_output_stream(tmp) as f:
            f.write(head(self.linktype, self.snaplen))
            for row in iterator:
                ts = row["ts"]
                us = (ts.astimezone(dt.UTC).replace(tzinfo=None) - epoch) // dt.timedelta(microseconds=1)
                f.write(record(us, row["wire_len"], bytes(row["data"] or b"")))
                n += 1
        return _Written(tmp, f"{base}/part-{part:05d}.{self.kind}" if n or part == 0 else "")

    def commit(self, messages):
        fs, base = file_system(self.folder)
        if self.overwrite:
            from pyarrow import fs as pafs

            for i in fs.get_file_info(pafs.FileSelector(base)):
                if i.type == pafs.FileType.File:
                    fs.delete_file(i.path)
        for m in messages:
            if m and m.final:
                fs.move(m.tmp, m.final)
        fs.delete_dir(f"{base}/_tmp")

    def abort(self, messages):
        fs, _ = file_system(self.folder)
        for m in messages:
            if m:
                fs.delete_file(m.tmp)


class CaptureSource(DataSource):
    """The ``capture`` format."""

    @classmethod
    def name(cls):
        return "capture"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite):
        return _Writer(dict(self.options), schema.names, overwrite)


def register(spark: SparkSession) -> None:
    """Makes ``format("capture")`` known to a session, which has to push filters down to Python sources for it."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CaptureSource)


def read(spark: SparkSession, path: str, capture_filter: str | None = None) -> DataFrame:
    """A capture file, or all files of a folder (K1, Q14), through an optional capture filter."""
    register(spark)
    rows = spark.read.format("capture").load(path)
    if capture_filter is None:
        return rows
    from ..plans.bpf import captured

    return captured(rows, capture_filter)


def write(packets: DataFrame, folder: str, container: str = "pcap", files: int | None = None, linktype: int = 1, snaplen: int = SNAP_LENGTH, mode: str = "overwrite") -> None:
    """Packets by ascending number into ``files`` files, each of a range of numbers (K4-K6).

    Without ``files`` there are as many as the input has splits' worth of bytes, one for a
    small input; no task writes more than about that.
    A link type of 228 is written as 101, the other raw-IP one.  The default
    link type and snap length are what a live capture is saved with.
    """
    register(packets.sparkSession)
    if files is None:
        files = max(1, -(-(input_bytes(packets) or 0) // FILE_BYTES))
    rows = packets.select("number", F.col("ts").cast("timestamp").alias("ts"), "wire_len", "data")
    rows = rows.coalesce(1).sortWithinPartitions("number") if files == 1 else rows.repartitionByRange(files, "number").sortWithinPartitions("number")
    link = 101 if linktype == 228 else linktype
    rows.write.format("capture").mode(mode).option("container", container).option("linktype", link).option("snaplen", snaplen).save(folder)


def _parse_files(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in rows:
        for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            yield from batches(pa.BufferReader(content), path.rsplit("/", 1)[-1])


def stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Rotated capture files of a folder as a stream, as they come."""
    ship(spark)
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content").mapInArrow(_parse_files, SCHEMA)


def interfaces(spark: SparkSession, folder: str) -> DataFrame:
    """(file, linktype, packets): what a folder holds, in place of a host's interfaces (K8)."""
    return read(spark, folder).groupBy("file", "linktype").agg(F.count("*").alias("packets"))

"""Address ranges out of a MaxMind DB file (K9), by the format's published description.

The file is a binary search tree over address bits, whose leaves point into a section
of typed records.  Its networks are found by walking the tree, not by asking
for addresses: each task walks what lies under some first octets.
"""

from __future__ import annotations

import mmap
import struct
from collections.abc import Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import ship

# What the metadata follows, how far from the end it may be, and the gap after the tree.
MARK, NEAR_END, GAP = b"\xab\xcd\xefMaxMind.com", 128 << 10, 16
# What is added to a size or a pointer of each number of further bytes.
SIZE_BASE, POINTER_BASE = {29: 29, 30: 285, 31: 65821}, (0, 2048, 526336, 0)
# Type numbers of the format.
POINTER, TEXT, DOUBLE, BYTES, UINT16, UINT32, MAP, INT32, UINT64, UINT128, ARRAY, BOOL, FLOAT = 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 14, 15
#: Where a column's value is in a record.
FIELDS = {"country": ("country", "iso_code"), "asn": ("autonomous_system_number",), "as_org": ("autonomous_system_organization",)}
#: Deeper records than this are not believed.
DEEPEST = 64
ROWS = 8192


class BadDatabase(ValueError):
    """A file that is no database, or a broken one."""


class Records:
    """The typed records that start at ``base`` of ``data``; pointers count from there."""

    def __init__(self, data: bytes | mmap.mmap, base: int) -> None:
        self.data, self.base = data, base

    def _bytes(self, at: int, n: int) -> bytes:
        got = self.data[at : at + n]
        if len(got) < n:
            raise BadDatabase("a record ends beyond the file")
        return got

    def _number(self, at: int, n: int) -> int:
        return int.from_bytes(self._bytes(at, n), "big")

    def read(self, offset: int) -> Any:
        """The record at an offset from the base."""
        return self._read(self.base + offset, 0)[0]

    def _read(self, at: int, depth: int) -> tuple[Any, int]:
        if depth > DEEPEST:
            raise BadDatabase("records are nested too deeply")
        control, at = self._number(at, 1), at + 1
        kind = control >> 5
        if kind == POINTER:
            more = (control >> 3 & 3) + 1
            high = (control & 7) << 8 * more if more < 4 else 0
            return self._read(self.base + high + self._number(at, more) + POINTER_BASE[more - 1], depth + 1)[0], at + more
        if kind == 0:
            kind, at = self._number(at, 1) + 7, at + 1
        size = control & 31
        if size in SIZE_BASE:
            more = size - 28
            size, at = SIZE_BASE[size] + self._number(at, more), at + more
        if kind == MAP:
            out = {}
            for _ in range(size):
                key, at = self._read(at, depth + 1)
                out[key], at = self._read(at, depth + 1)
            return out, at
        if kind == ARRAY:
            items = []
            for _ in range(size):
                item, at = self._read(at, depth + 1)
                items.append(item)
            return items, at
        if kind == BOOL:
            return bool(size), at
        raw, at = self._bytes(at, size), at + size
        if kind == TEXT:
            return raw.decode("utf-8", "replace"), at
        if kind in (UINT16, UINT32, UINT64, UINT128):
            return int.from_bytes(raw, "big"), at
        if kind == INT32:
            return int.from_bytes(raw, "big", signed=size == 4), at
        if kind == BYTES:
            return raw, at
        if (kind, size) in ((DOUBLE, 8), (FLOAT, 4)):
            return struct.unpack(">d" if kind == DOUBLE else ">f", raw)[0], at
        raise BadDatabase(f"a record of type {kind} and size {size}")


class Database:
    """A file's tree and records."""

    def __init__(self, data: bytes | mmap.mmap) -> None:
        self.data = data
        at = data.rfind(MARK, max(0, len(data) - NEAR_END))
        if at < 0:
            raise BadDatabase("there is no metadata")
        about = Records(data, at + len(MARK)).read(0)
        try:
            self.nodes, self.bits, self.version = int(about["node_count"]), int(about["record_size"]), int(about["ip_version"])
        except (KeyError, TypeError, ValueError) as e:
            raise BadDatabase(f"the metadata lacks {e}") from e
        if self.bits not in (24, 28, 32) or self.version not in (4, 6) or self.nodes * self.bits // 4 + GAP > at:
            raise BadDatabase(f"{self.nodes} nodes of twice {self.bits} bits, version {self.version}")
        self.records = Records(data, self.nodes * self.bits // 4 + GAP)

    def child(self, node: int, side: int) -> int:
        """What a node holds for a bit: below the number of nodes a node, that number nothing, above it a record."""
        width = self.bits // 4
        raw = self.data[node * width : node * width + width]
        if self.bits == 28:
            high = raw[3] >> 4 if side == 0 else raw[3] & 15
            return high << 24 | int.from_bytes(raw[4 * side : 4 * side + 3], "big")
        half = width // 2
        return int.from_bytes(raw[half * side : half * side + half], "big")

    def roots(self, size: int) -> int:
        """Where addresses of ``size`` bytes start: version 4 ones have 96 zero bits before them in a tree of version 6."""
        node = 0
        if size == 4 and self.version == 6:
            for _ in range(96):
                if node >= self.nodes:
                    break
                node = self.child(node, 0)
        return node

    def networks(self, size: int, octet: int) -> Iterator[tuple[int, int, int]]:
        """(first, last, record offset) of the networks whose addresses have ``size`` bytes and this first octet.

        A network that spans several first octets comes once in each, cut to it.
        """
        if size == 16 and self.version == 4:
            return
        width, node, depth = 8 * size, self.roots(size), 0
        while depth < 8 and node < self.nodes:
            node, depth = self.child(node, octet >> 7 - depth & 1), depth + 1
        stack = [(node, octet << width - 8, 8)]
        while stack:
            node, first, depth = stack.pop()
            if node > self.nodes:
                yield first, first + (1 << width - depth) - 1, node - self.nodes - GAP
            elif node < self.nodes:
                if depth == width:
                    raise BadDatabase("the tree is deeper than an address")
                stack += ((self.child(node, 1), first | 1 << width - depth - 1, depth + 1), (self.child(node, 0), first, depth + 1))


def opened(path: str | Path) -> Database:
    """The database in a file of this machine."""
    with open(path, "rb") as f:
        try:
            return Database(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
        except ValueError as e:  # an empty file can't be mapped
            raise BadDatabase(str(e)) from e


def _found(record: Any, path: tuple[str, ...]) -> Any:
    for part in path:
        record = record.get(part) if isinstance(record, dict) else None
    return record


def networks(spark: SparkSession, path: str, columns: str) -> DataFrame | None:
    """(start_ip, end_ip, ...) of a database's networks, version 4 ones with four bytes; None if it isn't there or is broken.

    ``columns`` is a schema of names among :data:`FIELDS`; networks without any of them
    are left out.  Every executor gets the file once, through Spark's own file shipping (so two
    databases of a session need different names), and maps it; a task holds one batch of rows.
    Records are remembered by their offset, as many networks share one.
    """
    kinds = StructType.fromDDL(columns)
    if unknown := [n for n in kinds.names if n not in FIELDS]:
        raise ValueError(f"no such field: {unknown}")
    try:
        spark.sparkContext.addFile(path)
    except Exception as e:  # noqa: BLE001
        if "FileNotFound" not in str(e):
            raise
        return None
    name = path.rstrip("/").rsplit("/", 1)[-1]
    try:
        opened(SparkFiles.get(name))
    except BadDatabase:
        return None
    ship(spark)
    paths = [FIELDS[n] for n in kinds.names]
    schema = StructType.fromDDL(f"start_ip binary, end_ip binary, {columns}")
    arrow = to_arrow_schema(schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db, known, rows = opened(SparkFiles.get(name)), {}, []
        for batch in batches:
            for part in batch.column(0).to_pylist():
                size, octet = (4, part) if part < 256 else (16, part - 256)
                for first, last, at in db.networks(size, octet):
                    if at not in known:
                        record = db.records.read(at)
                        known[at] = tuple(_found(record, p) for p in paths)
                    if any(v is not None for v in known[at]):
                        rows.append((first.to_bytes(size, "big"), last.to_bytes(size, "big"), *known[at]))
                    if len(rows) == ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)

    # neighbouring octets are of one registry and fill alike: they are dealt out by a hash
    parts = spark.range(512).repartition(max(spark.sparkContext.defaultParallelism, 64), F.xxhash64("id"))
    return parts.mapInArrow(walk, schema)

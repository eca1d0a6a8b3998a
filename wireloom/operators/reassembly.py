"""TCP stream reassembly and following a stream."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bytes import cut
from .flows import KEY, keyed
from .folds import fold

#: Bytes a direction; beyond that the stream takes no more.
MOST = 1 << 20
RING = 1 << 32


@dataclass
class Stream:
    """One direction: contiguous bytes from the first segment on, and segments that wait.

    Sequence numbers compare serially.  The first copy of a byte wins; data
    before the first segment is a duplicate; a waiting segment is taken only when
    the contiguous part ends exactly where it starts.  Beyond MOST bytes the
    stream is capped for good.
    """

    next: int | None = None
    ready: bytearray = field(default_factory=bytearray)
    waiting: dict[int, bytes] = field(default_factory=dict)
    held: int = 0
    capped: bool = False
    fin: bool = False

    def insert(self, seq: int, data: bytes) -> str:
        """``contiguous``, ``gap``, ``duplicate``, ``capped``, or ``buffered`` for no data."""
        if not data:
            return "buffered"
        if self.next is None:
            self.next = seq
        ahead = (seq + len(data) - self.next) % RING
        if ahead == 0 or ahead > RING // 2:
            return "duplicate"
        late = (self.next - seq) % RING
        if 0 < late <= RING // 2:
            data, seq = data[late:], self.next
            if not data:
                return "duplicate"
        if self.capped or self.held + len(data) > MOST:
            self.capped = True
            return "capped"
        if seq != self.next:
            if seq in self.waiting:
                return "duplicate"
            self.waiting[seq] = data
            self.held += len(data)
            return "gap"
        self.held += len(data)
        while data is not None:
            self.ready += data
            self.next = (self.next + len(data)) % RING
            data = self.waiting.pop(self.next, None)
        return "contiguous"

    def drain(self) -> bytes | None:
        """The contiguous bytes so far, taken out; None if there are none."""
        if not self.ready:
            return None
        out = bytes(self.ready)
        self.held -= len(out)
        self.ready.clear()
        return out

    @property
    def complete(self) -> bool:
        """A FIN was seen and nothing waits."""
        return self.fin and not self.waiting


def segments(packets: DataFrame) -> DataFrame:
    """TCP payloads with flow key, direction and sequence number."""
    src, dst = F.coalesce("ipv4.src_ip", "ipv6.src_ip"), F.coalesce("ipv4.dst_ip", "ipv6.dst_ip")
    data = cut(F.col("data"), F.col("payload.offset"), F.col("payload.len"))
    rows = packets.filter(F.col("tcp").isNotNull() & F.col("payload").isNotNull()).select(
        "number", src.alias("src_ip"), F.col("tcp.src_port").alias("src_port"), dst.alias("dst_ip"), F.col("tcp.dst_port").alias("dst_port"), F.lit(6).alias("protocol"), F.col("tcp.seq_num").alias("seq"), data.alias("data")
    )
    return keyed(rows)


def segment_step(state: Stream | None, row: dict) -> tuple[Stream, list[tuple]]:
    state = state or Stream()
    state.insert(row["seq"], row["data"])
    return state, []


def _done(key: tuple, s: Stream) -> list[tuple]:
    return [(*key, bytes(s.ready), s.held - len(s.ready), s.capped)]


STREAMS = "low_ip binary, low_port int, high_ip binary, high_port int, protocol int, low_to_high boolean, bytes binary, waiting_bytes long, capped boolean"


def streams(parts: DataFrame) -> DataFrame:
    """The contiguous prefix of every direction of every flow (W10); at most MOST bytes a row."""
    keys = [*KEY, "low_to_high"]
    return fold(parts.select(*keys, "number", "seq", "data"), keys, ["number"], segment_step, STREAMS, finish=_done)


def followed(parts: DataFrame) -> DataFrame:
    """One row per flow with both directions: the low end is the client, whoever sent the first SYN."""
    up = F.col("low_to_high")
    return streams(parts).groupBy(*KEY).agg(F.coalesce(F.max(F.when(up, F.col("bytes"))), F.lit(bytearray())).alias("client"), F.coalesce(F.max(F.when(~up, F.col("bytes"))), F.lit(bytearray())).alias("server"))

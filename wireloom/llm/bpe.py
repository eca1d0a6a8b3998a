"""Byte-level BPE by a hierarchical-bitmap rank queue.

The pairs of a pre-token wait in buckets, one per merge rank; a two-level bitmap
says which buckets hold anything, and find-first-set gives the lowest rank.  A
bucket holds positions of a linked list of byte ranges, the leftmost first;
positions whose pair has changed since are skipped when they come up.  The cost
of a merge doesn't depend on how long the pre-token is.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bits of a leaf word of the bitmap; its top word has about as many for a vocabulary of 50,000.
LEAF = 8
MASK = (1 << LEAF) - 1
BIT = [1 << i for i in range(4096)]
#: Pre-tokens a worker remembers at most.  The memory has two halves: when the
#: young one is full it becomes the old one, and what is met again moves back.
REMEMBERED = 600_000
#: Longer pre-tokens (in code points) are encoded each time.
REMEMBER_LONGEST = 64


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of ``base64 rank`` lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class RankQueue:
    """Buckets of positions by rank, with the lowest rank at hand."""

    def __init__(self, ranks: int) -> None:
        if ranks >> LEAF >= len(BIT):
            raise ValueError(f"two levels serve {len(BIT) << LEAF} ranks, not {ranks}")
        self.leaf = [0] * ((ranks >> LEAF) + 1)
        self.top = 0
        self.bucket: dict[int, list[int]] = {}

    def push(self, rank: int, at: int) -> None:
        held = self.bucket.get(rank)
        if held is not None:
            heappush(held, at)
            return
        self.bucket[rank] = [at]
        word = rank >> LEAF
        self.leaf[word] |= BIT[rank & MASK]
        self.top |= 1 << word

    def pop(self) -> tuple[int, int] | None:
        """The lowest rank with its leftmost position, or None.

        :func:`encode_piece` has the same steps written out, for speed, with the
        top word in a local variable; it leaves the queue empty.
        """
        top = self.top
        if not top:
            return None
        word = (top & -top).bit_length() - 1
        low = self.leaf[word]
        rank = (word << LEAF) + (low & -low).bit_length() - 1
        held = self.bucket[rank]
        at = heappop(held)
        if not held:
            del self.bucket[rank]
            self.leaf[word] = low = low & (low - 1)
            if not low:
                self.top = top & (top - 1)
        return rank, at


def encode_piece(piece: bytes, ranks: dict[bytes, int], queue: RankQueue | None = None) -> list[int]:
    """The ids of one pre-token: lowest rank first, of equal ranks the leftmost."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    queue = queue or RankQueue(max(ranks.values()) + 1)
    get, leaf, bucket, bit = ranks.get, queue.leaf, queue.bucket, BIT
    nxt = list(range(1, n + 2))  # where the token at a position ends
    prv = list(range(-1, n))
    pair = [get(piece[i : i + 2], -1) for i in range(n - 1)]  # rank of the pair that starts here
    top = 0
    for i, r in enumerate(pair):
        if r >= 0:
            held = bucket.get(r)
            if held is None:
                bucket[r] = [i]
                word = r >> LEAF
                leaf[word] |= bit[r & MASK]
                top |= bit[word]
            else:
                held.append(i)  # ascending, so it is a heap
    pair += (-1, -1)
    while top:
        # find-first-set, in the top word and then in its leaf
        word = (top & -top).bit_length() - 1
        low = leaf[word]
        first = low & -low
        rank = (word << LEAF) + first.bit_length() - 1
        held = bucket[rank]
        if len(held) > 1:
            at = heappop(held)
        else:
            at = held[0]
            del bucket[rank]
            leaf[word] = low = low ^ first
            if not low:
                top &= top - 1
        if pair[at] != rank:
            continue  # stale
        mid = nxt[at]
        nxt[at] = end = nxt[mid]
        pair[mid] = -1
        if end < n:
            prv[end] = at
            pair[at] = r = get(piece[at : nxt[end]], -1)
            if r >= 0:
                held = bucket.get(r)
                if held is None:
                    bucket[r] = [at]
                    word = r >> LEAF
                    leaf[word] |= bit[r & MASK]
                    top |= bit[word]
                else:
                    heappush(held, at)
        else:
            pair[at] = -1
        if at:
            before = prv[at]
            r = get(piece[before:end], -1)
            if r != pair[before]:
                pair[before] = r
                if r >= 0:
                    held = bucket.get(r)
                    if held is None:
                        bucket[r] = [before]
                        word = r >> LEAF
                        leaf[word] |= bit[r & MASK]
                        top |= bit[word]
                    else:
                        heappush(held, before)
    out, at = [], 0
    while at < n:
        end = nxt[at]
        out.append(ranks[piece[at:end]])
        at = end
    return out


#: Packers of short lists of ids.
_PACK = [struct.Struct(f"<{n}I").pack for n in range(24)]


class Codec:
    """Encodes whole texts and decodes ids; remembers a bounded number of pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED) -> None:
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.tokens = [b""] * self.size
        for t, i in ranks.items():
            self.tokens[i] = t
        self.split = regex.compile(pattern).findall
        self.queue = RankQueue(self.size)
        self.most = max(1, remembered // 2)
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        ids = self.known.get(piece) or self.old.get(piece)
        if ids is None:
            got = encode_piece(piece.encode("utf-8"), self.ranks, self.queue)
            ids = _PACK[len(got)](*got) if len(got) < len(_PACK) else np.array(got, "<u4").tobytes()
        if len(piece) <= REMEMBER_LONGEST:
            if len(self.known) >= self.most:
                self.old, self.known = self.known, {}
            self.known[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        get, piece = self.known.get, self._piece  # if the halves turn over meanwhile, _piece finds the rest
        return b"".join([get(p) or piece(p) for p in self.split(text)])

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for."""
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """This process's codec for a vocabulary file."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(load_ranks(path), pattern)
    return _CODECS[path, pattern]


def _encode(path: str, pattern: str, keep: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in common.sliced(batches):
            n, ids_sha, text_sha, kept = [], [], [], []
            for t in b.column(1).to_pylist():
                ids = c.encode(t or "")
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
                if keep:
                    kept.append(ids)
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep:
                cols, names = [*cols, pa.array(kept, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256[, ids]) per row of ``docs``.

    ``path`` names a file of ranks that every machine has; ``pattern`` splits
    a text into pre-tokens.  ``ids`` (with ``keep_ids``) are little-endian unsigned
    32-bit integers; the decoded digest is of the bytes that the ids decode to.
    Null and empty texts have no ids; repeated rows stay repeated; an empty table
    gives an empty one; other columns are ignored.
    """
    common.shipped(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary" if keep_ids else "")
    return common.spread(rows).mapInArrow(_encode(path, pattern, keep_ids), schema).withColumnRenamed("id", id_col)


def decoded(rows: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``rows`` with a column ``decoded`` (binary): what the ids of each row stand for; null stays null."""
    common.shipped(rows.sparkSession)

    @F.pandas_udf("binary")
    def back(ids):
        c = codec(path, r"(?s:.+)")
        return ids.map(lambda x: None if x is None else c.decode(x))

    return rows.withColumn("decoded", back(F.col(ids_col)))

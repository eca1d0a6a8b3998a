"""SimHash near-duplicates found by a pigeonring of fingerprint segments.

A fingerprint has four 16-bit segments in a ring.  If two fingerprints differ in
at most 3 bits, some segment starts a chain in which the first 1, 2, 3 and 4
segments differ in at most 3/4, 6/4, 9/4 and 12/4 bits, that is 0, 1, 2 and 3.
So the pair agrees in the whole first segment and in one half at least of the
second: a key of 24 bits, eight of them a fingerprint.  Going one segment
further, the pair agrees in one third at least of the third segment too: a key
of 29 or 30 bits, 24 of them a fingerprint, for tables of so many fingerprints
that 24 bits would bring unlike ones together (candidates grow with the square
of the fingerprints over 2^bits).  The chain is tested before the whole distance.  Equal fingerprints are one node from the start;
what a bucket finds leaves it as a spanning forest, never as all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import Forest, components

#: Rows of a bucket that one task compares at a time; larger buckets are dealt
#: out as pairs of blocks of about this many rows, all of which are compared.
BLOCK = 2048
#: Different fingerprints from which keys take in three segments of the chain and not two.
LONG_CHAIN = 1 << 26
#: Ids to leave out up to which they go to every executor whole (8 bytes each).
DROP_BOUND = 1_000_000


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles, as an unsigned number.

    Null, empty and blank texts give 0; texts of fewer than ``shingle`` words
    have one shingle, the whole sequence.  Repeats count.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [h(b" ".join(words), seed)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = (ends[: len(ends) - shingle + 1] - np.fromiter(map(len, words[: len(words) - shingle + 1]), np.int64) - 1).tolist()
        hashes = [h(line[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())]
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = np.array(hashes[i : i + 65536], dtype=">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big")


def _fingerprints(shingle: int, seed: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.sliced(batches):
            fps = np.array([fingerprint(t, shingle, seed) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed long; one row each."""
    common.shipped(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return common.spread(rows).mapInArrow(_fingerprints(shingle, seed), "id long, fp long")


#: Where a key's number of its (segment, half, third) starts, and how many numbers a segment has, by length of the chain.
LAYOUT = {2: (24, 2), 3: (30, 6)}


def _keys(fp, chain: int = 2):
    """The bucket keys of a fingerprint: which (segment, half[, third]) it is, and the bits there."""
    seg = [F.shiftrightunsigned(fp, 48 - 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    shift, out = LAYOUT[chain][0], []
    for i in range(4):
        two, three = seg[(i + 1) % 4], seg[(i + 2) % 4]
        for half in (F.shiftright(two, 8), two.bitwiseAND(F.lit(0xFF))):
            front = F.shiftleft(seg[i], 8) + half
            parts = [front] if chain == 2 else [F.shiftleft(front, 6) + x for x in (F.shiftright(three, 10), F.shiftright(three, 5).bitwiseAND(F.lit(31)), three.bitwiseAND(F.lit(31)))]
            out += [F.lit(len(out) + n << shift).cast("long") + x for n, x in enumerate(parts)]
    return F.array(*out)


def _linked(x: np.ndarray, y: np.ndarray, seg: np.ndarray, most: int) -> np.ndarray:
    """Which pairs pass the chain that starts at their key's segment, then the distance."""
    d = x ^ y
    shift = (np.uint64(48) - np.uint64(16) * ((seg + np.uint64(1)) % np.uint64(4))) % np.uint64(64)
    two = np.bitwise_count((d >> shift) & np.uint64(0xFFFF))
    ok = two <= 2 * most // 4
    shift = (np.uint64(48) - np.uint64(16) * ((seg + np.uint64(2)) % np.uint64(4))) % np.uint64(64)
    ok &= two + np.bitwise_count((d >> shift) & np.uint64(0xFFFF)) <= 3 * most // 4
    return ok & (np.bitwise_count(d) <= most)


def _within(forest: Forest, fps: np.ndarray, seg: int, most: int) -> None:
    """Joins linked fingerprints of one large bucket: a breadth-first search, one vector step a node."""
    left = np.arange(len(fps))
    while len(left):
        front = [left[0]]
        left = left[1:]
        while front and len(left):
            i = front.pop()
            hit = _linked(fps[left], fps[i], np.uint64(seg), most)
            for j in left[hit]:
                forest.join(int(fps[i].view(np.int64)), int(fps[j].view(np.int64)))
                front.append(j)
            left = left[~hit]


def _across(forest: Forest, a: np.ndarray, b: np.ndarray, seg: int, most: int) -> None:
    """Joins linked fingerprints of two blocks of one bucket."""
    for x in a:
        hit = b[_linked(b, x, np.uint64(seg), most)]
        for y in hit:
            forest.join(int(x.view(np.int64)), int(y.view(np.int64)))


def _compare(most: int, chain: int):
    shift, each = LAYOUT[chain]

    def flush(forest: Forest, part: list[np.ndarray]) -> None:
        key, lo, hi, blk, fp = part
        new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
        size = np.diff(np.r_[new, len(key)])
        run = np.repeat(np.arange(len(new)), size)
        u = fp.view(np.uint64)
        small = np.repeat(size <= 48, size)
        pos = np.flatnonzero(small)
        step = 1
        while len(pos := pos[pos + step < len(key)]) and len(pos := pos[run[pos] == run[pos + step]]):
            hit = pos[_linked(u[pos], u[pos + step], ((key[pos] >> shift) // each).astype(np.uint64), most)]
            for x, y in zip(fp[hit].tolist(), fp[hit + step].tolist()):
                forest.join(x, y)
            step += 1
        for r in np.flatnonzero(size > 48):
            at = slice(new[r], new[r] + size[r])
            seg = int(key[new[r]] >> shift) // each
            if lo[new[r]] == hi[new[r]]:
                _within(forest, u[at], seg, most)
            else:
                one = blk[at] == lo[new[r]]
                _across(forest, u[at][one], u[at][~one], seg, most)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held = Forest(), None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            # the last bucket may go on in the next batch
            same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & (cols[2] == cols[2][-1])
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                flush(forest, [x[:cut] for x in cols])
            held = [x[cut:] for x in cols]
        if held is not None and len(held[0]):
            flush(forest, held)
        x, y = forest.edges()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    return run


def links(fps: DataFrame, most: int = 3, block: int = BLOCK, chain: int = 2) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints of ``fps(fp)`` within ``most`` bits.

    The edges are a spanning forest of the links found in each partition: no
    link between different fingerprints is lost, and none is added.
    ``most`` is 3 or less: the key layout is made for that.  ``chain`` (2 or 3) is
    how many segments a key takes in; the links are the same.
    """
    if not 0 <= most <= 3:
        raise ValueError("the four-segment ring serves distances of 0 to 3")
    common.shipped(fps.sparkSession)
    keyed = fps.select("fp", F.explode(_keys(F.col("fp"), chain)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    rows = keyed.join(sizes, "key").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    rows = rows.withColumn("blk", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"), "blk", "fp")
    dealt = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return dealt.mapInArrow(_compare(most, chain), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 3, shingle: int = 3, seed: int = 42) -> DataFrame:
    """One row per row of ``docs``: (id_col, fingerprint, component_id).

    ``fingerprint`` is 16 lower-case hex digits.  ``component_id`` is the
    smallest id reachable over links of ``most`` or fewer differing bits, the
    row's own included.  Null and blank texts have fingerprint zero and link
    like any other; a null id counts as no id when the smallest is taken (the
    component of only null ids is null); repeated rows stay repeated; an empty
    table gives an empty one; other columns are ignored.
    """
    base = common.written(fingerprints(docs, id_col, text_col, shingle, seed), "simhash")
    nodes = common.written(base.groupBy("fp").agg(F.min("id").alias("low")), "simhash-fp")
    chain = 3 if nodes.count() >= LONG_CHAIN else 2
    roots = common.written(components(links(nodes.select("fp"), most, chain=chain)), "simhash-cc")
    placed = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = placed.join(lowest, "root").select("fp", "component_id")
    return base.join(by_fp, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 3) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group, all columns as they are.

    Rows with a null id are kept: they can't be told from each other.  Of
    repeated rows with one id, all are kept or none.
    """
    drop = near_duplicates(docs, id_col, text_col, most).filter(F.col(id_col) != F.col("component_id"))
    drop = common.written(drop.select(F.col(id_col).alias("__wl_drop")).distinct(), "simhash-drop")
    hint = F.broadcast(drop) if drop.count() <= DROP_BOUND else drop
    return docs.join(hint, docs[id_col] == F.col("__wl_drop"), "left_anti")

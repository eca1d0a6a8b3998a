"""Near-duplicate vectors by an inverted multi-index.

Each half of a unit vector has a codebook of its own; the pairs of codewords are
the cells of a product grid.  A vector lives in the cell of its two nearest
codewords and visits cells in the order of their distance (the sum of the two
halves'), by the multi-sequence walk, up to a margin beyond its own cell.  The
margin is set on a sample so that pairs just at the threshold meet with the
target recall.  Who meets is verified by cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import blake2b
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import Forest, components

#: Different vectors of one length that the codebooks and the margin are fitted on: this many, or eight a codeword if that is more.
SAMPLE = 8192
#: Made partners, and links within the sample, that the margin is set on at most.
PROBES, LINKS = 2000, 200_000
#: Share of pairs exactly at the threshold that the margin is to let meet.
TARGET = 0.99
#: Different vectors a cell should hold on average.
PER_CELL = 200
#: Different vectors of a length below which they are one cell, which needs no fit.
ONE_CELL = 4 * PER_CELL
#: Codewords of a half at most: they grow with the square root of the vectors up to 1.3e10 of them.
MOST_WORDS = 8192
#: Distances to codewords that are held at a time.
HELD = 1 << 22
#: Vectors of one cell, and visitors of one cell, that one task holds against each other.
BLOCK, VISITORS = 2048, 16384


def unit(raw: bytes, wide: bool) -> np.ndarray:
    """The vector of ``raw`` in double precision, scaled to length 1."""
    v = np.frombuffer(raw, "<f8" if wide else "<f4").astype(np.float64)
    v = v / np.abs(v).max()  # so that squares neither overflow nor vanish
    return v / np.sqrt(v @ v)


def _clean(wide: bool):
    kind = np.dtype("<f8" if wide else "<f4")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dim, key, vec = [], [], []
            for x in b.column(1):
                v = None if not x.is_valid else x.values.to_numpy(zero_copy_only=False).astype(kind)
                if v is None or not len(v) or not np.isfinite(v).all() or not v.any():
                    dim.append(None), key.append(None), vec.append(None)
                    continue
                raw = (v + kind.type(0)).tobytes()  # -0.0 becomes 0.0
                dim.append(len(v)), key.append(blake2b(raw, digest_size=16).digest()), vec.append(raw)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dim, pa.int32()), pa.array(key, pa.binary()), pa.array(vec, pa.binary())], names=["id", "dim", "key", "vec"])

    return run


def _kmeans(x: np.ndarray, k: int, draw: np.random.Generator, rounds: int = 8) -> np.ndarray:
    words = x[draw.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([_squared(part, words).argmin(axis=1) for part in _parts(x, k)])
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(words)
        np.add.at(total, own, x)
        words = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], words)
    return words


def _parts(x: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Rows of ``x`` in parts whose distances to ``k`` codewords fit in HELD."""
    step = max(16, HELD // k)
    return (x[i : i + step] for i in range(0, len(x), step))


def _squared(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(axis=1)[:, None] - 2 * x @ words.T + (words * words).sum(axis=1))


def words_for(n: int) -> int:
    """Codewords of a half for ``n`` different vectors."""
    return int(np.clip(np.sqrt(n / PER_CELL), 1, MOST_WORDS))


@dataclass(frozen=True)
class MultiIndex:
    """Two codebooks and the margin up to which cells are visited."""

    first: np.ndarray
    second: np.ndarray
    margin: float

    @classmethod
    def fit(cls, x: np.ndarray, n: int, threshold: float, target: float = TARGET, seed: int = 1) -> MultiIndex:
        """Codebooks for ``n`` vectors and the margin for ``target``, from the sample ``x`` of unit vectors."""
        draw = np.random.default_rng(seed)
        d = x.shape[1]
        k = max(1, min(words_for(n), len(x) // 8))
        half = d // 2
        index = cls(_kmeans(x[:, :half], k, draw), _kmeans(x[:, half:], k, draw), 0.0)
        probe = x[draw.choice(len(x), min(len(x), PROBES), replace=False)]
        off = draw.normal(size=probe.shape)
        off -= (off * probe).sum(axis=1)[:, None] * probe
        size = np.linalg.norm(off, axis=1)[:, None]
        other = threshold * probe + np.sqrt(max(0.0, 1 - threshold**2)) * off / np.where(size > 0, size, 1)
        margin = float(np.quantile(index._gap(probe, other), target))
        links = x[:2048] @ x.T >= threshold
        i, j = np.nonzero(np.triu(links, 1))
        if len(i):
            i, j = i[:LINKS], j[:LINKS]
            margin = max(margin, float(np.quantile(index._gap(x[i], x[j]), max(target, 0.999))))
        return cls(index.first, index.second, margin + 1e-9)

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        return _squared(x[:, :half], self.first), _squared(x[:, half:], self.second)

    def _gap(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How far beyond its own cell the nearer of two vectors must look to meet the other."""
        out = []
        for p, q in zip(_parts(x, len(self.first)), _parts(y, len(self.first))):
            (x1, x2), (y1, y2) = self.halves(p), self.halves(q)
            at = np.arange(len(p))
            xy = x1[at, y1.argmin(axis=1)] + x2[at, y2.argmin(axis=1)] - x1.min(axis=1) - x2.min(axis=1)
            yx = y1[at, x1.argmin(axis=1)] + y2[at, x2.argmin(axis=1)] - y1.min(axis=1) - y2.min(axis=1)
            out.append(np.minimum(xy, yx))
        return np.concatenate(out)

    def visits(self, d1: np.ndarray, d2: np.ndarray) -> list[int]:
        """Cells by ascending distance, the vector's own first, until the margin is passed.

        The multi-sequence walk: both halves' codewords are sorted, and a cell
        is put in the heap when both its predecessors have been visited.
        """
        o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
        s1, s2, o1, o2 = d1[o1].tolist(), d2[o2].tolist(), o1.tolist(), o2.tolist()
        k1, k2 = len(s1), len(s2)
        limit = s1[0] + s2[0] + self.margin
        heap, reach, out = [(s1[0] + s2[0], 0, 0)], [0] * (k1 + 1), []
        while heap:
            d, i, j = heappop(heap)
            if d > limit:
                break
            out.append(o1[i] * k2 + o2[j])
            reach[i] = j + 1  # cells of row i visited so far
            if i + 1 < k1 and reach[i + 1] == j and (j == 0 or reach[i + 1] >= j):
                heappush(heap, (s1[i + 1] + s2[j], i + 1, j))
            if j + 1 < k2 and (i == 0 or reach[i - 1] > j + 1):
                heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
        return out


def _fitted(nodes: DataFrame, wide: bool, threshold: float, target: float, sample: int) -> dict[int, MultiIndex]:
    """An index for each length with ONE_CELL vectors or more, from one pass over ``nodes`` for all of them.

    A length's sample is those of its vectors with the lowest digests.  The driver holds
    the samples of such lengths only, ``sample`` vectors or eight a codeword each.
    """
    many = nodes.groupBy("dim").count().filter(F.col("count") >= ONE_CELL).collect()
    if not many:
        return {}
    want = {d: max(sample, 8 * words_for(n)) for d, n in many}
    # a digest's first seven bytes are a number below 2^56: a fifth more than wanted, so that the lowest are among them
    below = nodes.sparkSession.createDataFrame([(d, int(min(1.0, 1.2 * want[d] / n) * (1 << 56))) for d, n in many], "__d int, __below long")
    low = F.conv(F.hex(F.substring("key", 1, 7)), 16, 10).cast("long")
    drawn: dict[int, list[tuple[bytes, bytes]]] = {d: [] for d in want}
    for d, key, vec in nodes.join(F.broadcast(below), F.col("dim") == F.col("__d")).filter(low < F.col("__below")).select("dim", "key", "vec").collect():
        drawn[d].append((bytes(key), bytes(vec)))
    counts = dict(map(tuple, many))
    return {d: MultiIndex.fit(np.stack([unit(v, wide) for _, v in sorted(rows)[: want[d]]]), counts[d], threshold, target) for d, rows in drawn.items()}


def _assign(indexes: dict[int, MultiIndex], wide: bool):
    """Each vector's cell and the cells that it visits; lengths without an index are one cell."""
    rows = HELD // max([1024, *(len(i.first) for i in indexes.values())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.sliced(batches, rows):
            dims, vecs = b.column(2).to_pylist(), b.column(3).to_pylist()
            home, seen = [0] * len(dims), [[0] for _ in dims]
            for d in indexes.keys() & set(dims):
                at = [i for i, x in enumerate(dims) if x == d]
                index = indexes[d]
                d1, d2 = index.halves(np.stack([unit(vecs[i], wide) for i in at]))
                for i, a, c in zip(at, d1, d2):
                    seen[i] = index.visits(a, c)
                    home[i] = seen[i][0]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(4)], pa.array(home, pa.int32()), pa.array(seen, pa.list_(pa.int32()))], names=["node", "n", "dim", "vec", "home", "visits"])

    return run


def _meet(threshold: float, wide: bool):
    """Counts and a spanning forest of the links in each block; rows come by block, inhabitants first."""

    def flush(block: dict, forest: Forest, count: dict[int, int]) -> None:
        for i, c in enumerate(block["got"].tolist()):
            if c:
                count[block["node"][i]] = count.get(block["node"][i], 0) + c

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, count, now, block = Forest(), {}, None, None
        for b in batches:
            col = b.to_pydict()
            keys = list(zip(col["dim"], col["cell"], col["s"], col["p"]))
            at = 0
            while at < len(keys):
                if keys[at] != now:
                    if block and block["vec"] is not None:
                        flush(block, forest, count)
                    now, block = keys[at], {"node": [], "n": [], "raw": [], "visits": [], "vec": None}
                end = at
                role = col["role"][at]
                while end < len(keys) and keys[end] == now and col["role"][end] == role and end - at < 512:
                    end += 1
                if role == 0:
                    for k in ("node", "n", "visits"):
                        block[k] += col[k][at:end]
                    block["raw"] += [unit(x, wide) for x in col["vec"][at:end]]
                elif block["node"]:
                    if block["vec"] is None:
                        block["vec"] = np.stack(block["raw"])
                        block["n"] = np.array(block["n"], np.int64)
                        block["got"] = np.zeros(len(block["node"]), np.int64)
                        block["label"] = np.arange(len(block["node"]))
                        block["sets"] = [set(v) for v in block["visits"]]
                    x = np.stack([unit(v, wide) for v in col["vec"][at:end]])
                    hit = x @ block["vec"].T >= threshold
                    for i in np.flatnonzero(hit.any(axis=1)):
                        me, mine, home = col["node"][at + i], col["n"][at + i], col["home"][at + i]
                        ys = np.flatnonzero(hit[i])
                        ys = ys[[block["node"][y] != me for y in ys]]
                        if not len(ys):
                            continue
                        count[me] = count.get(me, 0) + int(block["n"][ys].sum())
                        # does the other one visit my cell?  then it counts me there
                        alone = ys[[home not in block["sets"][y] for y in ys]]
                        block["got"][alone] += mine
                        labels = np.unique(block["label"][ys])
                        for other in labels:
                            forest.join(me, block["node"][other])
                        if len(labels) > 1:
                            block["label"][np.isin(block["label"], labels)] = labels[0]
                at = end
        if block and block["vec"] is not None:
            flush(block, forest, count)
        a, r = forest.edges()
        yield pa.RecordBatch.from_arrays([pa.array([*a, *count], pa.int64()), pa.array([*r, *count.values()], pa.int64()), pa.array([True] * len(a) + [False] * len(count), pa.bool_())], names=["a", "b", "edge"])

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, target: float = TARGET, sample: int = SAMPLE) -> DataFrame:
    """(id_col, n_links, component_id, kept) per row of ``vectors``.

    Vectors are linked if their cosine is ``threshold`` or more; only vectors of
    one length are compared.  ``n_links`` counts the other rows linked directly
    (equal vectors are linked), ``component_id`` is the smallest id reachable,
    ``kept`` says whether that is the row's own.  Null vectors, empty ones, zero
    vectors and those with null or non-finite components link with nothing.
    Null ids count as no id when the smallest is taken; repeated rows are rows
    of their own; an empty table gives an empty one; other columns are ignored.

    Equal vectors are one node with a count.  The index is fitted on ``sample``
    different vectors of each length (those with the lowest digests; eight a
    codeword if that is more), and every vector is indexed.  Lengths with fewer than ONE_CELL
    vectors are one cell.  A cell with many vectors or visitors is dealt
    out in blocks, all of which are compared; links leave a block as counts and
    a spanning forest, never as pairs.
    """
    spark = vectors.sparkSession
    common.shipped(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    wide = "float" not in dict(rows.dtypes)["v"]
    rows = rows.withColumn("v", F.col("v").cast("array<double>" if wide else "array<float>"))
    base = common.written(rows.mapInArrow(_clean(wide), "id long, dim int, key binary, vec binary"), "emb-rows")
    whole = base.filter("key is not null")
    nodes = whole.groupBy("dim", "key").agg(F.min("id").alias("low"), F.count("*").alias("n"), F.first("vec").alias("vec"))
    nodes = common.written(nodes.withColumn("node", F.monotonically_increasing_id()), "emb-nodes")
    indexes = _fitted(nodes, wide, threshold, target, sample)
    placed = nodes.select("node", "n", "dim", "vec").mapInArrow(_assign(indexes, wide), "node long, n long, dim int, vec binary, home int, visits array<int>")
    placed = common.written(placed, "emb-cells")
    held = placed.groupBy("dim", F.col("home").alias("cell")).agg(F.count("*").alias("held"))
    come = placed.select("dim", F.explode("visits").alias("cell")).groupBy("dim", "cell").agg(F.count("*").alias("come"))
    cells = held.join(come, ["dim", "cell"]).select("dim", "cell", F.ceil(F.col("held") / BLOCK).cast("int").alias("ns"), F.ceil(F.col("come") / VISITORS).cast("int").alias("np"))
    cells = common.written(cells, "emb-sizes")
    live = placed.withColumn("cell", F.col("home")).join(cells, ["dim", "cell"])
    live = live.select("dim", "cell", F.pmod(F.xxhash64("node"), F.col("ns")).cast("int").alias("s"), F.explode(F.sequence(F.lit(0), F.col("np") - 1)).alias("p"), F.lit(0).alias("role"), "node", "n", "vec", "home", "visits")
    call = placed.withColumn("cell", F.explode("visits")).join(cells, ["dim", "cell"])
    none = F.lit(None).cast("array<int>").alias("visits")
    call = call.select("dim", "cell", F.explode(F.sequence(F.lit(0), F.col("ns") - 1)).alias("s"), F.pmod(F.xxhash64("node", F.lit(7)), F.col("np")).cast("int").alias("p"), F.lit(1).alias("role"), "node", "n", "vec", "home", none)
    dealt = live.unionByName(call).repartition("dim", "cell", "s", "p").sortWithinPartitions("dim", "cell", "s", "p", "role")
    found = common.written(dealt.mapInArrow(_meet(threshold, wide), "a long, b long, edge boolean"), "emb-links")
    counts = found.filter("not edge").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    roots = common.written(components(found.filter("edge").select("a", "b")), "emb-cc")
    tied = nodes.select("node", "dim", "key", "low", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = tied.groupBy("root").agg(F.min("low").alias("component"))
    tied = tied.join(lowest, "root").join(counts, "node", "left")
    tied = tied.select("dim", "key", "component", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    out = base.select("id", "dim", "key").join(tied, ["dim", "key"], "left")
    lone = F.col("key").isNull()
    component = F.when(lone, F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))

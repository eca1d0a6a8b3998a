"""Token-id files with Elias-Fano document boundaries.

A file holds the ids of its documents one after another, in the narrowest
unsigned type that the vocabulary allows, then the boundaries between documents
as an Elias-Fano sequence: the low bits of each boundary packed, the high bits
in unary, and the place of every 256th one so that ``select`` is a short scan.
That is about 2 + log2(ids per document) bits a boundary, with no table of
64-bit offsets.
"""

from __future__ import annotations

import itertools
import json
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# Fixed values of the file format.
MAGIC = b"WLTOK1\0\0"
FOOTER = struct.Struct("<QQBBHQQQQQ8s")
EVERY = 256


class EliasFano:
    """A monotone sequence of numbers in about 2 + log2(last / n) bits each."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        """From ascending non-negative integers."""
        v = np.asarray(values, np.int64)
        n = len(v)
        last = int(v[-1]) if n else 0
        bits = max(0, (last // max(n, 1)).bit_length() - 1)
        low = np.packbits(((v[:, None] >> np.arange(bits)) & 1).astype(np.uint8).ravel(), bitorder="little")
        ones = (v >> bits) + np.arange(n)
        flat = np.zeros((last >> bits) + n + 1, np.uint8)
        flat[ones] = 1
        return cls(n, bits, low, np.packbits(flat, bitorder="little"), ones[::EVERY].astype("<u4"))

    def _low(self, i: int) -> int:
        at = i * self.low_bits
        part = int.from_bytes(self.low[at >> 3 : (at + self.low_bits + 7) >> 3].tobytes(), "little")
        return (part >> (at & 7)) & ((1 << self.low_bits) - 1)

    def _one(self, i: int) -> int:
        """The place of the i-th number's high bit, from the nearest sample on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // EVERY])
        skip = i % EVERY
        byte = at >> 3
        word = int(self.high[byte]) >> (at & 7) << (at & 7)
        while (c := word.bit_count()) <= skip:
            skip -= c
            byte += 1
            word = int(self.high[byte])
        for _ in range(skip):
            word &= word - 1
        return (byte << 3) + (word & -word).bit_length() - 1

    def select(self, i: int) -> int:
        """The i-th number."""
        return (self._one(i) - i) << self.low_bits | self._low(i)

    def between(self, i: int, j: int) -> np.ndarray:
        """Numbers ``i`` to ``j`` (not included, at least one): a select at both ends, and only what lies between is decoded."""
        first, last = self._one(i), self._one(j - 1)
        bits = np.unpackbits(self.high[first >> 3 : (last >> 3) + 1], bitorder="little")
        ones = np.flatnonzero(bits[first & 7 : last + 1 - (first >> 3 << 3)]) + first
        high = (ones - np.arange(i, j)) << self.low_bits
        if not self.low_bits:
            return high
        at, end = i * self.low_bits, j * self.low_bits
        bits = np.unpackbits(self.low[at >> 3 : (end + 7) >> 3], bitorder="little")[at & 7 :][: end - at].reshape(j - i, self.low_bits)
        return high | (bits.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)

    def all(self) -> np.ndarray:
        """Every number."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        high = (ones - np.arange(self.n)) << self.low_bits
        if not self.low_bits:
            return high
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        return high | (bits.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)

    @property
    def n_bytes(self) -> int:
        return self.low.nbytes + self.high.nbytes + self.samples.nbytes


class TokenFileWriter:
    """Streams documents' ids to a file; only boundaries and document ids are held."""

    def __init__(self, out, wide: bool) -> None:
        self.out, self.kind = out, np.dtype("<u4" if wide else "<u2")
        self.out.write(MAGIC)
        self.ends, self.docs, self.ids = [0], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.out.write(ids.astype(self.kind).tobytes())
        self.ids += len(ids)
        self.ends.append(self.ids)
        self.docs.append(doc_id)

    def close(self) -> None:
        ef = EliasFano.of(np.array(self.ends, np.int64))
        null = np.packbits(np.array([d is None for d in self.docs], np.uint8))
        docs = np.array([0 if d is None else d for d in self.docs], "<i8")
        parts = [x.tobytes() for x in (docs, null, ef.low, ef.high, ef.samples)]
        for p in parts:
            self.out.write(p)
        self.out.write(FOOTER.pack(len(self.docs), self.ids, self.kind.itemsize, ef.low_bits, 0, *map(len, parts), MAGIC))
        self.out.close()


class TokenFile:
    """A token-id file: random access to any document's ids."""

    def __init__(self, source, size: int) -> None:
        self.source = source
        got = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        self.n, self.ids, width, bits, _, *lengths, magic = got
        if magic != MAGIC or self._read(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a token file")
        self.kind = np.dtype("<u4" if width == 4 else "<u2")
        tail = self._read(len(MAGIC) + self.ids * width, sum(lengths))
        cut = list(itertools.accumulate(lengths, initial=0))
        docs, null, low, high, samples = (tail[a:b] for a, b in zip(cut, cut[1:]))
        self.docs = np.frombuffer(docs, "<i8")
        self.null = np.unpackbits(np.frombuffer(null, np.uint8))[: self.n].astype(bool)
        self.bounds = EliasFano(self.n + 1, bits, np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8), np.frombuffer(samples, "<u4"))

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def ids_between(self, a: int, b: int) -> np.ndarray:
        """Ids number ``a`` to ``b`` (not included) of the file."""
        w = self.kind.itemsize
        return np.frombuffer(self._read(len(MAGIC) + a * w, (b - a) * w), self.kind)

    def document(self, i: int) -> np.ndarray:
        """The ids of the file's i-th document, by two selects."""
        return self.ids_between(self.bounds.select(i), self.bounds.select(i + 1))


# Fixed value: how byte-level tokenizers of this kind split a text.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens a worker remembers; a full memory starts anew.
REMEMBERED = 700_000


def byte_letters() -> dict[int, int]:
    """The letters that stand for bytes in a byte-level vocabulary, as a translation table.

    A printable byte stands for itself; the others take the code points from
    256 on, in order.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: b if b in plain else next(others) for b in range(256)}


class _Known(dict):
    """Pre-token to the bytes of its ids; asks the library's model for a new one."""

    def __init__(self, model, kind: str) -> None:
        super().__init__()
        self.ask, self.kind, self.letters = model.tokenize, kind, byte_letters()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        spelled = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
        self[piece] = ids = array(self.kind, [t.id for t in self.ask(spelled)]).tobytes()
        return ids


#: What the library and the remembered pieces have to agree on before pieces are trusted.
PROBE = "It's we'll  I'D\t\n x1\u00a0\u3000\u4e2d\u6587 na\u00efve \u0417\u0434\u0440\u0430 \U0001f600!? ''s 12 345\r\n\r\n  end " + "".join(map(chr, range(1, 0x250)))


class LibraryEncoder:
    """The tokenizers library as its file sets it up, with its answers for pre-tokens remembered.

    Where the tokenizer is byte-level with the usual split and nothing before
    or after it, a text's ids are those of its pre-tokens one after another, so
    the library's model is asked once for each different pre-token.  Added
    tokens (special ones too) are taken out of a text first, as the library
    does.  Any other tokenizer, and one whose own ids for ``PROBE`` differ, gets
    whole texts.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_padding()
        self.lib.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.wide = max(self.lib.get_vocab(with_added_tokens=True).values(), default=0) > 65535
        self.kind = np.uint32 if self.wide else np.uint16
        self.split = regex.compile(SPLIT).findall
        self.known = _Known(self.lib.model, "I" if self.wide else "H")
        added = spec.get("added_tokens") or []
        self.added = {t["content"]: np.array([t["id"]], self.kind).tobytes() for t in added if t["content"]}
        self.cuts = regex.compile("|".join(regex.escape(c) for c in sorted(self.added, key=len, reverse=True)) or r"(?!)")
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = (
            not spec.get("normalizer") and not spec.get("post_processor") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
            and pre.get("use_regex", True) and spec["model"].get("type") == "BPE" and not spec["model"].get("dropout")
            and not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")) and len({t.get("normalized") for t in added}) < 2
        )
        probes = [PROBE, *(f"{PROBE}{c} {c}{c}x" for c in self.added)]
        self.by_piece = self.by_piece and all(np.array_equal(self._pieces(t), self.lib.encode(t, add_special_tokens=False).ids) for t in probes)

    def _pieces(self, text: str) -> np.ndarray:
        of, split = self.known.__getitem__, self.split
        if not any(c in text for c in self.added):
            return np.frombuffer(b"".join(map(of, split(text))), self.kind)
        out, at = [], 0
        for m in self.cuts.finditer(text):
            out += [*map(of, split(text[at : m.start()])), self.added[m[0]]]
            at = m.end()
        return np.frombuffer(b"".join([*out, *map(of, split(text[at:]))]), self.kind)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's ids."""
        if self.by_piece:
            return [self._pieces(t) for t in texts]
        return [np.array(e.ids, self.kind) for e in self.lib.encode_batch(texts, add_special_tokens=False)]


_ENCODERS: dict[str, LibraryEncoder] = {}


def library_encoder(path: str) -> LibraryEncoder:
    """This process's encoder for a tokenizer file."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    if path not in _ENCODERS:
        _ENCODERS[path] = LibraryEncoder(path)
    return _ENCODERS[path]


def _write(tokenizer: str, folder: str, end_id: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = common.file_system(folder)
        encoder = library_encoder(tokenizer)
        end = np.array([end_id], encoder.kind)
        writer, part, tmp = None, 0, ""
        for b in common.sliced(batches):
            if writer is None:
                part = b.column(0)[0].as_py()
                tmp = f"{base}/_tmp/{part:06d}-{uuid.uuid4().hex}"
                fs.create_dir(f"{base}/_tmp", recursive=True)
                writer = TokenFileWriter(fs.open_output_stream(tmp), encoder.wide)
            docs = b.column(1).to_pylist()
            texts = b.column(2).to_pylist()
            for at in range(0, len(docs), 64):
                for d, ids in zip(docs[at : at + 64], encoder.encode([t or "" for t in texts[at : at + 64]])):
                    writer.add(d, np.concatenate([ids, end]))
        if writer is not None:
            writer.close()
            final = f"{base}/part-{part:06d}.tok"
            fs.move(tmp, final)  # whole or not at all; a second attempt writes the same bytes
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((part, pa.int32()), (f"{folder}/part-{part:06d}.tok", pa.string()), (len(writer.docs), pa.int64()), (writer.ids, pa.int64()))], names=["part", "path", "n_docs", "n_ids"])

    return run


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> list[tuple[str, int, int, int]]:
    """Token-id files of ``docs`` in ascending id order over all files: [(path, n_docs, n_ids, ids before)].

    The documents are dealt out by ranges of their id (null first), one file a
    range, as many as a scan of the input has splits (or the cluster cores, if that is more) unless ``files`` says otherwise;
    repeated ids stand together, ordered by text.  A task streams its ids
    to a file of its own name and renames it when whole.  The list has a row
    per file of some tens of MB, which is what the driver holds.  A null or empty
    text is the end id alone; an empty table gives no file and an empty list;
    other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    common.shipped(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n = files or common.parts_for(docs)
    rows = rows.repartitionByRange(n, "id").sortWithinPartitions("id", "text")
    rows = rows.select(F.spark_partition_id().alias("part"), "id", "text")
    done = rows.mapInArrow(_write(tokenizer, folder, end_id), "part int, path string, n_docs long, n_ids long")
    out, before = [], 0
    for r in sorted(done.collect()):
        out.append((r.path, r.n_docs, r.n_ids, before))
        before += r.n_ids
    return out


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            fs, at = common.file_system(path)
            with fs.open_input_file(at) as f:
                t = TokenFile(f, f.size())
                for i in range(0, t.n, 1024):
                    j = min(t.n, i + 1024)
                    bounds = t.bounds.between(i, j + 1)
                    sums = []
                    for a, z in itertools.pairwise(bounds.tolist()):
                        sums.append(zlib.crc32(t.ids_between(a, z).astype("<u4").tobytes()))
                    docs = pa.array(t.docs[i:j], pa.int64(), mask=t.null[i:j])
                    yield pa.RecordBatch.from_arrays([docs, pa.array(bounds[:-1] + before), pa.array(np.diff(bounds)), pa.array(sums, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])


def read(spark, files: list[tuple[str, int, int, int]], id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32) per document of the files, each file by a task of its own.

    Every boundary comes from the file's select structure, a block of 1024
    documents at a time.  No files give an empty table; null ids come back null.
    """
    common.shipped(spark)
    rows = spark.createDataFrame([(f[0], f[3]) for f in files], "path string, before long")
    rows = rows.repartition(max(1, len(files)))
    return rows.mapInArrow(_read, "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)

"""GIF as a media column: an LZW codec, frames with their timing, and colour histograms.

The decoder reads any GIF87a/89a: global and local palettes, interlace, sub-block
chains, delays, transparency and the four disposal methods.  The encoder
stores 8-bit samples losslessly as grey-palette frames.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Width of a stored frame, and the unit that payloads are padded to.
WIDTH = 576
#: Rows of a stored frame at most.
ROWS = 256
#: Bins of a colour histogram, for each of red, green and blue.
BINS = 16
#: Hundredths of a second that a stored frame lasts.
DELAY = 4
#: Pixels of a screen or a frame that are decoded at most (a canvas has 4 bytes a pixel).
PIXELS = 1 << 26
#: Bytes of canvases and samples in a batch of frames, unless one frame alone has more.
BATCH_BYTES = 32 << 20


def lzw_encode(samples: bytes, bits: int = 8) -> bytes:
    """The variable-width LZW code stream of a GIF image, without its sub-blocks."""
    clear = 1 << bits
    codes, widths = [clear], [bits + 1]
    add, wide = codes.append, widths.append
    book: dict[int, int] = {}
    get = book.get
    free, width, most = clear + 2, bits + 1, 1 << (bits + 1)
    it = iter(samples)
    now = next(it, None)
    if now is not None:
        for x in it:
            key = now << 8 | x
            code = get(key)
            if code is not None:
                now = code
                continue
            add(now)
            wide(width)
            now = x
            if free < 4096:
                book[key] = free
                if free == most:
                    width += 1
                    most <<= 1
                free += 1
            else:
                add(clear)
                wide(width)
                book.clear()
                free, width, most = clear + 2, bits + 1, 1 << (bits + 1)
        add(now)
        wide(width)
        # the decoder adds an entry for the last code too, which may widen what follows
        if free == most and width < 12:
            width += 1
    add(clear + 1)
    wide(width)
    return _pack(np.array(codes, np.uint32), np.array(widths, np.uint32))


def _pack(codes: np.ndarray, widths: np.ndarray) -> bytes:
    bit = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(widths, out=bit[1:])
    out = np.zeros(int(bit[-1] + 7) // 8 + 3, np.uint32)
    at, shift = bit[:-1] >> 3, (bit[:-1] & 7).astype(np.uint32)
    value = codes << shift
    for k in range(3):
        np.add.at(out, at + k, (value >> np.uint32(8 * k)) & np.uint32(255))
    return out[: int(bit[-1] + 7) // 8].astype(np.uint8).tobytes()


def _layout(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit offset and width of the k-th code after a clear code, as far as the table grows and on."""
    free = np.minimum(np.arange(4096 + 64) + (1 << bits) + 1, 4096)  # table size before the k-th code is read
    free[0] = (1 << bits) + 2
    width = np.clip(np.floor(np.log2(free)).astype(np.int64) + 1, bits + 1, 12)
    return np.r_[0, np.cumsum(width)[:-1]], width


_LAYOUTS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def lzw_decode(stream: bytes, bits: int = 8, most: int | None = None) -> bytes:
    """The samples of a code stream; stops at the end code, at ``most`` samples or where the stream breaks off.

    Codes between two clear codes have widths that follow from their number,
    so they are cut out of the stream together; each table entry is a piece of
    what is already written, so a code is one copy.
    """
    if bits not in _LAYOUTS:
        _LAYOUTS[bits] = _layout(bits)
    offset, width = _LAYOUTS[bits]
    clear, end = 1 << bits, (1 << bits) + 1
    data = np.frombuffer(stream + b"\0\0\0\0", np.uint8).astype(np.uint32)
    total, at, out = len(stream) * 8, 0, bytearray()
    literal = [bytes([i]) for i in range(clear)]
    table: list[bytes] = []
    last = b""
    full = False
    while at < total:
        if full:  # a full table without a clear code: all further codes have 12 bits
            pos, wid = at + 12 * np.arange(4096), np.full(4096, 12, np.int64)
        else:
            pos, wid = at + offset, width
        pos = pos[pos + wid[: len(pos)] <= total]
        if not len(pos):
            break
        wid = wid[: len(pos)]
        byte = pos >> 3
        word = data[byte] | data[byte + 1] << np.uint32(8) | data[byte + 2] << np.uint32(16)
        codes = (word >> (pos & 7).astype(np.uint32)) & ((np.uint32(1) << wid.astype(np.uint32)) - np.uint32(1))
        stop = np.flatnonzero((codes == clear) | (codes == end))
        n = int(stop[0]) if len(stop) else len(codes)
        for c in codes[:n].tolist():
            if c < clear:
                word_ = literal[c]
                if last and len(table) < 4094 - clear:
                    table.append(last + word_)
            elif c - clear - 2 < len(table):
                word_ = table[c - clear - 2]
                if len(table) < 4094 - clear:
                    table.append(last + word_[:1])
            elif last:
                word_ = last + last[:1]
                table.append(word_)
            else:
                return bytes(out)
            out += word_
            last = word_
            if most is not None and len(out) >= most:
                return bytes(out[:most])
        if not len(stop):
            at = int(pos[-1] + wid[-1])
            full = True
            continue
        if codes[n] == end:
            break
        at = int(pos[n] + wid[n])
        table, last, full = [], b"", False
    return bytes(out)


@dataclass
class Frame:
    """One picture of a GIF after disposal and transparency."""

    start_cs: int
    delay_cs: int
    left: int
    top: int
    index: np.ndarray  # the frame's own samples (rows x columns), de-interlaced
    canvas: np.ndarray  # the whole screen when it shows (rows x columns x RGBA)


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while at < len(data) and (n := data[at]):
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


def frames_of(data: bytes) -> Iterator[Frame]:
    """The frames of a GIF one after another, each as it shows; raises ValueError on anything that isn't a GIF.

    Disposal 0 and 1 leave a frame, 2 clears its rectangle, 3 brings back what
    was there.  Transparent samples leave the canvas as it is.  A stream that
    breaks off ends the frames (its last picture is filled up with sample 0).

    One canvas is held, made with the first frame and painted on by each: a
    frame's is good until the next frame is asked for.  A screen of more than
    PIXELS is refused with a ValueError, since a header of 13 bytes can claim 17 GB, and a
    frame of more ends the frames.
    """
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    wide, high, flags = int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little"), data[10]
    if wide * high > PIXELS:
        raise ValueError(f"a screen of {wide} x {high} is over {PIXELS} pixels")
    at = 13
    palette = None
    if flags & 0x80:
        n = 3 << ((flags & 7) + 1)
        palette = data[at : at + n]
        at += n
    canvas = None
    delay, clear, disposal, clock = 0, -1, 0, 0
    while at < len(data):
        kind = data[at]
        at += 1
        if kind == 0x3B:
            break
        if kind == 0x21:
            label = data[at] if at < len(data) else 0
            body, at = _blocks(data, at + 1)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, int.from_bytes(body[1:3], "little")
                clear = body[3] if body[0] & 1 else -1
            continue
        if kind != 0x2C or at + 9 > len(data):
            break
        left, top, w, h = (int.from_bytes(data[at + i : at + i + 2], "little") for i in (0, 2, 4, 6))
        flags = data[at + 8]
        at += 9
        colours = palette
        if flags & 0x80:
            n = 3 << ((flags & 7) + 1)
            colours = data[at : at + n]
            at += n
        if at >= len(data) or w * h > PIXELS:
            break
        bits = data[at]
        stream, at = _blocks(data, at + 1)
        flat = lzw_decode(stream, bits, w * h) if 2 <= bits <= 8 else b""
        index = np.frombuffer(flat if len(flat) == w * h else flat + bytes(w * h - len(flat)), np.uint8).reshape(h, w)
        if flags & 0x40:
            rows = np.r_[np.arange(0, h, 8), np.arange(4, h, 8), np.arange(2, h, 4), np.arange(1, h, 2)]
            straight = np.empty_like(index)
            straight[rows] = index
            index = straight
        if canvas is None:
            canvas = np.zeros((high, wide, 4), np.uint8)
        own = canvas[top : min(high, top + h), left : min(wide, left + w)]
        part = index[: own.shape[0], : own.shape[1]]
        before = own.copy() if disposal == 3 else None
        table = np.zeros((256, 4), np.uint8)
        if colours:
            known = np.frombuffer(colours[: len(colours) // 3 * 3], np.uint8).reshape(-1, 3)
            table[: len(known), :3] = known
        table[:, 3] = 255
        if clear < 0:
            own[...] = table[part]
        else:
            see = part != clear
            own[see] = table[part[see]]
        yield Frame(clock, delay, left, top, index, canvas)
        if disposal == 2:
            own[...] = 0
        elif before is not None:
            own[...] = before
        clock += delay
        delay, clear, disposal = 0, -1, 0


def decode(data: bytes) -> list[Frame]:
    """All frames of a small GIF, each with a canvas of its own; see :func:`frames_of`."""
    return [replace(f, canvas=f.canvas.copy()) for f in frames_of(data)]


def _sub_blocks(stream: bytes) -> bytes:
    """A stream in pieces of 255 bytes, each behind its length."""
    whole = len(stream) // 255 * 255
    out = np.full((whole // 255, 256), 255, np.uint8)
    out[:, 1:] = np.frombuffer(stream, np.uint8, whole).reshape(-1, 255)
    rest = stream[whole:]
    return out.tobytes() + (bytes([len(rest)]) + rest if rest else b"")


def encode(payload: bytes, width: int = WIDTH, rows: int = ROWS, delay: int = DELAY) -> bytes:
    """A GIF whose grey samples are ``payload``; its length is a multiple of ``width``."""
    high = min(rows, len(payload) // width)
    grey = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()
    out = [b"GIF89a", width.to_bytes(2, "little"), high.to_bytes(2, "little"), b"\xf7\0\0", grey]
    for i in range(0, len(payload), width * rows):
        part = payload[i : i + width * rows]
        out += [b"\x21\xf9\x04\x04", delay.to_bytes(2, "little"), b"\0\0", b"\x2c\0\0\0\0", width.to_bytes(2, "little"), (len(part) // width).to_bytes(2, "little"), b"\0\x08"]
        out.append(_sub_blocks(lzw_encode(part)))
        out.append(b"\0")
    return b"".join([*out, b"\x3b"])


def histogram(frame: Frame, bins: int = BINS, own: bool = False) -> np.ndarray:
    """Counts of each colour channel's ``bins`` equal ranges (3 x bins) over the visible canvas, or over what is visible of the frame's ``own`` rectangle."""
    part = frame.canvas[frame.top : frame.top + frame.index.shape[0], frame.left : frame.left + frame.index.shape[1]] if own else frame.canvas
    there = part[..., 3] > 0
    seen = part.reshape(-1, 4) if there.all() else part[there]
    return np.stack([np.bincount(seen[:, c] >> 4 if bins == 16 else seen[:, c].astype(int) * bins // 256, minlength=bins) for c in range(3)])


def payload_of(text: str | None, unit: int = WIDTH) -> tuple[bytes, int]:
    """A text's UTF-8 bytes filled up with 255 to a positive multiple of ``unit``, and their number before that."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    size = max(unit, -(-len(raw) // unit) * unit)
    return raw + b"\xff" * (size - len(raw)), len(raw)


@dataclass
class Stored:
    """What reading a stored GIF back gives: the payload's size, digest and end, and sums over its timed frames."""

    size: int
    sha256: str
    tail: bytes
    frames: int
    duration_cs: int
    counts: np.ndarray  # of each colour's BINS ranges over all frames' own rectangles (3 x BINS)

    @property
    def feature(self) -> str:
        return f"frames={self.frames};cs={self.duration_cs};grey=" + ",".join(map(str, self.counts[0]))  # of grey, all channels are alike


def read_back(media: bytes, each=None) -> Stored:
    """The stored payload read by way of palette and canvas, frame by frame; ``each`` gets every frame's bytes.

    Only one frame is held beside the media itself, whatever the payload's size.
    """
    sha, tail, total, clock, n, size = hashlib.sha256(), b"", np.zeros((3, BINS), np.int64), 0, 0, 0
    for f in frames_of(media):
        own = f.canvas[f.top : f.top + f.index.shape[0], f.left : f.left + f.index.shape[1], 0].tobytes()
        sha.update(own)
        tail = (tail + own[-32:])[-32:]
        size += len(own)
        total += histogram(f, own=True)
        clock = f.start_cs + f.delay_cs
        n += 1
        if each:
            each(own)
    return Stored(size, sha.hexdigest(), tail, n, clock, total)


def _media(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in common.sliced(batches, held=BATCH_BYTES // 4):
        made = [(n, encode(payload)) for payload, n in map(payload_of, b.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([m for _, m in made], pa.binary())], names=["id", "n_bytes", "media"])


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, media): every text as a GIF of timed frames, a row per row; ``frames`` reads the media column.

    Null and empty texts are one unit of bytes 255; repeated rows stay repeated;
    an empty table gives an empty one.
    """
    common.shipped(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return common.spread(rows).mapInArrow(_media, f"id {dict(rows.dtypes)['id']}, n_bytes long, media binary").withColumnRenamed("id", id_col)


_KINDS = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "n_frames": pa.int64(), "duration_cs": pa.int64()} | {c: pa.list_(pa.int64()) for c in ("red", "green", "blue")}


def _store(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in common.sliced(batches):
        rows = []
        for n, media in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            back = read_back(media)
            rows.append((n, back.size, back.sha256, zlib.crc32(back.tail), len(media), hashlib.sha256(media).hexdigest(), back.feature, back.frames, back.duration_cs, *back.counts.tolist()))
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(zip(*rows), _KINDS.values())]], names=["id", *_KINDS])


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text stored as a GIF and read back from the media column: a row per row.

    (id_col, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature,
    n_frames, duration_cs, red, green, blue): sizes, digests, and the colour histograms
    summed over the timed frames.  Null and empty texts are one unit of bytes
    255.  Equal texts give equal values; repeated rows stay repeated; an empty table
    gives an empty one; other columns are ignored, whatever their names.
    """
    rows = media(docs, id_col, text_col).withColumnRenamed(id_col, "id")
    text = {pa.string(): "string", pa.int64(): "long"}
    schema = ", ".join([f"id {dict(rows.dtypes)['id']}", *[f"{c} {text.get(k, 'array<long>')}" for c, k in _KINDS.items()]])
    return rows.mapInArrow(_store, schema).withColumnRenamed("id", id_col)


FRAMES = "id {0}, frame int, start_cs long, delay_cs long, left int, top int, width int, height int, samples binary, red array<long>, green array<long>, blue array<long>"


def _frames(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hist = pa.list_(pa.int64())
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), hist, hist, hist]
    names = ["frame", "start_cs", "delay_cs", "left", "top", "width", "height", "samples", "red", "green", "blue"]
    for b in common.sliced(batches, 16):
        for id_, data in zip(b.column(0), b.column(1).to_pylist()):
            rows, held, found = [], 0, frames_of(data or b"")
            made = lambda: pa.RecordBatch.from_arrays([pa.array([id_.as_py()] * len(rows), b.schema.field(0).type), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], names=["id", *names])  # noqa: B023, E731
            n = 0
            while True:
                try:
                    f = next(found, None)
                except ValueError:
                    f = None
                if f is None:
                    break
                rows.append((n, f.start_cs, f.delay_cs, f.left, f.top, f.index.shape[1], f.index.shape[0], f.canvas.tobytes(), *histogram(f).tolist()))
                n, held = n + 1, held + f.canvas.nbytes
                if held >= BATCH_BYTES:
                    yield made()
                    rows, held = [], 0
            if rows:
                yield made()


def frames(media: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """One row per frame of every GIF in ``media``: timing, place, RGBA canvas and colour histograms.

    Null values, bytes that aren't a GIF and screens over PIXELS give no rows; an empty
    table gives an empty one.  Each media object is read whole by one task, and
    its frames leave it in batches of about BATCH_BYTES.
    """
    common.shipped(media.sparkSession)
    rows = media.select(F.col(id_col).alias("id"), F.col(data_col).alias("data"))
    return rows.mapInArrow(_frames, FRAMES.format(dict(rows.dtypes)["id"])).withColumnRenamed("id", id_col)

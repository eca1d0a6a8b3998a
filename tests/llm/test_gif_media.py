import hashlib
import os
import random
import tracemalloc
import zlib

import numpy as np
import pytest

from wireloom.llm import gif_media as G

from .edge import docs, empty


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 3837, 3838, 3839, 3840, 3841, 4095, 4096, 20000])
@pytest.mark.parametrize("kind", ["noise", "flat", "text"])
def test_lzw_round_trip(n, kind):
    draw = random.Random(n)
    data = {"noise": os.urandom(n), "flat": bytes(n), "text": bytes(draw.choice(b"abcd ") for _ in range(n))}[kind]
    assert G.lzw_decode(G.lzw_encode(data)) == data


def slow_decode(stream, bits):
    """The textbook decoder, bit by bit."""
    clear, out, at = 1 << bits, b"", 0
    width, table, last = bits + 1, [], None
    bitstring = "".join(f"{b:08b}"[::-1] for b in stream)
    while at + width <= len(bitstring):
        code = int(bitstring[at : at + width][::-1], 2)
        at += width
        if code == clear:
            width, table, last = bits + 1, [bytes([i]) for i in range(clear)] + [b"", b""], None
            continue
        if code == clear + 1:
            break
        word = table[code] if code < len(table) else last + last[:1]
        if last is not None and len(table) < 4096:
            table.append(last + word[:1])
            if len(table) == 1 << width and width < 12:
                width += 1
        out, last = out + word, word
    return out


@pytest.mark.parametrize("bits", [2, 4, 8])
def test_lzw_against_the_textbook(bits):
    draw = random.Random(bits)
    data = bytes(draw.randrange(min(6, 1 << bits)) for _ in range(9000))
    stream = G.lzw_encode(data, bits)
    assert slow_decode(stream, bits) == data == G.lzw_decode(stream, bits)
    assert G.lzw_decode(stream[:1000], bits) == data[: len(G.lzw_decode(stream[:1000], bits))]


def test_full_table_without_clear():
    """An encoder may go on with a full table."""
    draw = random.Random(0)
    data = bytes(draw.randrange(256) for _ in range(6000))
    book, codes, width, out, now = {bytes([i]): i for i in range(256)}, [(256, 9)], 9, b"", b""
    free = 258
    for i in range(len(data)):
        x = now + data[i : i + 1]
        if x in book:
            now = x
            continue
        codes.append((book[now], width))
        if free < 4096:
            book[x] = free
            if free == 1 << width:
                width += 1
            free += 1
        now = data[i : i + 1]
    codes += [(book[now], width), (257, width)]
    bits = "".join(f"{c:0{w}b}"[::-1] for c, w in codes)
    bits += "0" * (-len(bits) % 8)
    stream = bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))
    assert G.lzw_decode(stream) == data


def gif(frames, w=4, h=4, palette=((0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255))):
    """A GIF of (left, top, rows, delay, disposal, transparent, interlace, local palette)."""
    out = b"GIF89a" + w.to_bytes(2, "little") + h.to_bytes(2, "little") + b"\x81\0\0" + bytes(sum(palette, ()))
    for left, top, rows, delay, disposal, clear, lace, own in frames:
        out += b"\x21\xf9\x04" + bytes([disposal << 2 | (clear is not None)]) + delay.to_bytes(2, "little") + bytes([clear or 0]) + b"\0"
        out += b"\x2c" + b"".join(x.to_bytes(2, "little") for x in (left, top, len(rows[0]), len(rows))) + bytes([(0x81 if own else 0) | (0x40 if lace else 0)])
        if own:
            out += bytes(sum(own, ()))
        order = [*range(0, len(rows), 8), *range(4, len(rows), 8), *range(2, len(rows), 4), *range(1, len(rows), 2)] if lace else range(len(rows))
        stream = G.lzw_encode(bytes(x for r in order for x in rows[r]), 2)
        out += b"\x02" + b"".join(bytes([len(stream[i : i + 3])]) + stream[i : i + 3] for i in range(0, len(stream), 3)) + b"\0"
    return out + b"\x3b"


FULL = [[1] * 4] * 4


def test_disposal_transparency_palettes_interlace():
    local = ((9, 9, 9), (1, 2, 3), (4, 5, 6), (7, 8, 9))
    f = G.decode(gif([(0, 0, FULL, 5, 1, None, False, None), (1, 1, [[2, 0], [0, 2]], 7, 2, 0, False, None), (0, 0, [[3, 3]], 1, 3, None, False, None), (2, 2, [[1, 2], [3, 0]], 2, 0, None, False, local), (0, 0, [[0], [1], [2], [3]], 0, 0, None, True, None)]))
    assert [(x.start_cs, x.delay_cs) for x in f] == [(0, 5), (5, 7), (12, 1), (13, 2), (15, 0)]
    red, green, blue = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255]
    assert (f[0].canvas == red).all()
    assert f[1].canvas[1, 1].tolist() == green and f[1].canvas[1, 2].tolist() == red  # index 0 is see-through
    assert f[2].canvas[1, 1].tolist() == [0, 0, 0, 0] and f[2].canvas[0, 0].tolist() == blue  # cleared, then drawn
    assert f[3].canvas[0, 0].tolist() == red and f[3].canvas[2, 2].tolist() == [1, 2, 3, 255] and f[3].canvas[3, 3].tolist() == [9, 9, 9, 255]
    assert f[4].index[:, 0].tolist() == [0, 1, 2, 3]
    h = G.histogram(f[0])
    assert h.shape == (3, 16) and h[0, 15] == 16 and h[1, 0] == 16


def test_not_a_gif_and_broken_off():
    with pytest.raises(ValueError):
        G.decode(b"PNG")
    whole = G.encode(G.payload_of("hello " * 500)[0])
    assert len(G.decode(whole[:-200])) == 1 and len(G.decode(whole[:790])) == 0


def test_big_payload_has_several_frames():
    payload = os.urandom(576 * 600)
    parts = []
    back = G.read_back(G.encode(payload), parts.append)
    assert b"".join(parts) == payload and back.feature.startswith("frames=3;cs=12;")
    assert (back.size, back.sha256, back.tail) == (len(payload), hashlib.sha256(payload).hexdigest(), payload[-32:])


def test_reading_back_holds_one_frame():
    """Twenty MB of samples are read back with the memory of a few frames."""
    media = G.encode(b"all alike " * (576 * 3600))
    tracemalloc.start()
    back = G.read_back(media)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert back.frames == 141 and back.size > 20_000_000 and peak < 12_000_000


@pytest.mark.parametrize("data", [b"GIF89a" + (60000).to_bytes(2, "little") * 2 + b"\0\0\0", b"GIF89a\xff\xff\xff\xff\xf7\0\0"])
def test_hostile_screens_are_refused_before_any_canvas(spark, data):
    with pytest.raises(ValueError):
        next(G.frames_of(data))
    df = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(gif([(0, 0, FULL, 5, 1, None, False, None)])))], "id long, data binary")
    assert [r.id for r in G.frames(df, "id", "data").collect()] == [2]


def test_hostile_frames_end_the_frames():
    ok = gif([(0, 0, FULL, 5, 1, None, False, None)])[:-1]
    huge = b"\x2c\0\0\0\0\xff\xff\xff\xff\0\x08\x01\x00\0\x3b"
    tracemalloc.start()
    assert len(G.decode(ok + huge)) == 1
    assert tracemalloc.get_traced_memory()[1] < 1_000_000
    tracemalloc.stop()
    small_screen = b"GIF89a\x04\0\x04\0\x80\0\0" + bytes(6)
    assert len(G.decode(small_screen + b"\x2c\x09\0\x09\0\x02\0\x02\0\0\x02\x01\x2c\0\x3b")) == 1  # a frame beside the screen shows nothing
    assert G.decode(b"GIF89a\x04\0\x04\0\x81\0\0\1\2") == []  # a palette that breaks off


def test_many_frames_leave_in_batches(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(G, "BATCH_BYTES", 200)
    data = gif([(0, 0, FULL, 5, 1, None, False, None)] * 10)
    got = list(G._frames([pa.RecordBatch.from_arrays([pa.array([7]), pa.array([data], pa.binary())], names=["id", "data"])]))
    assert [b.num_rows for b in got] == [4, 4, 2] and [x for b in got for x in b.column(1).to_pylist()] == [*range(10)]


def check(df):
    got = {}
    for r in G.stored(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    for r in df.collect():
        raw = (r.text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        for x in got[r.doc_id]:
            assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
            media = G.encode(payload)
            assert (x.media_bytes, x.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
            grey = np.bincount(np.frombuffer(payload, np.uint8) >> 4, minlength=16).tolist()
            assert x.feature.endswith(",".join(map(str, grey)))
            frames = -(-len(payload) // (576 * 256))
            assert (x.n_frames, x.duration_cs, x.red, x.green, x.blue) == (frames, 4 * frames, grey, grey, grey)


def test_edge_cases_and_table(spark, sf):
    check(docs(spark, "feature"))
    check(spark.read.parquet(f"{sf}/documents.parquet"))
    assert G.stored(empty(spark)).count() == 0


def test_frames_table(spark):
    data = gif([(0, 0, FULL, 5, 1, None, False, None), (1, 1, [[2, 0], [0, 2]], 7, 2, 0, False, None)])
    df = spark.createDataFrame([(1, bytearray(data)), (2, None), (3, bytearray(b"no"))], "id long, data binary")
    got = G.frames(df, "id", "data").orderBy("frame").collect()
    assert [(r.id, r.frame, r.start_cs, r.delay_cs, r.left, r.width) for r in got] == [(1, 0, 0, 5, 0, 4), (1, 1, 5, 7, 1, 2)]
    assert got[0].red[15] == 16 and got[1].green[15] == 2


def test_media_column_frames_and_features_agree(spark, monkeypatch):
    """The registered query's features are those of the frame rows of the same media column."""
    texts = {1: "first frame " * 20_000, 2: "short", 3: None, 4: ""}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = G.media(df)
    assert kept.columns == ["doc_id", "n_bytes", "media"]
    data = {r.doc_id: bytes(r.media) for r in kept.collect()}
    assert {i: hashlib.sha256(m).hexdigest() for i, m in data.items()} == {r.doc_id: r.media_sha256 for r in G.stored(df).collect()}
    rows = G.frames(kept, "doc_id", "media").orderBy("doc_id", "frame").collect()
    for r in G.stored(df).collect():
        own = [x for x in rows if x.doc_id == r.doc_id]
        assert r.feature.startswith(f"frames={len(own)};cs={own[-1].start_cs + own[-1].delay_cs};grey=")
        if len(own) == 1:
            assert own[0].red == own[0].green == own[0].blue and r.feature.endswith("grey=" + ",".join(map(str, own[0].red)))
    assert [r.frame for r in rows if r.doc_id == 1] == [0, 1]
    calls, histogram = [], G.histogram
    monkeypatch.setattr(G, "histogram", lambda *a, **kw: (calls.append(1), histogram(*a, **kw))[1])
    G.read_back(data[1])
    assert len(calls) == 2


def test_histogram_of_the_own_rectangle():
    f = G.decode(gif([(0, 0, FULL, 5, 1, None, False, None), (1, 1, [[2, 3], [0, 2]], 7, 2, 0, False, None)]))[1]
    assert G.histogram(f)[:, 15].tolist() == [13, 2, 1] and G.histogram(f, own=True)[:, 15].tolist() == [1, 2, 1]

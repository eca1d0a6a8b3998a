import json
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from wireloom.llm import common, token_store

from .edge import docs, empty

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("values", [[0], [0, 0, 0], [0, 1], [0] * 600 + [7], sorted(random.Random(1).choices(range(10**9), k=3000)), list(range(1000)), [0, 2**40]])
def test_elias_fano(values):
    ef = token_store.EliasFano.of(np.array(values))
    assert ef.all().tolist() == values
    assert [ef.select(i) for i in range(len(values))] == values
    if len(values) > 1000 and values[-1] > 10**8:
        assert ef.n_bytes * 8 / len(values) < 2 + np.log2(values[-1] / len(values)) + 1


@pytest.mark.parametrize("values", [[0], [0, 0, 0], [0] * 600 + [7], sorted(random.Random(1).choices(range(10**9), k=3000)), list(range(1000)), [0, 2**40], [*range(300), *range(10**6, 10**6 + 300)]])
def test_elias_fano_between(values):
    ef = token_store.EliasFano.of(np.array(values))
    draw = random.Random(len(values))
    for i, j in [(0, len(values)), (len(values) - 1, len(values)), *(sorted(draw.sample(range(len(values) + 1), 2)) for _ in range(300))]:
        assert ef.between(i, j).tolist() == values[i:j], (i, j)


def test_read_decodes_no_more_than_a_block_of_boundaries(tmp_path, monkeypatch):
    """A file of several blocks is read by select, never by a table of all its boundaries."""
    draw = random.Random(4)
    rows = [(i, np.array([draw.randrange(50_000) for _ in range(draw.randint(1, 9))], "<u2")) for i in range(2500)]
    path = f"file://{tmp_path}/part-000000.tok"
    fs, at = common.file_system(path)
    writer = token_store.TokenFileWriter(fs.open_output_stream(at), False)
    for i, ids in rows:
        writer.add(i, ids)
    writer.close()
    spans, between = [], token_store.EliasFano.between
    monkeypatch.setattr(token_store.EliasFano, "all", lambda self: pytest.fail("all boundaries at once"))
    monkeypatch.setattr(token_store.EliasFano, "between", lambda self, i, j: (spans.append((i, j)), between(self, i, j))[1])
    batch = pa.RecordBatch.from_arrays([pa.array([path]), pa.array([10], pa.int64())], names=["path", "before"])
    got = [r for b in token_store._read([batch]) for r in zip(*b.to_pydict().values())]
    want, start = [], 10
    for i, ids in rows:
        want.append((i, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
        start += len(ids)
    assert got == want and spans == [(0, 1025), (1024, 2049), (2048, 2501)]


def expect(lib, table):
    out, start = [], 0
    for d, t in sorted(table, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def stored(spark, df, **kw):
    return token_store.read(spark, token_store.write(df, PATH, common.new_path(spark, "tok"), **kw))


@pytest.mark.parametrize("files", [None, 1, 7])
def test_edge_cases(spark, lib, files):
    df = docs(spark, "start")
    got = sorted(map(tuple, stored(spark, df, files=files).collect()), key=lambda r: r[1])
    assert got == expect(lib, [(r.doc_id, r.text) for r in df.collect()])


def test_special_tokens_are_the_library_s(spark, lib):
    """Added tokens in a text become their own ids, wherever they stand."""
    end = "<|endoftext|>"
    texts = [end, f"hello {end} world", f"a{end}{end}  b", f" {end}\n\n {end[:-1]}{end}", f"{end}'s", f"x  {end}  y " * 50, end[1:], "<|endoftext|"]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = sorted(map(tuple, stored(spark, df, files=2).collect()))
    assert got == expect(lib, [*enumerate(texts)])
    assert 50256 in lib.encode(texts[1], add_special_tokens=False).ids and token_store.LibraryEncoder(PATH).by_piece


@pytest.mark.parametrize("change", [lambda s: s["added_tokens"][0].update(lstrip=True), lambda s: s["pre_tokenizer"].update(add_prefix_space=True), lambda s: s.update(normalizer={"type": "Lowercase"})])
def test_other_tokenizers_get_whole_texts(tmp_path, change):
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    change(spec)
    path = tmp_path / "t.json"
    path.write_text(json.dumps(spec))
    own, lib = token_store.LibraryEncoder(str(path)), Tokenizer.from_file(str(path))
    texts = ["A b  <|endoftext|> c", "", " x<|endoftext|>"]
    assert not own.by_piece
    assert [x.tolist() for x in own.encode(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_empty(spark):
    assert stored(spark, empty(spark)).count() == 0


def test_table_and_random_access(spark, sf, lib):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    data = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted(map(tuple, stored(spark, df, files=3).collect()), key=lambda r: r[1]) == expect(lib, data)
    files = token_store.write(df, PATH, common.new_path(spark, "tok"), files=3)
    text = dict(data)
    for path, *_ in files:
        fs, at = common.file_system(path)
        with fs.open_input_file(at) as f:
            t = token_store.TokenFile(f, f.size())
            for i in range(0, t.n, 11):
                assert t.document(i).tolist() == [*lib.encode(text[int(t.docs[i])], add_special_tokens=False).ids, 2]


def test_pieces_and_whole_texts_agree(lib):
    own = token_store.LibraryEncoder(PATH)
    assert own.by_piece and not own.wide
    draw = random.Random(5)
    texts = ["".join(draw.choice("aabe thé'sn 1 \n\t日'll  <|endoftext|>") for _ in range(draw.randint(0, 300))) for _ in range(500)]
    assert [x.tolist() for x in own.encode(texts)] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]

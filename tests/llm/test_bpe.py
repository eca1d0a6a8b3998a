import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from wireloom.llm import bpe

from .edge import docs, empty

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def lib():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def want(lib, text):
    ids = np.array(lib.encode_ordinary(text or ""), "<u4").tobytes()
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_random_texts_against_the_library(lib):
    codec = bpe.Codec(bpe.load_ranks(PATH), P.PATTERN, remembered=50)
    draw = random.Random(3)
    for _ in range(800):
        t = "".join(draw.choice("aabe thé'sn 1 \n\t日<|endoftext|>\x00\u2028") for _ in range(draw.randint(0, 200)))
        ids = codec.encode(t)
        assert ids == np.array(lib.encode_ordinary(t), "<u4").tobytes() and codec.decode(ids) == t.encode()


def test_long_pieces(lib):
    codec = bpe.Codec(bpe.load_ranks(PATH), P.PATTERN)
    for t in ("a" * 30000, " " * 30000 + "x", "ab" * 9000, "日本" * 5000, "=!" * 8000):
        assert codec.encode(t) == np.array(lib.encode_ordinary(t), "<u4").tobytes()


def test_a_later_pair_may_have_a_lower_rank():
    """Ranks that no training would give: the queue has to look again after each merge."""
    ranks = {bytes([c]): c - 97 + 10 for c in b"abcd"} | {b"ab": 3, b"abc": 1, b"cd": 0 + 2, b"bc": 9}
    lib = tiktoken.Encoding("x", pat_str=r"\S+", mergeable_ranks={**ranks, **{bytes([i]): 100 + i for i in range(256) if bytes([i]) not in ranks}}, special_tokens={})
    full = {**ranks, **{bytes([i]): 100 + i for i in range(256) if bytes([i]) not in ranks}}
    draw = random.Random(1)
    for _ in range(500):
        s = "".join(draw.choice("abcd") for _ in range(draw.randint(1, 30)))
        assert bpe.encode_piece(s.encode(), full) == lib.encode_ordinary(s)


def test_queue():
    q = bpe.RankQueue(50_000)
    draw = random.Random(2)
    items = [(draw.randrange(50_000), i) for i in range(2000)] + [(7, 3), (7, 1), (49_999, 0)]
    for r, i in items:
        q.push(r, i)
    got = []
    while (x := q.pop()) is not None:
        got.append(x)
    assert got == sorted(items)


def test_edge_cases_and_table(spark, sf, lib):
    for df in (docs(spark, "n_tokens"), spark.read.parquet(f"{sf}/documents.parquet")):
        out = bpe.encoded(df, PATH, P.PATTERN, keep_ids=True)
        got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()), key=repr)
        assert got == sorted(((r.doc_id, *want(lib, r.text)) for r in df.collect()), key=repr)
    back = bpe.decoded(bpe.encoded(docs(spark), PATH, P.PATTERN, keep_ids=True), PATH)
    texts = sorted((r.text or "").encode() for r in docs(spark).collect())
    assert sorted(bytes(r.decoded) for r in back.collect()) == texts
    assert bpe.encoded(empty(spark), PATH, P.PATTERN).count() == 0

"""A quality classifier learned by Bradley-Terry pairwise ranking.

A document's strength is linear in features of its text.  A preference pair is a
labelled good and a labelled bad document; the chance that the good one wins is
the logistic of the difference of their strengths, so the model is learned by
logistic loss on feature differences.  The cut is the quantile of the training
scores that leaves out the share of bad documents best; scores are shifted
so that the cut stands at ``CUT``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows that a model is learned from at most (those with the lowest hash of their id).
SAMPLE = 20_000
#: Preference pairs drawn from them.
PAIRS = 200_000
#: How many times more strongly the weights of hashed features are held near 0 than those of style features.
HASHED_RIDGE = 100.0
#: Pairs whose differences are held at a time.
PAIR_BLOCK = 20_000
#: The score from which a document counts as good.
CUT = 0.3
#: The share of labelled rows that learning never sees: crc32(doc_id) mod 5 is 0.
FOLDS = 5

STYLE = (
    "log_bytes", "log_words", "word_len", "upper", "digit", "blank", "newline", "high_byte", "comma_stop", "mark_bang",
    "symbol", "pipe", "other_punct", "same_as_last", "unique", "top_word", "has_symbol", "has_upper", "has_repeat", "has_pipe", "has_bang",
)
#: Buckets that the words, and the runs of three bytes, of a text are hashed to.
BUCKETS = 64
NAMES = (*STYLE, *(f"word_{i}" for i in range(BUCKETS)), *(f"bytes_{i}" for i in range(BUCKETS)))

_COMMA_STOP = np.frombuffer(b",.;:'\"-()", np.uint8)
_SYMBOL = np.frombuffer(b"#$%&*@^~<>{}[]\\/_+=`", np.uint8)


def _hashed(raw: bytes, kinds: dict[bytes, int], w: int) -> np.ndarray:
    """Square roots of the shares of a text's words, and of its runs of three bytes, that fall in each bucket."""
    out = np.zeros(2 * BUCKETS)
    if w:
        at = np.fromiter(map(crc32, kinds), np.uint32, len(kinds)) % np.uint32(BUCKETS)
        out[:BUCKETS] = np.bincount(at, np.fromiter(kinds.values(), float, len(kinds)), BUCKETS) / w
    for i in range(0, len(raw) - 2, _PIECE):
        b = np.frombuffer(raw, np.uint8)[i : i + _PIECE + 2].astype(np.uint32)
        h = (b[:-2] * _MIX[0] + b[1:-1] * _MIX[1] + b[2:] * _MIX[2]) * _MIX[3] >> np.uint32(26)
        out[BUCKETS:] += np.bincount(h, minlength=BUCKETS) / (len(raw) - 2)
    return np.sqrt(out)


# Odd multipliers of the hash of three bytes; it keeps the top six bits, so there are 64 buckets.
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35), np.uint32(0x27D4EB2F))
#: Bytes that are hashed at a time.
_PIECE = 1 << 20


def features(text: str | None) -> np.ndarray:
    """Style and hashed features of a whole text, one number a name in NAMES; null is the empty text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    words = raw.split()
    w = len(words)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = lambda k: float(k) / n if n else 0.0
    punct = int(count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum())
    calm, symbol, bang, pipe = int(count[_COMMA_STOP].sum()), int(count[_SYMBOL].sum()), int(count[33]), int(count[124])
    upper = int(count[65:91].sum())
    again = sum(map(bytes.__eq__, words, words[1:])) if w > 1 else 0
    kinds: dict[bytes, int] = {}
    for x in words:
        kinds[x] = kinds.get(x, 0) + 1
    top = max(kinds.values(), default=0)
    per_word = lambda k: float(k) / w if w else 0.0
    style = np.array(
        [
            np.log1p(n), np.log1p(w), n / w if w else 0.0, share(upper), share(count[48:58].sum()), share(count[32]), share(count[10]),
            share(count[128:].sum()), share(calm), share(bang), share(symbol), share(pipe), share(max(0, punct - calm - symbol - bang - pipe)),
            per_word(again), len(kinds) / w if w else 1.0, per_word(top) if w >= 20 else 0.0,
            min(1.0, 10 * per_word(symbol)), min(1.0, 5 * share(upper)), min(1.0, 5 * per_word(again)), min(1.0, 10 * per_word(pipe)), min(1.0, 10 * per_word(bang)),
        ]
    )
    return np.concatenate([style, _hashed(raw, kinds, w)])


@dataclass(frozen=True)
class Ranker:
    """Strength = weights . (features - mean) / scale; score = logistic(strength - shift)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    shift: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1 for each row of features; CUT stands at the chosen quantile."""
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights - self.shift
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def fit(x: np.ndarray, label: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, steps: int = 25, seed: int = 6, cut: float = CUT) -> Ranker:
    """A ranker from features and labels (1 good, 0 bad).

    ``pairs`` preference pairs are drawn with replacement, good against bad, and
    the ridge-regularised logistic loss on their differences is minimised by
    Newton steps.  If a class is missing there's nothing to prefer: all weights
    are 0 and every score is 0.5 (only good or no labels) or 0.25 (only bad ones).
    """
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        zero = np.zeros(len(NAMES))
        return Ranker(zero, zero + 1, zero, 0.0 if not len(bad) else float(np.log(3)))
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-12, scale, 1.0)
    z = np.clip((x - mean) / scale, -8, 8)
    draw = np.random.default_rng(seed)
    first, second = draw.choice(good, pairs), draw.choice(bad, pairs)
    w = np.zeros(z.shape[1])
    hold = ridge * np.where(np.arange(len(w)) < len(STYLE), 1.0, HASHED_RIDGE)
    for _ in range(steps):
        grad, hess = hold * w, np.diag(hold)
        for i in range(0, pairs, PAIR_BLOCK):
            d = z[first[i : i + PAIR_BLOCK]] - z[second[i : i + PAIR_BLOCK]]
            p = 1 / (1 + np.exp(-np.clip(d @ w, -500, 500)))
            grad += d.T @ (p - 1) / pairs
            hess += (d * (p * (1 - p))[:, None]).T @ d / pairs
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    order = np.argsort(s, kind="stable")
    s, y = s[order], label[order]
    # errors if the lowest k documents are rejected: good ones below, bad ones above
    wrong = np.r_[0, np.cumsum(y == 1)] / len(good) + (len(bad) - np.r_[0, np.cumsum(y == 0)]) / len(bad)
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    k = int(best[len(best) // 2])
    low = s[k - 1] if k else s[0] - 1
    high = s[k] if k < len(s) else s[-1] + 1
    return Ranker(mean, scale, w, float((low + high) / 2 - np.log(cut / (1 - cut))))


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in common.sliced(batches):
        x = [features(t).tolist() for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64())), b.column(2)], names=["id", "x", "label"])


def held_out(id_col: str = "doc_id"):
    """Whether a row is in the fold that learning never sees."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def learned(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Ranker:
    """A ranker from the labelled documents outside the held-out fold.

    At most ``sample`` labels are used, those with the lowest hash of their id;
    only those go to the executors and only their features come back, one row a
    label however often its document is repeated (of different texts of one id, the one with
    the least features), so texts are not shuffled.  Labels other than 0
    and 1, null ids and ids with contradicting labels are left out; labels of no
    document have no effect; without any there is nothing to prefer (see :func:`fit`).
    Columns beside the id, the text and the label are never read.
    """
    common.shipped(docs.sparkSession)
    use = labels.select(F.col(id_col).alias("__lid"), F.col(label_col).cast("int").alias("__label")).filter("__label in (0, 1) and __lid is not null")
    use = use.filter(~held_out("__lid")).groupBy("__lid").agg(F.min("__label").alias("__label"), F.max("__label").alias("__most"))
    use = use.filter("__label = __most").orderBy(F.xxhash64("__lid"), "__lid").limit(sample).select("__lid", "__label")
    use = docs.sparkSession.createDataFrame(use.collect(), use.schema)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    rows = rows.join(F.broadcast(use), rows["__id"] == use["__lid"]).select("__lid", "__text", "__label")
    made = rows.mapInArrow(_features, f"id {dict(rows.dtypes)['__lid']}, x array<double>, label int")
    got = made.groupBy("id").agg(F.min("x").alias("x"), F.min("label").alias("label")).select("x", "label").toArrow()
    x = np.array(got.column("x").to_pylist(), dtype=float).reshape(-1, len(NAMES))
    y = np.array(got.column("label").to_pylist(), dtype=int)
    order = np.lexsort((*x.T[::-1], y))  # the same model whatever the order of the tasks
    return fit(x[order], y[order])


def _score(model: Ranker):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.sliced(batches):
            x = np.array([features(t) for t in b.column(0).to_pylist()]).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([pa.array(model.score(x)), *[b.column(i) for i in range(1, b.num_columns)]], names=["score", *b.schema.names[1:]])

    return run


def scored(docs: DataFrame, model: Ranker, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """(id_col, held_out, score, predicted) per row of ``docs``.

    Null texts are empty texts, and those have a score like any other.  A null
    id isn't held out.  Repeated rows stay repeated; an empty table gives an
    empty one; other columns are ignored.
    """
    common.shipped(docs.sparkSession)
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    out = common.spread(rows).mapInArrow(_score(model), f"score double, id {dict(rows.dtypes)['id']}")
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def kept(docs: DataFrame, model: Ranker, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` whose text scores ``cut`` or more, all columns as they are.

    Null texts are empty texts; nulls in other columns stay; repeated rows are
    all kept or none; an empty table gives an empty one.
    """
    common.shipped(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.sliced(batches):
            x = np.array([features(t) for t in b.column(b.schema.names.index(text_col)).to_pylist()]).reshape(-1, len(NAMES))
            yield b.filter(pa.array(model.score(x) >= cut))

    return common.spread(docs).mapInArrow(run, docs.schema)

"""Secret scans over an incremental ledger of content-addressed blobs.

Every text is a blob, named by its SHA-256.  A blob is scanned under a version
of the rules once, however many paths (documents, revisions) hold it and
however often the scan is run: pairs of blob and rule version that the ledger
already has are skipped.  What was found is joined back to all the paths.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bytes import u8
from . import common

# The three base rules and the least length of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
# Rules of our own beside the base ones.
EXTRA = (
    ("pem", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")),
    ("jwt", re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    ("vcs", re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}\b")),
)
# Where the key that a pem marker opens ends: its END line, or without one the headers
# and base64 that follow.  Newlines may be escaped, as in JSON and settings.
PEM_END = re.compile(r"-----END [A-Z ]*PRIVATE KEY-----")
PEM_BODY = re.compile(r"""(?x)
    (?: (?: NL [A-Za-z][A-Za-z0-9-]*+:\ [^\r\n\\]*+ )++ (?: NL (?= NL ) )? )?
    (?: [ \t]*+ [A-Za-z0-9+/]{16,}+ ={0,2}+ | NL [A-Za-z0-9+/]++ ={0,2}+ (?= [ \t"',;]*+ (?: \\[nr] | [\r\n] | \Z ) ) | (?: NL )++ [A-Za-z0-9+/]{16,}+ ={0,2}+ )++
""".replace("NL", r"(?:[ \t]*+(?:\r?\n|\r|(?:\\r)?\\n)[ \t>]*+)"))
# The jwt rule as it stands is quadratic on texts of nothing but starts; _tokens finds the same by whole runs joined by dots and where one of them can open a token.
JWT_RUNS = re.compile(r"[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++)*+")
JWT_OPEN = re.compile(r"\beyJ")

#: Kinds in the order in which spans at one start are listed.
KINDS = ("assign", "access", "hex", *(k for k, _ in EXTRA))
BASE = KINDS[:3]

#: The ledger keys what was scanned on this: a digest of all rules, so that changing one makes every blob unseen.
RULES_VERSION = hashlib.sha256("\n".join([*KINDS, *(f"{r.flags} {r.pattern}" for r in (ASSIGN, ACCESS, HEX, *(r for _, r in EXTRA), PEM_END, PEM_BODY, JWT_RUNS, JWT_OPEN)), str(ASSIGN_LEAST)]).encode()).hexdigest()[:16]

SPANS = "array<struct<kind: string, start: int, end: int>>"


def _keys(text: str) -> Iterator[tuple[int, int]]:
    """The private keys of a text, marker to END line; a key reaches to the next marker at most, which keeps this linear."""
    at = [m.span() for m in EXTRA[0][1].finditer(text)]
    for (start, body), (limit, _) in zip(at, [*at[1:], (len(text), 0)]):
        end = PEM_END.search(text, body, limit) or PEM_BODY.match(text, body, limit)
        yield start, end.end() if end else body


def _tokens(text: str) -> Iterator[tuple[int, int]]:
    """What the jwt rule finds, in linear time: every run is looked at once, as the first place in it that opens a token decides."""
    for m in JWT_RUNS.finditer(text):
        if ".eyJ" not in m[0]:
            continue
        runs, at = m[0].split("."), m.start()
        i = 0
        while i < len(runs) - 2:
            if runs[i + 1].startswith("eyJ") and len(runs[i + 1]) >= 11 and len(runs[i + 2]) >= 8:
                opens = JWT_OPEN.search(text, at, at + len(runs[i]))
                if opens and at + len(runs[i]) - opens.start() >= 11:
                    end = at + sum(map(len, runs[i : i + 3])) + 2
                    yield opens.start(), end
                    at, i = end + 1, i + 3
                    continue
            at, i = at + len(runs[i]) + 1, i + 1


def spans(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text: (kind, start, end), code points, end exclusive.

    In order of start, then of kind as listed.  A run of at least 24 hex digits
    is the longest there, as is a run after ``AKIA``: asking for the least
    length at once finds what dropping the shorter ones afterwards would.
    """
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    own = {"pem": _keys, "jwt": _tokens}
    for (kind, rule), hint in zip(EXTRA, ("-----BEGIN", ".eyJ", "gh")):
        if hint in text:
            found += [(kind, *s) for s in (own[kind](text) if kind in own else (m.span() for m in rule.finditer(text)))]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for b in common.sliced(batches):
        rows = [[dict(zip(("kind", "start", "end"), s)) for s in spans(t or "")] for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], names=["blob", "spans"])


def blob_of(text_col: str = "text"):
    """A text's name in the ledger; null is the empty text."""
    return F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)


#: Rows of a list of what to scan or to skip, or rows and spans of a table of findings, up to which it goes to every executor whole (some 100 bytes each).
SKIP_BOUND = 200_000
#: Bits a row to scan has in the bitmap that thins out the rest, and 4 KiB buckets of bits at most (32 MiB, sent to every executor).
BITS, MOST_BUCKETS = 64, 8192
_BUCKET = 1 << 15


def _of_long_lists(rows: DataFrame, paths: DataFrame, pick: DataFrame, picks: int, same: Column) -> DataFrame:
    """The ``rows`` that ``pick`` lists, where neither that list nor the other rows' is short.

    A bitmap of the listed rows' hashes passes them all and few others.  Which
    others is found out of ``paths``, without texts: up to SKIP_BOUND of them
    go to every executor, and again no text is shuffled.  Beyond that the texts
    that pass are shuffled, and where the bitmap would be more than half full all are.
    """
    buckets = min(MOST_BUCKETS, 1 << max(0, (picks * BITS // _BUCKET).bit_length()))
    if picks >= buckets * _BUCKET // 2:
        return rows.join(pick, same, "left_semi")
    at = lambda i, b: F.pmod(F.xxhash64(i, b), F.lit(buckets * _BUCKET))
    bucket, bit = lambda h: F.shiftright(h, 15), lambda h: h.bitwiseAND(F.lit(_BUCKET - 1))
    # dealt out before bits are set, so that a bucket is built once and not in every task
    marks = pick.select(at("__sid", "__sblob").alias("__at")).select(bucket(F.col("__at")).alias("__bucket"), bit(F.col("__at")).alias("__bit")).repartition("__bucket")
    bitmap = common.written(marks.groupBy("__bucket").agg(F.bitmap_construct_agg("__bit").alias("__bits")), "bitmap")

    def passed(df: DataFrame) -> DataFrame:
        h = at("__id", "__blob")
        byte = u8(F.col("__bits"), F.shiftright(bit(h), 3).cast("int"))
        isset = F.call_function("shiftright", byte, bit(h).bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1)) == 1
        return df.join(F.broadcast(bitmap), (bucket(h) == F.col("__bucket")) & isset, "left_semi")

    others = passed(paths).join(pick, same, "left_anti").select(F.col("__id").alias("__sid"), F.col("__blob").alias("__sblob"))
    others = common.written(others, "passed")
    if others.count() <= SKIP_BOUND:
        return passed(rows).join(F.broadcast(others), same, "left_anti")
    return passed(rows).join(pick, same, "left_semi")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: DataFrame | None = None, version: str = RULES_VERSION) -> tuple[DataFrame, DataFrame]:
    """(paths, ledger): all paths with their blob, and the ledger after this scan.

    ``paths`` is (id_col, blob), a row per row of ``docs``.  The ledger is
    (blob, version, spans), one row per scanned blob and rule version; blobs
    without spans are in it too, with an empty list.  Give the ledger of the
    last scan (None at first) and write what comes back.

    A blob is read from the path with the smallest id among those that hold it.
    Which rows are scanned (new blobs) and which aren't (repeats and what the
    ledger has) are two lists without texts; if the shorter one has up to
    SKIP_BOUND rows it goes to every executor and no text is shuffled, be it a
    small change to a large corpus or a corpus of few repeats.  Beyond that see
    :func:`_of_long_lists`.  Null texts are the empty blob; null ids are paths like others; repeated rows stay repeated; an empty
    table gives empty ones.
    """
    spark = docs.sparkSession
    common.shipped(spark)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    rows = rows.withColumn("__blob", blob_of("__text"))
    paths = common.written(rows.select("__id", "__blob"), "paths")
    first = paths.groupBy("__blob").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    known = F.lit(False)
    if ledger is not None:
        seen = ledger.filter(F.col("version") == version).select(F.col("blob").alias("__seen")).distinct()
        first, known = first.join(seen, F.col("__blob") == F.col("__seen"), "left"), F.col("__seen").isNotNull()
    blobs = common.written(first.select("__blob", "__first", "__n", known.alias("__known")), "blobs")
    picks, held = blobs.agg(F.count_if(~F.col("__known")), F.coalesce(F.sum("__n"), F.lit(0))).head()
    # one holder of every new blob, or all rows but those: every holder of a blob but the first, and all holders of a known one
    pick = blobs.filter(~F.col("__known")).select(F.col("__first").alias("__sid"), F.col("__blob").alias("__sblob"))
    how, chosen = "left_semi", pick
    if held - picks < picks:
        again = blobs.filter(F.col("__known") | (F.col("__n") > 1)).select("__blob", "__first", "__known")
        skip = paths.join(again, "__blob").filter(F.col("__known") | ~F.col("__id").eqNullSafe(F.col("__first")))
        how, chosen = "left_anti", skip.select(F.col("__id").alias("__sid"), F.col("__blob").alias("__sblob"))
    same = F.col("__id").eqNullSafe(F.col("__sid")) & (F.col("__blob") == F.col("__sblob"))
    if min(picks, held - picks) <= SKIP_BOUND:
        todo = rows.join(F.broadcast(chosen), same, how)
    else:
        todo = _of_long_lists(rows, paths, pick, picks, same)
    new = todo.select(F.col("__blob").alias("blob"), "__text")
    new = common.spread(new).mapInArrow(_scan, f"blob string, spans {SPANS}")
    new = common.written(new.dropDuplicates(["blob"]).select("blob", F.lit(version).alias("version"), "spans"), "ledger")
    out = new if ledger is None else ledger.select("blob", "version", "spans").unionByName(new)
    return paths.select(F.col("__id").alias(id_col), F.col("__blob").alias("blob")), out


#: First hex digits of the blobs that :func:`in_two_scans` has scanned before the rest comes.
EARLIER = "01234567"


def in_two_scans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(paths, ledger) of all of ``docs``, scanned as an earlier state and then as it stands now.

    The earlier state has about half of the blobs (by their digest).  Its written ledger is
    what the second scan starts from: that one goes over all rows, and only blobs
    that the first hasn't seen are scanned.
    """
    earlier = docs.filter(F.substring(blob_of(text_col), 1, 1).isin(*EARLIER))
    _, ledger = scan(earlier, id_col, text_col)
    return scan(docs, id_col, text_col, ledger=ledger)


def findings(paths: DataFrame, ledger: DataFrame, version: str = RULES_VERSION) -> DataFrame:
    """``paths`` with the spans of their blob under ``version`` (an empty list: none)."""
    got = ledger.filter((F.col("version") == version) & (F.size("spans") > 0)).select("blob", "spans")
    none = F.array().cast(SPANS)
    return paths.join(got, "blob", "left").withColumn("spans", F.coalesce("spans", none))


def digest_columns(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts a kind, the digest of the base spans and all spans as text."""
    is_base = lambda s: s["kind"].isin(*BASE)
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        id_col, *[count(k) for k in BASE], F.sha2(line(F.filter("spans", is_base)).cast("binary"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans")
    )


def mask(text: str, at: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans are one."""
    out, end = [], 0
    for kind, a, b in at:
        if a >= end:
            out += [text[end:a], f"[{kind}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def _mask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in common.sliced(batches):
        at = b.column(1).to_pylist()
        texts = b.column(0).to_pylist()
        new = [t if t is None or not s else mask(t, [(x["kind"], x["start"], x["end"]) for x in s]) for t, s in zip(texts, at)]
        rest = [b.column(i) for i in range(2, b.num_columns)]
        yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()), *rest], names=["t", *b.schema.names[2:]])


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every found span masked; all rows and columns stay.

    The blobs that hold anything are few; the texts meet them by blob.
    ``n_chars``, if there, follows the text.  Null texts stay null, and nulls
    in other columns stay; repeated rows stay repeated; an empty table gives an
    empty one.
    """
    names = docs.columns
    _, ledger = scan(docs, id_col, text_col)
    got = common.written(ledger.filter(F.size("spans") > 0).select(F.col("blob").alias("__b"), F.col("spans").alias("__spans")), "found")
    blobs, held = got.agg(F.count("*"), F.coalesce(F.sum(F.size("__spans")), F.lit(0))).head()
    hint = F.broadcast(got) if blobs + held <= SKIP_BOUND else got
    rows = docs.select(F.col(text_col).alias("t"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], blob_of(text_col).alias("__blob"))
    rows = rows.join(hint, F.col("__blob") == F.col("__b"), "left").select("t", "__spans", *[f"c{i}" for i, c in enumerate(names) if c != text_col])
    kinds = dict(docs.dtypes)
    schema = ", ".join(["t string", *[f"c{i} {kinds[c]}" for i, c in enumerate(names) if c != text_col]])
    out = rows.mapInArrow(_mask, schema)
    place = {c: F.col("t") if c == text_col else F.col(f"c{i}") for i, c in enumerate(names)}
    if "n_chars" in names:
        place["n_chars"] = F.when(F.col("t").isNull(), place["n_chars"]).otherwise(F.length("t").cast("long"))
    return out.select(*[place[c].alias(c) for c in names])

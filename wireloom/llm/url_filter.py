"""URL filters: host and path rules over a weighted vocabulary.

The vocabulary is matched by one Aho-Corasick automaton over the whole URL.
A hit counts only between boundaries (the neighbours aren't letters or digits).
One strict term rejects; so do several different soft ones.  A rule that
fits the host and the path decides before the vocabulary does.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

# One of these rejects a URL.
STRICT = ("porn", "xxx", "hentai", "escort", "camgirl", "sex-chat", "spam-farm", "malware", "phishing", "warez", "keygen", "cheap-pills", "viagra", "cialis")
# This many different ones of these reject a URL.
SOFT = ("adult", "bet", "betting", "bonus", "casino", "cheap", "click", "deal", "discount", "download", "free", "hot", "loan", "lottery", "nude", "pills", "poker", "prize", "promo", "sexy", "spam", "torrent", "win", "winner")
SOFT_LEAST = 2


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with all its subdomains and a path prefix."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the registered query.
RULES = (
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
)


def vocabulary(lines: Iterable[str]) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(strict, soft) out of lines of a term and its weight (``strict`` or ``soft``), in the order in which they come.

    Blank lines and lines from ``#`` on are left out, case is ignored in A-Z, a term that comes
    twice counts once, and as strict if it is that anywhere.  Anything else is an error.
    """
    weight: dict[str, str] = {}
    for line in lines:
        if not line.strip() or line.startswith("#"):
            continue
        term, _, kind = line.strip().rpartition(" ")
        term = term.strip().translate(_LOWER)
        if not term or kind not in ("strict", "soft"):
            raise ValueError(f"a line is a term and strict or soft, not {line!r}")
        weight[term] = "strict" if kind == "strict" else weight.get(term, kind)
    return tuple(t for t, k in weight.items() if k == "strict"), tuple(t for t, k in weight.items() if k == "soft")


def automaton(strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT):
    """The automaton over both lists; a term carries its weight (strict or not)."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for terms, is_strict in ((soft, False), (strict, True)):
        for t in terms:
            a.add_word(t.lower(), (t.lower(), is_strict))
    a.make_automaton()
    return a


def hits(url: str | None, a) -> tuple[int, int]:
    """(strict, soft): different terms of each list between boundaries; case is ignored in A-Z."""
    text = (url or "").translate(_LOWER)
    strict, soft = set(), set()
    for end, (term, is_strict) in a.iter(text):
        start = end - len(term) + 1
        if (start and text[start - 1].isalnum()) or (end + 1 < len(text) and text[end + 1].isalnum()):
            continue
        (strict if is_strict else soft).add(term)
    return len(strict), len(soft)


_LOWER = {i: i + 32 for i in range(65, 91)}


def _hits_udf(strict: tuple[str, ...], soft: tuple[str, ...]):
    @F.pandas_udf("struct<strict: long, soft: long>")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        a = automaton(strict, soft)
        for urls in parts:
            yield pd.DataFrame([hits(u, a) for u in urls], columns=["strict", "soft"])

    return count


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    got = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(got, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT, soft_least: int = SOFT_LEAST, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id_col, host, path, rule, verdict, strict_hits, soft_hits) per row of ``pages``.

    Of the rules that fit, the longest (host and path together) decides; rules
    of equal length are tried in the order given.  Without a rule the verdict is
    ``block`` on a strict hit or on ``soft_least`` different soft hits, else
    ``allow``.  Null URLs and URLs without ``://`` have an empty host and path;
    an empty or null URL is allowed.  URLs are judged whole, whatever their length;
    null ids stay; repeated rows stay repeated; an empty table gives an empty
    one; other columns are ignored, whatever their names.
    """
    common.shipped(pages.sparkSession)
    url = F.col("__url")
    rows = pages.select(F.col(id_col), F.col(url_col).alias("__url"))
    rows = rows.select(id_col, host_of(url).alias("host"), path_of(url).alias("path"), _hits_udf(strict, soft)(url).alias("__h"))
    rule = verdict = None
    for r in sorted(rules, key=lambda r: -len(r.text)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule = F.when(fits, r.text) if rule is None else rule.when(fits, r.text)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    method = F.when((F.col("__h.strict") > 0) | (F.col("__h.soft") >= soft_least), "block").otherwise("allow")
    return rows.select(
        id_col,
        "host",
        "path",
        (F.lit(None).cast("string") if rule is None else rule).alias("rule"),
        (method if verdict is None else verdict.otherwise(method)).alias("verdict"),
        F.col("__h.strict").alias("strict_hits"),
        F.col("__h.soft").alias("soft_hits"),
    )

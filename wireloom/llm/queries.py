"""The registered query of each operator here, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, embedding_dedup, gif_media, mixing, quality, secret_scan, simhash, token_store, url_filter, warc
from .common import new_path, table


def op1_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.resolved(warc.read(spark, folder))


def op3_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif_media.stored(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = table(spark, sf_dir, "documents")
    return bpe.encoded(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.sizes_of(table(spark, sf_dir, "documents"))
    return mixing.mixed(rows).select("doc_id", "size", "source_size", "target", "taken")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.learned(docs, table(spark, sf_dir, "labels")))


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    files = token_store.write(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), new_path(spark, "tokens"))
    return token_store.read(spark, files)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths, ledger = secret_scan.in_two_scans(table(spark, sf_dir, "documents"))
    return secret_scan.digest_columns(secret_scan.findings(paths, ledger))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name to its function."""
    return {f.__name__: f for f in (op1_embedding, op2_warc, op3_gif, op4_bpe, op5_mix, op6_quality, op7_tokens, op8_simhash, op9_url_filter, op10_secrets)}


# cosine in double precision over all pairs; components by reaching on along links
_OP1 = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0),
ok AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok AS a JOIN ok AS b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
d AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN d USING (vec_id)
"""

_OP2 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest, h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to FROM f
"""


def _op9() -> str:
    """The same rules and vocabulary as SQL; a term counts once, between characters that aren't letters or digits."""
    low = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    hit = lambda t: f"regexp_matches(u, '(^|[^\\p{{L}}\\p{{N}}]){t}($|[^\\p{{L}}\\p{{N}}])')"
    strict = " OR ".join(map(hit, url_filter.STRICT))
    soft = " + ".join(f"CAST({hit(t)} AS INT)" for t in url_filter.SOFT)
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    rules = sorted(url_filter.RULES, key=lambda r: -len(r.text))
    cases = lambda get: " ".join(f"WHEN {fits(r)} THEN '{get(r)}'" for r in rules)
    return (
        f"WITH a AS (SELECT page_id, {low} AS u, coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '') AS h, coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages), "
        f"b AS (SELECT page_id, u, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM a) "
        f"SELECT page_id, host, path, CASE {cases(lambda r: r.text)} END AS rule, CASE {cases(lambda r: r.verdict)} WHEN {strict} OR {soft} >= {url_filter.SOFT_LEAST} THEN 'block' ELSE 'allow' END AS verdict FROM b"
    )


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for those that SQL can express.

    The others rest on XXH64, a fitted model, LZW, merges or regular-expression
    positions; their tests hold them against brute force on small tables.
    """
    return {"op1_embedding": _OP1, "op2_warc": _OP2, "op9_url_filter": _op9()}

"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are
written as Parquet and read again as the next stage's documents.  All but the
last keep the columns of ``docs``, whatever else they hold; an empty table goes
through all of them as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wireloom.llm import bpe, mixing, quality, secret_scan, simhash
from wireloom.llm.common import dropped, table, written


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    A null text is judged as an empty one; repeated rows are all kept or none.
    Without labels of both kinds there is nothing to prefer: with good ones or none
    at all everything stays, with bad ones alone nothing does.
    """
    return quality.kept(docs, quality.learned(docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id.

    Null, empty and blank texts are one group; rows with a null id all stay;
    rows that repeat the kept id stay.
    """
    return simhash.keep_one(docs)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their texts masked; null and empty texts stay as they are."""
    return secret_scan.redacted(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of the documents in the sources' target proportions.

    A null source is a source, the last; documents of no words come once a whole
    pass; rows that tie where the cut falls share its words exactly.
    """
    return mixing.materialised(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every copy, with digests of the ids and of what they decode to; a null text has no ids."""
    import public_tokenizers as P

    return bpe.encoded(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, keep_ids=True)


STAGES = [
    ("quality classifier", good),
    ("SimHash near-dedup", distinct),
    ("secret scans", masked),
    ("mixing sources", mixed),
    ("byte-level BPE", tokens),
]

#: Learning, fingerprints, the scan's rules and the merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name.split()[0])
        dropped(before)  # the stage's own output holds all that follows needs
    return STAGES[-1][1](spark, docs, sf_dir)

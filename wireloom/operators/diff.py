"""Comparing two captures by the bytes of their packets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _named(rows: DataFrame, content: str) -> DataFrame:
    """``rows`` with the name that stands for their bytes: SHA-256 and length, both null for null."""
    data = F.col(content).cast("binary")
    return rows.withColumn("_name", F.when(data.isNotNull(), F.struct(F.sha2(data, 256).alias("digest"), F.octet_length(data).alias("size"))))


def _counted(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy(F.col("_name").alias(f"{name}n")).agg(F.count("*").alias(name))


def only_in(a: DataFrame, b: DataFrame, order: str = "number", content: str = "data") -> DataFrame:
    """The rows of ``a`` beyond as many equal ones as ``b`` has, the later ones left over.

    Bytes are equal if their SHA-256 and their lengths are, so the counts of both sides
    exchange names and not packets.  Contents that ``b`` hasn't are all left
    over and those that it has at least as often not at all: only the others
    are put in order.
    """
    a, b = _named(a, content), _named(b, content)
    mine, theirs = _counted(a, "_a"), _counted(b, "_b")
    over = mine.join(theirs, F.col("_an").eqNullSafe(F.col("_bn")), "left").select("_an", "_a", F.coalesce("_b", F.lit(0)).alias("_b")).filter("_a > _b")
    rows = a.join(over, F.col("_name").eqNullSafe(F.col("_an")))
    alone = rows.filter("_b = 0")
    place = F.row_number().over(Window.partitionBy("_name").orderBy(order))
    some = rows.filter("_b > 0").withColumn("_k", place).filter("_k > _b").drop("_k")
    return alone.unionByName(some).drop("_name", "_an", "_a", "_b")


def common(a: DataFrame, b: DataFrame, content: str = "data") -> DataFrame:
    """(common): how many packets the two have in common, equal ones as often as both have them."""
    both = _counted(_named(a, content), "_a").join(_counted(_named(b, content), "_b"), F.col("_an").eqNullSafe(F.col("_bn")))
    return both.agg(F.coalesce(F.sum(F.least("_a", "_b")), F.lit(0)).alias("common"))


def difference(a: DataFrame, b: DataFrame, order: str = "number", content: str = "data") -> DataFrame:
    """(side, number) of what only one of them has, in order."""
    a, b = (x.select(F.col(order).alias("number"), F.col(content).alias("data")) for x in (a, b))
    left = only_in(a, b).select(F.lit("a").alias("side"), "number")
    right = only_in(b, a).select(F.lit("b").alias("side"), "number")
    return left.unionByName(right)


def report(a: DataFrame, b: DataFrame, first: int = 20) -> DataFrame:
    """The first ``first`` differences of each side, as they are listed."""
    rows = difference(a, b)
    return rows.filter("side = 'a'").orderBy("number").limit(first).unionByName(rows.filter("side = 'b'").orderBy("number").limit(first))

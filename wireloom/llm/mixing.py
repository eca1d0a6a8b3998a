"""Mixing sources to target weights at exact word budgets.

Every row gets a hash-random key; the rows of a source are put in key order
by ranges of the key (a fixed number of ranges a source, so a hot source is
dealt over that many groups); the sums of the ranges give each range its
offset, and a running sum inside the range gives each row the number of words
before it.  The budget is cut at exactly that many words.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Key ranges a source is dealt over.
RANGES = 1024
#: Sources up to which their plan (some 100 bytes a source) goes to every executor whole; beyond it is an ordinary join.
SOURCES_BOUND = 100_000


def word_count(text: str | Column) -> Column:
    """Runs of anything but the six ASCII blanks; null counts 0.

    The blanks are made one kind, then counted where they follow a word: no
    array of the words is built, whatever the length of the text.
    """
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    marked = F.regexp_replace(c, common.WORD_PATTERN, "x")
    return F.length(F.translate(marked, " \t\n\x0b\f\r", "")).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...], total: int, most: int) -> dict[str | None, float]:
    """Target words of each source.

    ``sizes`` are (source, size).  Sources by code point, null last, take the
    weights in turn.  They share ``total`` by weight; a share of over ``most``
    times the source's size stops there and what is over is shared anew by
    weight among the others, until none is above.  Exact fractions are used,
    so the order of the additions can't matter.
    """
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size, fixed = dict(order), {}
    while True:
        free = [s for s, _ in order if s not in fixed]
        left = Fraction(total) - sum(fixed.values())
        by = sum(weight[s] for s in free)
        share = {s: left * weight[s] / by for s in free}
        over = {s: Fraction(most * size[s]) for s in free if share[s] > most * size[s]}
        if not over:
            return {s: float(x) for s, x in (fixed | share).items()}
        fixed |= over
        if len(fixed) == len(order):
            return {s: float(x) for s, x in fixed.items()}


def mixed(rows: DataFrame, source_col: str = "source", size_col: str = "size", id_col: str = "doc_id", weights: tuple[int, ...] = (1, 2, 3), total: float = 1.0, most: int = 3, seed: int = 5, ranges: int = RANGES, keep_key: bool = False) -> DataFrame:
    """``rows`` with source_size, target, before, epochs, cut and taken.

    ``before`` is the number of words of the source ahead of the row in key
    order.  A source's budget is its target rounded down to whole words:
    ``epochs`` whole passes, then the words up to the cut.  ``cut`` is how many words
    of this row the last, partial pass takes, and ``taken = epochs * size +
    cut``, at most ``most * size``.  The taken words of a source add up to its
    budget exactly.

    The driver holds one (source, size) pair a source, as the targets depend
    on all of them together; it goes to every executor whole up to SOURCES_BOUND
    sources, and by an ordinary join beyond.
    Null sources are one source, the last.  Null sizes count 0.  Rows that
    agree in id, source and size are interchangeable, so ties don't matter.
    Sources of no words get the target 0; an empty table gives an empty one.
    Columns of ``rows`` named like a result are replaced.
    """
    spark = rows.sparkSession
    mine = ["source_size", "target", "before", "epochs", "cut", "taken"]
    rows = rows.drop(*mine)
    src = F.col(source_col)
    rows = rows.withColumn(size_col, F.coalesce(F.col(size_col), F.lit(0)).cast("long"))
    rows = rows.withColumn("__key", F.xxhash64(F.lit(seed), F.col(id_col), src, F.col(size_col)))
    rows = rows.withColumn("__range", F.shiftright("__key", 64 - (ranges - 1).bit_length()).cast("int"))
    rows = common.written(rows, "mix")
    sums = common.written(rows.groupBy(src.alias("__s"), F.col("__range").alias("__r")).agg(F.sum(size_col).alias("__n")), "mix-sums")
    sizes = [(r[0], int(r[1])) for r in sums.groupBy("__s").agg(F.sum("__n")).collect()]
    want = targets(sizes, weights, Fraction(sum(n for _, n in sizes)) * Fraction(total), most) if sizes else {}
    plan = spark.createDataFrame([(s, n, want[s]) for s, n in sizes], "__p string, source_size long, target double")
    ahead = F.sum("__n").over(Window.partitionBy("__s").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.withColumn("__ahead", F.coalesce(ahead, F.lit(0))).drop("__n")
    plan = F.broadcast(plan) if len(sizes) <= SOURCES_BOUND else plan.hint("merge")
    offsets = offsets.join(plan, offsets["__s"].eqNullSafe(plan["__p"])).drop("__p")
    own = Window.partitionBy(source_col, "__range").orderBy("__key", F.col(id_col), size_col)
    inside = F.sum(size_col).over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col(size_col)
    out = rows.withColumn("__in", inside)
    out = out.join(offsets, src.eqNullSafe(offsets["__s"]) & (F.col("__range") == offsets["__r"]))
    budget = F.floor("target").cast("long")
    out = out.withColumn("before", F.col("__ahead") + F.col("__in"))
    out = out.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long"))
    rest = budget - F.col("epochs") * F.col("source_size")
    out = out.withColumn("cut", F.greatest(F.lit(0), F.least(F.col(size_col), rest - F.col("before"))).cast("long"))
    out = out.withColumn("taken", F.col("epochs") * F.col(size_col) + F.col("cut"))
    return out.drop("__range", "__in", "__ahead", "__s", "__r", *([] if keep_key else ["__key"]))


def sizes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size): one light row per row of ``docs``; texts stay where they are."""
    return docs.select(F.col(id_col), F.col(source_col), word_count(text_col).alias("size"))


def first_words(text: str | Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word (all of it if it has no more)."""
    c = F.col(text) if isinstance(text, str) else text
    end_of_word = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"
    n = n.cast("int")
    return F.array_join(F.slice(F.split(c, end_of_word, n + 1), F.lit(1), n), "")


def materialised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), seed: int = 5) -> DataFrame:
    """The mixed corpus itself: the columns of ``docs``, one row per copy taken.

    A row comes once per whole epoch and once more if the last pass takes all
    of it; the row that the cut falls into comes once more with its text up
    to the cut (of rows that agree there in id, source and size, those with the
    lower texts come first).  So a source's rows hold exactly its budget's
    words.  Rows that the budget doesn't reach are left out; rows of no words
    come once per whole epoch.  Texts are not shuffled, but for rows that agree in all
    that with their source's last row: what a row gets follows from its own key
    and its source's last key, and those are one row a source.  ``n_chars``, if
    there, follows the text.  Null texts have no words and null sources are one
    source; other columns stay as they are, whatever their names; an empty
    table gives an empty one.
    """
    names = docs.columns
    light = mixed(sizes_of(docs, id_col, text_col, source_col), source_col, "size", id_col, weights, seed=seed, keep_key=True)
    light = common.written(light, "mix-light")
    at = F.struct("__key", F.col(id_col).alias("id"), "size")
    last = light.filter("cut > 0").groupBy(F.col(source_col).alias("__s")).agg(F.max(at).alias("__last"))
    tied = light.groupBy(F.col(source_col).alias("__t"), at.alias("__at")).agg(F.sum("cut").alias("__cut"), F.count("*").alias("__k"))
    last = last.join(tied, last["__s"].eqNullSafe(tied["__t"]) & (last["__last"] == tied["__at"])).select("__s", "__last", "__cut", "__k")
    plan = light.groupBy(F.col(source_col).alias("__q")).agg(F.max("epochs").alias("__epochs"))
    plan = plan.join(last, plan["__q"].eqNullSafe(last["__s"]), "left").select("__q", "__epochs", "__last", "__cut", "__k")
    plan = common.written(plan, "mix-plan")
    sources, most_tied = plan.agg(F.count("*"), F.max("__k")).head()
    own = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])
    text, doc, src = (F.col(f"c{names.index(c)}") for c in (text_col, id_col, source_col))
    own = own.withColumn("size", word_count(text))
    own = own.withColumn("__at", F.struct(F.xxhash64(F.lit(seed), doc, src, F.col("size")).alias("__key"), doc.alias("id"), "size"))
    own = own.join(F.broadcast(plan) if sources <= SOURCES_BOUND else plan, src.eqNullSafe(plan["__q"]))
    if (most_tied or 0) > 1:
        # rows that agree with the last one share its words one after another: only they are put in order
        tie = F.coalesce(F.col("__at") == F.col("__last"), F.lit(False))
        order = Window.partitionBy(src).orderBy(text)
        before = (F.row_number().over(order) - 1) * F.col("size")
        some = own.filter(tie).withColumn("__cut", F.greatest(F.lit(0), F.least(F.col("size"), F.col("__cut") - before)).cast("long"))
        own = own.filter(~tie).unionByName(some)
    inside = F.coalesce(F.col("__at") < F.col("__last"), F.lit(False)) & (F.col("size") > 0)
    edge = F.coalesce(F.col("__at") == F.col("__last"), F.lit(False))
    full = inside | (edge & (F.col("__cut") >= F.col("size")))
    part = edge & (F.col("__cut") < F.col("size")) & (F.col("__cut") > 0)
    whole = F.col("__epochs") + full.cast("long")
    own = own.withColumn("__whole", whole).withColumn("__part", part)
    own = own.filter((F.col("__whole") > 0) | F.col("__part"))
    copies = F.transform(F.sequence(F.lit(1).cast("long"), F.col("__whole") + F.col("__part").cast("long")), lambda i: i > F.col("__whole"))
    own = own.withColumn("__short", F.explode(copies))
    cut = first_words(text, F.col("__cut"))
    changed = {text_col: F.when(F.col("__short"), cut).otherwise(text)}
    if "n_chars" in names:
        changed["n_chars"] = F.when(F.col("__short"), F.length(cut).cast("long")).otherwise(F.col(f"c{names.index('n_chars')}"))
    return own.select(*[changed.get(c, F.col(f"c{i}")).alias(c) for i, c in enumerate(names)])

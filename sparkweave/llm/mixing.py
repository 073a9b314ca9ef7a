"""Mixing sources to target weights by Pareto order sampling, with DataFrame operations only.

Each source gets a target of words by weight, bounded by a number of epochs. A document's expected
number of copies is proportional to its size, up to that number of epochs; the whole part is certain,
and for the rest p the documents of a source are ranked by random odds over inclusion odds,
(u / (1 - u)) / (p / (1 - p)), and taken in that order up to the words that remain: an
unequal-probability sample of fixed size in words. The documents that best fill what is left close
it. Rosén, "On sampling with probability proportional to size" (1997).

A source of any size is handled by partial aggregates: sums by size class find the scale of the
expectations, sums by rank class find where the ranking is cut, and only the ranks of the one class
with the cut are sorted. The decision about a row then depends on that row and its source's numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweave.llm.common import checked, indexed, n_words, stage, twins, uniform

WEIGHTS, SHARE, EPOCHS, SEED = (3.0, 1.0, 2.0), 1.5, 2.0, 1
#: Classes of ranks between 0 and 1.
CLASSES = 1 << 16
#: Documents that fill what the ranking leaves of a source's target.
CLOSING = 3
#: Equal rows that are numbered in one task.
NUMBERED = 200_000


def _targets(sources: DataFrame, share: float, epochs: float) -> DataFrame:
    """sources (weight, source_size) with target: share of all words by weight, none above epochs times its source.

    Each round fixes the sources that would be above and shares the rest anew; a round is one aggregate.
    """
    limit = F.col("source_size") * F.lit(float(epochs))
    words, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    total, level, fixed = min(share, epochs) * (words or 0), 0.0, -1
    level = total / weight if weight else 0.0
    while True:
        above = F.col("weight") * F.lit(level) > limit
        taken, free, n = sources.agg(F.sum(F.when(above, limit)), F.sum(F.when(~above, F.col("weight"))), F.count(F.when(above, 1))).first()
        if n == fixed or not free:
            break
        fixed, level = n, (total - (taken or 0.0)) / free
    return sources.withColumn("target", F.when(F.lit(not weight), 0.0).otherwise(F.least(F.col("weight") * F.lit(level), limit)))


def _size_class(size: Column) -> Column:
    """The size with its eight leading bits: at most 128 classes for each doubling."""
    shift = F.greatest(F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double"))) - 7, F.lit(0)).cast("int")
    unit = F.pow(F.lit(2.0), shift)
    return F.floor(size / unit) * unit


def _choice(rows: DataFrame, epochs: float) -> DataFrame:
    """rows (size, u, scale) with certain copies and the rank of the rest in (0, 1), null if there is none."""
    expected = F.when(F.col("size") == 0, 0.0).when(F.col("scale").isNull(), epochs).otherwise(F.least(F.lit(float(epochs)), F.col("scale") * _size_class(F.col("size"))))
    rows = rows.withColumn("expected", expected).withColumn("certain", F.floor(F.col("expected") + 1e-12).cast("long"))
    p = F.col("expected") - F.col("certain")
    odds = F.col("u") / (1 - F.col("u")) * (1 - p) / p
    return rows.withColumn("rank", F.when(p > 1e-12, odds / (1 + odds)))


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, size: Column | None, seed: int) -> tuple[Column, Column]:
    """Number of words, and a key fixed by id, text, source and seed."""
    return n_words(F.col(text_col)) if size is None else F.coalesce(size.cast("long"), F.lit(0)), F.xxhash64(F.col(id_col), F.col(text_col), F.col(source_col), F.lit(seed))


def _drawn(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """rows (own) with u: a number in (0, 1) fixed by the key, and among equal rows by a number."""
    if repeated.isEmpty():
        return rows.withColumn("u", uniform(F.col("own"), F.lit(0).cast("long"))).drop("own")
    return twins(rows, ["own"], repeated, "twin", NUMBERED).withColumn("u", uniform(F.col("own"), F.col("twin"))).drop("own", "twin")


def plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: Column | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, sources, repeated): the slim rows (doc_id, source, size, u), what decides about them for each source, and (own, n) of rows that repeat.

    weights go to the sources in ascending order, the null source last, and repeat.
    """
    own_size, own = _rows(docs, id_col, text_col, source_col, size, seed)
    plain = stage(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), own_size.alias("size"), own.alias("own")), "sizes")
    repeated = stage(plain.groupBy("own").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    rows = _drawn(plain, repeated) if repeated.isEmpty() else stage(_drawn(plain, repeated), "drawn")
    sources = indexed(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "src", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("src", F.lit(len(weights))) + 1).cast("int"))
    targets = stage(_targets(stage(sources.withColumn("weight", weight), "weights"), share, epochs).select(F.col("source").alias("of"), "src", "source_size", "target"), "targets")
    keyed = rows.join(checked(targets), F.col("source").eqNullSafe(F.col("of")))

    # the scale of expected copies: from the largest sizes on, those that reach all epochs are full
    classes = keyed.where("size > 0").groupBy("src", "target", _size_class(F.col("size")).alias("m")).agg(F.sum("size").alias("words"))
    larger, smaller = Window.partitionBy("src").orderBy(F.desc("m")).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("src").orderBy(F.desc("m")).rowsBetween(1, Window.unboundedFollowing)
    full = epochs * F.sum("words").over(larger) + epochs / F.col("m") * F.coalesce(F.sum(F.col("words") * F.col("m")).over(smaller), F.lit(0.0)) <= F.col("target")
    filled = classes.withColumn("full", full).groupBy("src").agg(F.first("target").alias("t"), F.sum(F.when(F.col("full"), epochs * F.col("words")).otherwise(0.0)).alias("a"), F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("words") * F.col("m"))).alias("b"))
    scales = stage(filled.select("src", F.when(F.col("b") > 0, (F.col("t") - F.col("a")) / F.col("b")).alias("scale"), F.lit(True).alias("has_words")), "scales")
    scaled = stage(targets.join(scales, "src", "left").withColumn("scale", F.when(F.col("has_words"), F.col("scale")).otherwise(0.0)).drop("has_words"), "scaled")
    chosen = _choice(rows.join(checked(scaled), F.col("source").eqNullSafe(F.col("of"))), epochs)

    # where the ranking is cut
    left = stage(chosen.groupBy("src").agg((F.first("target") - F.sum(F.col("size") * F.col("certain"))).alias("left")), "left")
    by_class = chosen.where("rank is not null").groupBy("src", F.floor(F.col("rank") * CLASSES).alias("class")).agg(F.sum("size").alias("words"))
    running = Window.partitionBy("src").orderBy("class")
    cuts = by_class.join(left, "src").withColumn("sum", F.sum("words").over(running)).where(F.col("sum") > F.col("left"))
    cut = stage(cuts.groupBy("src").agg(F.min_by(F.struct("class", (F.col("left") - F.col("sum") + F.col("words")).alias("rest")), "class").alias("c")).select("src", "c.class", "c.rest"), "cut")
    inside = chosen.join(checked(cut), "src").where(F.floor(F.col("rank") * CLASSES) == F.col("class"))
    peers = Window.partitionBy("src").orderBy("rank").rangeBetween(Window.unboundedPreceding, 0)
    last = stage(inside.withColumn("sum", F.sum("size").over(peers)).where(F.col("sum") <= F.col("rest")).groupBy("src").agg(F.max("rank").alias("upto")), "last")
    below = F.when(F.col("class").isNull(), 1.0).otherwise(F.col("class") / CLASSES)
    bounded = stage(scaled.join(cut, "src", "left").join(last, "src", "left").select(*scaled.columns, below.alias("below"), F.coalesce("upto", F.lit(-1.0)).alias("upto")), "bounded")

    # documents that fill what is left: the largest that fits, and at the end the one that comes nearest
    started = _choice(rows.join(checked(bounded), F.col("source").eqNullSafe(F.col("of"))), epochs)
    gap = F.first("target") - F.sum(F.col("size") * (F.col("certain") + F.coalesce(_sampled().cast("int"), F.lit(0))))
    state = stage(bounded.join(started.groupBy("src").agg(gap.alias("gap")), "src", "left").withColumn("closed", F.array().cast("array<double>")), "gaps")
    for left in reversed(range(CLOSING)):
        rest = _choice(rows.join(checked(state), F.col("source").eqNullSafe(F.col("of"))), epochs).where(F.col("rank").isNotNull() & ~_sampled() & ~F.array_contains("closed", F.col("rank")))
        over = F.abs(F.col("size") - F.col("gap"))
        fitting = rest.where(F.col("size") <= F.col("gap") if left else over < F.col("gap"))
        best = fitting.groupBy("src").agg(F.min(F.struct(over.alias("over"), "rank", "size")).alias("b"))
        found = F.col("b").isNotNull()
        closed = F.when(found, F.concat("closed", F.array("b.rank"))).otherwise(F.col("closed"))
        state = stage(state.join(best, "src", "left").withColumns({"closed": closed, "gap": F.col("gap") - F.when(found, F.col("b.size")).otherwise(0)}).drop("b"), "sources")
    return rows, state, repeated


def _sampled() -> Column:
    """Whether a row is ranked before the cut."""
    return (F.col("rank") < F.col("below")) | (F.col("rank") <= F.col("upto"))


def _copies(rows: DataFrame, sources: DataFrame, source_col: str, epochs: float) -> DataFrame:
    chosen = _choice(rows.join(checked(sources), F.col(source_col).eqNullSafe(F.col("of"))), epochs)
    takes = _sampled() | F.coalesce(F.array_contains("closed", F.col("rank")), F.lit(False))
    return chosen.withColumn("copies", F.col("certain") + F.coalesce(takes.cast("long"), F.lit(0)))


def mix(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row; options as for plan().

    A null text, or one without words, has size 0 and is not taken; null is a source like others, after
    them. The numbers depend on id, text, source and seed, and of rows that are equal in these, on a number
    among them: each is taken or not by itself, so that large groups of them meet their target too, and
    reruns take as many of them. An empty table gives an empty one.
    """
    rows, sources, _ = plan(docs, **options)
    out = _copies(rows, sources, "source", options.get("epochs", EPOCHS))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def repeat(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """docs with each row as often as the mix takes it, all columns as they are; the texts are not shuffled."""
    _, sources, repeated = plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    own_size, own = _rows(docs, id_col, text_col, source_col, options.get("size"), options.get("seed", SEED))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source_col).alias("of_row"), own_size.alias("size"), own.alias("own"))
    chosen = _copies(_drawn(packed, repeated), sources, "of_row", options.get("epochs", EPOCHS)).where("copies > 0")
    return chosen.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("nth")).select("row.*")

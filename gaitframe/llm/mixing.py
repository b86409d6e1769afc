"""Mix sources to target weights by repetition rates.

Words per source give each source's rate = target / size. A document is taken
floor(rate) times, and once more if a number in [0, 1) that a hash of its id and the
seed gives is below the rate's fraction. Targets share the total by weight, stop at
``most`` times a source's size, and what is left over goes to the others by weight:
so a target is min(cap, level * weight) at one common level, found by running sums over
sources in the order of cap / weight.

Null text has size 0. Null source is a source, and comes last. Rows of one id draw the
same number; rows without an id draw by their text. Extra columns stay out of ``rates``
and come back from ``emit`` as they are, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaitframe.llm.shared import WORD, fresh, settle

WEIGHTS = (5, 2, 1)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """source, source_size, target from one row a source (source, source_size).

    The windows here run over sources, not over documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth + 1).cast("int"))
    s = sources.withColumn("w", weight).withColumn("cap", (most * F.col("source_size")).cast("double"))
    rising = Window.orderBy((F.col("cap") / F.col("w")), F.col("source").asc_nulls_last())
    earlier = rising.rowsBetween(Window.unboundedPreceding, -1)
    rest = rising.rowsBetween(0, Window.unboundedFollowing)
    everything = rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / F.sum("w").over(rest)
    s = s.withColumn("level", level)
    # the first source whose cap is not reached sets the level for it and all that follow
    free = F.min(F.when(F.col("cap") >= F.col("level") * F.col("w"), F.struct(F.col("cap") / F.col("w"), "level"))).over(everything)
    target = F.least("cap", F.coalesce(free["level"], F.lit(0.0)) * F.col("w"))
    return s.select("source", "source_size", target.alias("target"))


def _size():
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def _drawn(seed: str):
    """A number in [0, 1) from the seed and the id, or the text where there is no id."""
    of = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), of)), 1, 13), 16, 10).cast("double") / float(16**13)


def _copies(rate, drawn):
    return F.floor(rate) + F.when(drawn < rate - F.floor(rate), 1).otherwise(0)


def rates(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target and copies of every document."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _size().alias("size"), _drawn(seed).alias("drawn"))
    sized = settle(sized, "sizes")
    by_source = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    # no hint: Spark broadcasts the sources if they are few, else it splits the skewed ones
    out = sized.join(by_source.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    return out.withColumn("copies", _copies(rate, F.col("drawn")).cast("long"))


def emit(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: str = "mix") -> DataFrame:
    """The mix itself: every document as often as it is taken, with its columns as they are."""
    of, rate, copy = fresh(docs, "of_source", "rate", "copy")
    sized = docs.select(F.col("source").cast("string").alias("source"), _size().alias("size"))
    by_source = settle(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets")
    t = by_source.select(F.col("source").alias(of), F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)).alias(rate))
    joined = docs.join(t, F.col("source").cast("string").eqNullSafe(F.col(of)))
    times = F.array_repeat(F.lit(1), _copies(F.col(rate), _drawn(seed)).cast("int"))
    return joined.withColumn(copy, F.explode(times)).drop(of, rate, copy)

"""Mixing sources to target weights.

Every document gets a hash-random key.  Within its source the documents are sorted by the key in ranges of
equal width; prefix sums of word counts are taken over the ranges and inside each range, and the source's
exact budget cuts that order.  A budget above the source's size repeats whole epochs first.

There are about sqrt(rows) ranges, so neither a range nor the list of ranges of one source is large, and a
source that holds most rows is many ranges.  The global window is over one row per source.

Null and empty texts have size 0 and nothing is taken; a null source is a source of its own, last in order.
Keys are hashes of id and text, so rows of one id or without one are spread too; equal
rows are interchangeable.  An empty table gives an empty result.  Extra columns pass through ``mix`` and ``draw``, whatever their
names, but for those that ``mix`` itself gives.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseaudit.llm.common import WORD_SPLIT, quoted

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3


def n_words(text: Column) -> Column:
    """Number of words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Per source (source, source_size) its target: shares by weight, stopped at ``most`` times the size.

    Filling stops at a common level: sources whose cap per weight is below the level get the cap, the others
    weight times level.  Sorted by cap per weight, the level is found from running sums over sources.
    """
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    x = (
        sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(rest))
        # The first source whose cap is not below the level of all from it on sets the level.
        .withColumn("found", F.min(F.when(F.col("cap") >= F.col("level") * F.col("w"), F.struct(F.col("cap") / F.col("w"), "level"))).over(everything))
    )
    return x.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("w") * F.coalesce(F.col("found.level"), F.lit(float("inf")))).alias("target"))


def mixed(docs: DataFrame, columns: list[str], weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: int = 7, source: str = "source") -> DataFrame:
    """_row (a struct of ``columns``), size, source_size, target and taken, one row for each row of ``docs``.

    ``taken`` is full epochs times the size, plus the part of the document before the cut of the last epoch;
    per source the sum is the rounded target.  The result depends on the rows only, not on partitions.
    """
    buckets = max(1, math.isqrt(docs.count()))
    tie = F.xxhash64(F.col("text"))
    x = docs.select(F.struct(*map(quoted, columns)).alias("_row"), n_words(F.col("text")).alias("size"), "doc_id", F.col(source).alias("source"), F.xxhash64(F.col("doc_id"), tie, F.lit(seed)).alias("_key"), tie.alias("_tie"))
    x = x.withColumn("_src", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")))  # a key that null has too
    # The upper 31 bits of the key choose the range, so ranges follow the order of keys.
    x = x.withColumn("_range", F.floor((F.shiftright("_key", 33) + F.lit(1 << 30)) * F.lit(buckets) / F.lit(float(1 << 31))).cast("long"))
    parts = x.groupBy("_src", "source", "_range").agg(F.sum("size").alias("range_size"))
    sizes = parts.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    goal = targets(sizes, weights, most).withColumn("_src", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")))
    goal = goal.select("_src", "source_size", "target")
    upto = Window.partitionBy("_src").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = parts.withColumn("_start", F.coalesce(F.sum("range_size").over(upto), F.lit(0))).join(goal, "_src").select("_src", "_range", "_start", "source_size", "target")
    inside = Window.partitionBy("_src", "_range").orderBy("_key", "doc_id", "_tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_within", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(ranges, ["_src", "_range"])
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(0)
    x = x.withColumn("_epochs", epochs)
    left = budget - F.col("_epochs") * F.col("source_size") - F.col("_start") - F.col("_within")
    taken = F.col("_epochs") * F.col("size") + F.greatest(F.lit(0), F.least(left, F.col("size")))
    return x.select("_row", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix(docs: DataFrame, columns: list[str] | None = None, **options) -> DataFrame:
    """``docs`` (doc_id, text, source, others; or only ``columns`` of it, which are all that is shuffled) with size, source_size, target
    and taken, in place of columns of these names."""
    names = [c for c in columns or docs.columns if c not in ("size", "source_size", "target", "taken")]
    return mixed(docs, names, **options).select(*[F.col(quoted("_row", c)).alias(c) for c in names], "size", "source_size", "target", "taken")


def draw(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows of the input's columns: each document once for each epoch that takes it.  Where the cut falls
    inside a document, its last copy keeps the words before the cut, joined by single spaces."""
    text = F.col("_row")["text"]
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    part = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0).cast("int")
    clean = F.regexp_replace(text, f"^{WORD_SPLIT}", "")
    cut_text = F.array_join(F.slice(F.split(clean, WORD_SPLIT), 1, part), " ")
    texts = F.concat(F.array_repeat(text, whole), F.when(part > 0, F.array(cut_text)).otherwise(F.array().cast("array<string>")))
    x = mixed(docs, docs.columns, **options).select("_row", F.explode(texts).alias("_text"))
    return x.select(*((F.col("_text") if c == "text" else F.length("_text").cast("long") if c == "n_chars" else F.col(quoted("_row", c))).alias(c) for c in docs.columns))

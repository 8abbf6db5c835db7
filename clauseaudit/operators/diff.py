"""Differences of two drafts: clauses and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _last(x: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    return x.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("v"))


def clause_diff(a: DataFrame, b: DataFrame, key: list[str], order: str = "ordinal") -> DataFrame:
    """key, change (added, removed, modified, unchanged), old_text, new_text; of equal ids the last counts."""
    x = _last(a, key, order, ["text"]).withColumnRenamed("v", "old").join(_last(b, key, order, ["text"]).withColumnRenamed("v", "new"), key, "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.trim("old.text") != F.trim("new.text"), "modified").otherwise("unchanged")
    return x.select(*key, change.alias("change"), F.col("old.text").alias("old_text"), F.col("new.text").alias("new_text"))


def finding_diff(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Findings by key and span (absent: 0, 0) with change: added, resolved or retained; of equal keys the last counts."""
    span = ["_start", "_end"]
    prep = lambda d, n: _last(d.withColumns({"_start": F.coalesce("span_start", F.lit(0)), "_end": F.coalesce("span_end", F.lit(0))}), [*key, *span], "finding_no", ["finding_no", "severity"]).withColumnRenamed("v", n)
    x = prep(a, "va").join(prep(b, "vb"), [*key, *span], "full_outer")
    change = F.when(F.col("va").isNull(), "added").when(F.col("vb").isNull(), "resolved").otherwise("retained")
    keep = F.coalesce("vb", "va")
    return x.select(*key, F.col("_start").alias("span_start"), F.col("_end").alias("span_end"), change.alias("change"), keep["finding_no"].alias("finding_no"), keep["severity"].alias("severity"))


def diff_summary(clauses: DataFrame, findings: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Counts of changes, and of the raw findings of both drafts."""
    count = lambda d, *names: d.agg(*[F.count_if(F.col("change") == n).alias(f"{n}_{what}") for what, n in names])
    c = count(clauses, *[("clauses", n) for n in ("added", "removed", "modified", "unchanged")])
    f = count(findings, *[("findings", n) for n in ("added", "resolved", "retained")])
    return c.crossJoin(f).crossJoin(a.agg(F.count("*").alias("total_a"))).crossJoin(b.agg(F.count("*").alias("total_b")))

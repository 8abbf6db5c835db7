"""Rules as data: versions of rules, valid from a day to a day, decide which findings there are and how they read.

A catalogue has the columns rule_id, enabled, severity, message_en, message_hi, rule_set_version, valid_from (null: always) and valid_to (the first day
on which the version holds no more; null: open).  A version ends where the next one of its rule begins, and an older one does not come
back after it.  Of versions with one valid_from the greatest rule_set_version counts.  A rule that has no version on a document's audit date, or a
disabled one, gives no findings there.  Where the data of a finding are in conflict it stays CANNOT_VERIFY whatever the catalogue says.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseaudit.functions.text import finding_id

_ALWAYS = "DATE '0001-01-01'"


def versions(catalogue: DataFrame) -> DataFrame:
    """The catalogue with disjoint times (valid_from, valid_until) of each rule's versions."""
    x = catalogue.withColumn("valid_from", F.coalesce("valid_from", F.expr(_ALWAYS)))
    same = Window.partitionBy("rule_id", "valid_from").orderBy(F.desc("rule_set_version"), F.desc("severity"), F.desc("message_en"))
    x = x.withColumn("_n", F.row_number().over(same)).where("_n = 1")
    following = F.lead("valid_from").over(Window.partitionBy("rule_id").orderBy("valid_from"))
    return x.withColumn("valid_until", F.least("valid_to", following)).drop("_n", "valid_to")


def fill(template: Column, params: Column) -> Column:
    """A template with its placeholders filled from a map; with a placeholder that the map lacks it stays raw, as in ``render``."""
    names = F.regexp_extract_all(template, F.lit("\\{(\\w+)\\}"), F.lit(1))
    gaps = F.split(template, "\\{\\w+\\}", -1)
    filled = F.zip_with(gaps, names, lambda g, n: F.concat(g, F.coalesce(F.try_element_at(params, n), F.lit(""))))
    return F.when(F.forall(names, lambda n: F.array_contains(F.map_keys(params), n)), F.array_join(filled, "")).otherwise(template)


def apply_catalogue(findings: DataFrame, catalogue: DataFrame, as_of: datetime.date, audit_dates: DataFrame | None = None) -> DataFrame:
    """``findings`` (with ``_params`` and ``_conflict``) under the versions that hold on their documents' audit dates: an as-of join on the
    rule, of which one version at most matches.  Documents without a date are of ``as_of``; of several dates the first counts."""
    x = findings.withColumn("_on", F.lit(as_of))
    if audit_dates is not None:
        dates = audit_dates.groupBy("doc_id").agg(F.min("audit_date").alias("_date"))
        x = x.join(dates, "doc_id", "left").withColumn("_on", F.coalesce("_date", "_on")).drop("_date")
    v = versions(catalogue).where("enabled").select("rule_id", F.struct("severity", "message_en", "message_hi", "rule_set_version", "valid_from", "valid_until").alias("_v"))
    x = x.join(v, "rule_id").where("_v.valid_from <= _on and (_v.valid_until is null or _on < _v.valid_until)")
    new = {
        "severity": F.when(F.col("_conflict"), "CANNOT_VERIFY").otherwise(F.col("_v.severity")), "message_en": fill(F.col("_v.message_en"), F.col("_params")),
        "message_hi": fill(F.col("_v.message_hi"), F.col("_params")), "rule_set_version": F.col("_v.rule_set_version"),
    }
    x = x.withColumns(new).withColumn("finding_id", finding_id(F.col("rule_id"), F.col("doc_id"), F.col("clause_id"), F.col("span_start"), F.col("message_en"), F.col("evidence.row_id")))
    return x.select(*[c for c in findings.columns if c not in ("_params", "_conflict")])

"""Evaluation of fired rules against expected ones, scorecards and percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fired_rules(findings: DataFrame, case: str = "case_id") -> DataFrame:
    """Sorted distinct rules of each case, without R14."""
    return findings.where("rule_id <> 'R14'").groupBy(case).agg(F.array_sort(F.collect_set("rule_id")).alias("got"))


def case_results(cases: DataFrame, fired: DataFrame) -> DataFrame:
    """(case_id, kind, language, expected, got, passed); ``expected_rules`` is joined by semicolons."""
    expected = F.array_sort(F.filter(F.split(F.coalesce("expected_rules", F.lit("")), ";"), lambda r: F.trim(r) != ""))
    x = cases.withColumn("expected", expected).join(fired, "case_id", "left").withColumn("got", F.coalesce("got", F.array().cast("array<string>")))
    return x.select("case_id", "kind", "language", "expected", "got", (F.col("expected") == F.col("got")).alias("passed"))


def metrics(results: DataFrame) -> DataFrame:
    """One row: recall of planted defects, false alarms, abstentions, adversarial cases, and the gate over them."""
    kind = F.col("kind")
    defect = ~kind.isin("clean", "abstain", "adversarial")
    hit = F.size(F.array_intersect("expected", "got"))
    x = results.agg(
        F.coalesce(F.sum(F.when(defect, F.size("expected"))), F.lit(0)).alias("planted"), F.coalesce(F.sum(F.when(defect, hit)), F.lit(0)).alias("caught"),
        F.count_if((kind == "clean") & (F.size("got") > 0)).alias("false_alarms"), F.count_if(kind == "clean").alias("clean"),
        F.count_if((kind == "abstain") & F.array_contains("got", "R10") & F.col("passed")).alias("abstained"), F.count_if(kind == "abstain").alias("abstain"),
        F.count_if((kind == "adversarial") & F.col("passed")).alias("adversarial_passed"), F.count_if(kind == "adversarial").alias("adversarial"),
    )
    return x.withColumn("gate", (F.col("planted") == F.col("caught")) & (F.col("false_alarms") == 0) & (F.col("abstained") == F.col("abstain")))


def language_breakdown(results: DataFrame) -> DataFrame:
    return results.groupBy("language").agg(F.count_if("passed").alias("passed"), F.count("*").alias("total"))


def language_quality_gate(results: DataFrame, threshold: float = 0.90) -> DataFrame:
    """Exact-match rate of each language and whether it is supported."""
    from clauseaudit.functions.text import count_line

    x = language_breakdown(results).withColumn("rate", F.col("passed") / F.col("total"))
    return x.withColumn("status", F.when(F.col("rate") >= threshold, "SUPPORTED").otherwise("NOT_SUPPORTED")).withColumn("summary", count_line(F.col("passed"), F.col("total")))


def evidence_completeness(findings: DataFrame) -> DataFrame:
    """Of findings of the rules that need evidence, how many have a link, date, instrument or candidate."""
    needs = F.col("rule_id").isin("R02", "R03", "R04", "R05", "R06", "R07", "R08", "R13")
    has = F.coalesce("evidence.url", "evidence.verified_on", "evidence.instrument", "evidence.candidate").isNotNull()
    return findings.where(needs).agg(F.count_if(has).alias("complete"), F.count("*").alias("total"))


RANGES = 64


def in_ranges(x: DataFrame, keys: list[str], value: str) -> DataFrame:
    """_k (a struct of the keys), _v, _c (how often the value occurs) and _b: the range of the key's values that it falls into.

    A key's ranges are cut at its own approximate quantiles, a sketch of bounded size, so that a key with all rows is many ranges of about equal
    size.  Equal values are one row."""
    counts = x.where(F.col(value).isNotNull()).groupBy(F.struct(*keys).alias("_k"), F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    cuts = counts.groupBy("_k").agg(F.percentile_approx("_v", [i / RANGES for i in range(1, RANGES)], 1000).alias("_cuts"))
    return counts.join(cuts, "_k").select("_k", "_v", "_c", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_b"))


def latency_percentiles(x: DataFrame, keys: list[str], value: str, points: tuple[float, ...] = (0.50, 0.95, 0.99)) -> DataFrame:
    """Values of rank floor(n p) + 1 (at most n), with least, mean, greatest and count of each key; null values do not count, null keys are a key.

    Exact ranks: prefix sums over the ranges of a key (at most ``RANGES`` rows) tell in which range a rank lies and how far; only the rows of those ranges are
    put in order, each range by itself."""
    v = in_ranges(x, keys, value)
    w = Window.partitionBy("_k")
    parts = v.groupBy("_k", "_b").agg(F.sum("_c").alias("_m")).withColumn("_n", F.sum("_m").over(w)).withColumn("_before", F.sum("_m").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_m"))
    ranks = F.array(*[F.struct(F.lit(i).alias("p"), F.least(F.col("_n"), F.floor(F.col("_n") * p) + 1).alias("rank")) for i, p in enumerate(points)])
    wanted = parts.withColumn("_r", F.explode(ranks)).where("_before < _r.rank and _r.rank <= _before + _m").select("_k", "_b", F.col("_r.p").alias("_p"), (F.col("_r.rank") - F.col("_before")).alias("_rest"))
    upto = F.sum("_c").over(Window.partitionBy("_k", "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    inside = v.join(wanted.select("_k", "_b").distinct(), ["_k", "_b"], "left_semi").withColumn("_upto", upto)
    found = inside.join(wanted, ["_k", "_b"]).where("_upto >= _rest").groupBy("_k").agg(*[F.min(F.when(F.col("_p") == i, F.col("_v"))).alias(f"p{round(p * 100)}") for i, p in enumerate(points)])
    whole = v.groupBy("_k").agg(F.min("_v").alias("least"), (F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")).alias("mean"), F.max("_v").alias("greatest"), F.sum("_c").alias("n"))
    return found.join(whole, "_k").select("_k.*", *[f"p{round(p * 100)}" for p in points], "least", "mean", "greatest", "n")


def extractor_scorecard(runs: DataFrame) -> DataFrame:
    """(candidate, clause_id, run, language, valid, invented, matched, expected, produced, output, ms) -> scores of each candidate."""
    per_clause = runs.groupBy("candidate", "clause_id").agg(F.count_distinct("output").alias("d")).groupBy("candidate").agg(F.round(F.avg((F.col("d") == 1).cast("double")), 4).alias("repeatability"))
    hindi = F.col("language").isin("hi", "mixed")
    rate = lambda a, b: F.round(F.coalesce(F.sum(a) / F.nullif(F.sum(b), F.lit(0)), F.lit(0.0)), 4)
    x = runs.groupBy("candidate").agg(
        F.round(F.avg(F.col("valid").cast("double")), 4).alias("valid_schema_rate"), F.sum("invented").alias("invented"), rate("matched", "expected").alias("recall"), rate("matched", "produced").alias("precision"),
        F.round(F.coalesce(F.avg(F.when(hindi, (F.col("produced") == F.col("expected")).cast("double"))), F.lit(0.0)), 4).alias("hindi_accuracy"),
    )
    return x.join(per_clause, "candidate").join(latency_percentiles(runs, ["candidate"], "ms", (0.50, 0.95)).select("candidate", "p50", "p95"), "candidate").withColumn("rejected", F.col("invented") > 0)


def rank_extractors(scores: DataFrame) -> DataFrame:
    """Candidates that invent nothing, best first: 1 primary, 2 fallback.  A scorecard has few candidates."""
    w = Window.orderBy(F.desc("recall"), F.desc("hindi_accuracy"), F.desc("repeatability"), "p50", "candidate")
    return scores.where("not rejected").withColumn("place", F.row_number().over(w)).withColumn("role", F.when(F.col("place") == 1, "primary").when(F.col("place") == 2, "fallback"))


def severity_counts(findings: DataFrame, keys: list[str]) -> DataFrame:
    return findings.groupBy(*keys).agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("ERROR", "WARNING", "INFO", "CANNOT_VERIFY")])


def audit_summary(clauses: DataFrame, findings: DataFrame) -> DataFrame:
    f = findings.groupBy("doc_id").agg(F.count("*").alias("total_findings"))
    return clauses.groupBy("doc_id").agg(F.count("*").alias("total_clauses")).join(f, "doc_id", "left").withColumn("total_findings", F.coalesce("total_findings", F.lit(0)))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, x in tables.items():
        y = x.agg(F.count("*").alias("n")).withColumn("table_name", F.lit(name))
        out = y if out is None else out.unionByName(y)
    return out


def mapping_eval(cases: DataFrame, mapped: DataFrame) -> DataFrame:
    """(mention, expected_unmapped) against the results of ``mapping.map_product``: each case PASS or FAIL."""
    x = cases.join(mapped.select("mention", "is_unmapped", "canonical_name", "confidence"), "mention", "left")
    return x.withColumn("status", F.when(F.col("is_unmapped").eqNullSafe(F.col("expected_unmapped")), "PASS").otherwise("FAIL"))


def mapping_summary(results: DataFrame) -> DataFrame:
    """One row over ``mapping_eval``: cases, passed ones, those expected to be unmapped and how many are, and the gate."""
    out = F.count_if("expected_unmapped")
    right = F.count_if(F.col("expected_unmapped") & F.col("is_unmapped"))
    return results.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "PASS").alias("passed"), out.alias("total_unmapped"), right.alias("unmapped_correct"), (out == right).alias("gate"))


def failed_cases(results: DataFrame) -> DataFrame:
    """What the gates report of each failed case: its language, and the rules that are missing and those that are too many."""
    x = results.where("not passed")
    return x.select("case_id", "kind", "language", F.array_except("expected", "got").alias("missing"), F.array_except("got", "expected").alias("unexpected"))

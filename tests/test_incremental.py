"""Audits brought up to date against audits made anew."""

import dataclasses
import tempfile

import pytest
from pyspark.sql import functions as F
from test_rules import CASES, reference

from clauseaudit.operators import incremental
from clauseaudit.operators.extract import extract_citations


def extract(c):
    mentions = c.where("m is not null").select("doc_id", "clause_id", F.lit(0).alias("pos"), F.col("m").alias("text"), F.lit(0).alias("span_start"), F.lit(1).alias("span_end"), F.lit(None).cast("string").alias("canonical_product_id"))
    return extract_citations(c.select("doc_id", "clause_id", "ordinal", "text")), mentions


def frame(spark, cases):
    rows = [(d, f"{d}_{i}", i, text, m) for d, (clauses, _) in cases.items() for i, (text, m) in enumerate(clauses)]
    return spark.createDataFrame(rows, "doc_id string, clause_id string, ordinal int, text string, m string")


def rows(x):
    return sorted(map(str, x.collect()))


EDITS = {
    "T01": [("Fifty laptops are wanted.", "laptops")],  # the citation goes
    "T09": [("IT equipment is built to IS 13252 (Part 1): 2010.", "IT equipment")],  # so does the clause that contradicts
    "allied cited elsewhere": [("Units to IS 555 Part 1: 2015.", None), ("Also nothing.", None)],  # the other clause now lacks its ally
    "T07": None,  # the document goes
    "T13": [*CASES["T13"][0], ("As per BIS, to IS 999.", None)],  # a clause more
}
def catalogue(r):
    standards = r.standards.where("id <> 3").withColumn("status", F.when(F.col("id") == 2, "Withdrawn").otherwise(F.col("status"))).withColumn("is_number", F.when(F.col("id") == 9, "IS 99998").otherwise(F.col("is_number")))
    products = r.products.withColumn("family", F.when(F.col("id") == 4, "Other").otherwise(F.col("family"))).withColumn("synonyms_en", F.when(F.col("id") == 3, '["rooftop wind turbines"]').otherwise(F.col("synonyms_en")))
    return dataclasses.replace(r, standards=standards, products=products)


CHANGES = {
    "catalogue and edits": catalogue,
    "the rest": lambda r: dataclasses.replace(r, maps=r.maps.where("id not in (3, 4)"), certification_rules=r.certification_rules.where("id <> 1"), links=r.links.withColumn("target_standard_id", F.lit(7)), vague_terms=r.vague_terms.where("id = 2")),
}


@pytest.mark.parametrize("change", CHANGES)
def test_update_equals_a_new_audit(spark, change):
    old = reference(spark)
    new = CHANGES[change](old)
    cases = CASES if change == "the rest" else {d: (EDITS.get(d, c), x) for d, (c, x) in CASES.items() if EDITS.get(d, c) is not None}
    before, after = frame(spark, CASES), frame(spark, cases)
    folder = tempfile.mkdtemp(prefix="spark-")
    state = incremental.audit(before, old, extract, f"{folder}/a")
    got = incremental.update(state, after, old, new, extract, f"{folder}/b")
    want = incremental.audit(after, new, extract, f"{folder}/c")
    for table in ("findings", "index", "citations", "mentions"):
        assert rows(getattr(got, table)) == rows(getattr(want, table).select(getattr(got, table).columns)), table
    assert rows(got.findings) != rows(state.findings)
    extracted, evaluated = spark.read.parquet(f"{folder}/b/new_citations"), spark.read.parquet(f"{folder}/b/again")
    assert extracted.count() == (0 if change == "the rest" else 1)  # of edited clauses alone
    assert {r.doc_id for r in evaluated.collect()} >= (set() if change == "the rest" else set(EDITS)) and evaluated.count() < before.count()
    spark.catalog.clearCache()


def test_texts_of_r07_are_not_stored(spark):
    """A new map of a product changes the findings of R07 without a clause that is evaluated again."""
    old = reference(spark)
    row = old.maps.where("product_id is not null").orderBy("id").limit(1).withColumn("id", F.lit(900).cast(old.maps.schema["id"].dataType)).withColumn("standard_id", F.lit(999).cast(old.maps.schema["standard_id"].dataType))
    new, before, folder = dataclasses.replace(old, maps=old.maps.unionByName(row)), frame(spark, CASES), tempfile.mkdtemp(prefix="spark-")
    state = incremental.audit(before, old, extract, f"{folder}/a")
    got = incremental.update(state, before, old, new, extract, f"{folder}/b")
    assert rows(got.findings) == rows(incremental.audit(before, new, extract, f"{folder}/c").findings.select(got.findings.columns))
    assert spark.read.parquet(f"{folder}/b/again").count() == 0
    assert spark.read.parquet(f"{folder}/a/findings").where("rule_id = 'R07'").count() == 0 < state.findings.where("rule_id = 'R07'").count()
    spark.catalog.clearCache()

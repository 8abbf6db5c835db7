"""Worked cases: clause texts, product mentions and the rules that must fire, with extraction by our own pattern."""

import datetime

import pytest
from pyspark.sql import functions as F

from clauseaudit.operators import rules
from clauseaudit.operators.extract import extract_citations
from clauseaudit.sources.reference import CERTIFICATION, LINK, MAP, PRODUCT, STANDARD, VAGUE, ReferenceData

D = datetime.date(2026, 10, 2)
# Reference rows of the worked cases.
STANDARDS = [
    (1, "IS/IEC 62368 Part 1", "1", 2023, "Active"), (2, "IS 302-2-25", None, None, "Active"), (3, "IS 13252 (Part 1)", "1", 2010, "Active"), (4, "IS 999", None, 1995, "Withdrawn"),
    (5, "IS 555", "1", 2015, "Active"), (6, "IS 555-1", None, 2015, "Active"), (7, "IS 269", None, 2015, "Active"), (8, "IS 4031 (Part 1)", "1", 1996, "Active"), (9, "IS 777", None, 2000, "CONFLICT"),
]
PRODUCTS = [
    (1, "Laptop / notebook / tablet", "IT equipment", '["laptop","laptops","notebook","tablet","tablets"]', '["लैपटॉप"]'), (2, "Power adaptors for IT equipment", "IT equipment", '["power adaptor","power adaptors","adaptor"]', "[]"),
    (3, "Microwave ovens", "Household appliances", '["microwave oven","microwave ovens","microwave"]', "[]"), (4, "IT equipment (general)", "IT equipment", '["it equipment"]', "[]"), (5, "Ordinary Portland Cement (OPC)", "Cement and concrete", '["cement","opc"]', "[]"),
]
CASES = {
    "T01": ([("Fifty laptops are wanted, built to IS 13252 (Part 1): 2010.", "laptops")], {"R05", "R06"}),
    "T02": ([("Laptops must meet IS/IEC 62368 Part 1: 2023 in full.", "laptops")], {"R06"}),
    "T03": ([("Laptops to IS/IEC 62368 Part 1: 2019, listed under the Compulsory Registration Scheme.", "laptops")], {"R03"}),
    "T04": ([("Each of the microwave ovens follows IS 302-2-25.", "microwave ovens")], {"R06"}),
    "T05": ([("Ten microwave ovens, each with a mark of the Compulsory Registration Scheme.", "microwave ovens")], {"R07"}),
    "T06": ([("Bidders offer IT equipment of ISI quality only.", "IT equipment")], {"R07", "R09"}),
    "T07": ([("We ask for rooftop wind turbines of two kilowatts.", "rooftop wind turbines")], {"R10"}),
    "T08": ([("IT equipment made to IS 99999: 2015 is accepted.", "IT equipment")], {"R01"}),
    "T09": ([("IT equipment is built to IS 13252 (Part 1): 2010.", "IT equipment"), ("Inspection uses IS 13252 (Part 1): 2008.", "inspection")], {"R03", "R11"}),
    "T10": ([("IT equipment is built to IS 13253 (Part 1): 2010.", "IT equipment")], {"R12"}),
    "T11": ([("Microwave ovens to IS 13252 (Part 1): 2010, listed under the Compulsory Registration Scheme.", "microwave ovens")], {"R05", "R13"}),
    "T12": ([("हर लैपटॉप IS 13252 (भाग 1): 2010 का पालन करे और CRS में दर्ज हो।", "लैपटॉप")], {"R05"}),
    "T13": ([("Laptops to IS/IEC 62368 Part 1: 2023, listed under the Compulsory Registration Scheme.", "laptops")], set()),
    "two in one": ([("Laptops to IS/IEC 62368 Part 1: 2019 or IS 13252 (Part 1): 2008, under the Compulsory Registration Scheme.", "laptops")], {"R03", "R05"}),
    "withdrawn": ([("Pipes to IS 999: 1995.", None)], {"R02"}),
    "allied": ([("Units to IS 555 Part 1: 2015.", None)], {"R08"}),
    "allied cited elsewhere": ([("Units to IS 555 Part 1: 2015.", None), ("Also IS 555-1: 2015.", None)], set()),
    "no part": ([("Units to IS 13252: 2010.", None)], {"R04"}),
    "conflict": ([("Units to IS 777: 2001.", None)], {"R03"}),
    "empty": ([("", None)], set()),
}


def reference(spark, as_of=datetime.date(2026, 10, 4)):
    f = spark.createDataFrame
    return ReferenceData(
        f([(i, n, p, y, s, f"https://c/{i}", D, False) for i, n, p, y, s in STANDARDS], STANDARD), f(PRODUCTS, PRODUCT),
        f([(1, 1, 1, "https://m", D, False), (2, 2, 1, "https://m", D, False), (3, 3, 2, "https://m", D, False), (4, 4, 3, "https://m", D, False), (5, 5, 7, "https://m", D, False)], MAP),
        f([(1, 1, 1, "CRS", "Order A", "https://r", D, False), (2, 3, 2, "CRS", "Order B", "https://r", D, False), (3, 5, 7, "QCO", "Order C", "https://r", D, False)], CERTIFICATION),
        f([(1, 5, 6, "https://l", D, False)], LINK), f([(1, "ISI quality", "en", "Names no number."), (2, "as per BIS", "en", "Names the bureau.")], VAGUE), as_of=as_of,
    )


def facts(spark, cases, as_of=datetime.date(2026, 10, 4), document_scope=True):
    rows = [(d, f"{d}_{i}", i, text, m) for d, (clauses, _) in cases.items() for i, (text, m) in enumerate(clauses)]
    c = spark.createDataFrame(rows, "doc_id string, clause_id string, ordinal int, text string, m string")
    mentions = c.where("m is not null").select("doc_id", "clause_id", F.lit(0).alias("pos"), F.col("m").alias("text"), F.lit(0).alias("span_start"), F.lit(1).alias("span_end"), F.lit(None).cast("string").alias("canonical_product_id"))
    return rules.build_facts(c.drop("m"), extract_citations(c.drop("m")), mentions, reference(spark, as_of), document_scope=document_scope)


@pytest.fixture(scope="module")
def found(spark):
    return rules.evaluate_documents(facts(spark, CASES)).collect()


def test_worked_cases(found):
    for case, (_, expected) in CASES.items():
        assert {r.rule_id for r in found if r.doc_id == case and r.rule_id != "R14"} == expected, case


def test_severity_of_conflicts_and_evidence(found):
    by = {(r.doc_id, r.rule_id): r for r in found}
    assert by["conflict", "R03"].severity == "CANNOT_VERIFY"
    assert by["T03", "R03"].message_en == "The clause cites 2019. The catalogue shows 2023 (verified 2026-10-02)."
    assert by["T10", "R12"].evidence.candidate == "IS 13252 (Part 1)"
    assert by["T11", "R13"].evidence.other_product == "IT equipment (general)"
    assert by["T09", "R11"].evidence.locations == ["T09_0", "T09_1"]
    assert by["T05", "R07"].message_en == "No standard is cited for this product. The dataset lists IS 302-2-25 (verified 2026-10-02)."


def test_stale_rows_once_per_clause(spark):
    x = rules.r14_stale_row(facts(spark, {"T01": CASES["T01"]}, datetime.date(2027, 10, 4))).collect()
    assert sorted(r.evidence.row_id for r in x) == [1, 3]  # the certification rule of R05 and R06, and the cited standard
    assert rules.r14_stale_row(facts(spark, {"T01": CASES["T01"]})).count() == 0


def test_clause_scope_does_not_see_other_clauses(spark):
    case = {"a": CASES["allied cited elsewhere"]}
    assert rules.r08_allied_absent(facts(spark, case)).count() == 0
    assert rules.r08_allied_absent(facts(spark, case, document_scope=False)).count() == 1


def test_empty_corpus(spark):
    assert rules.evaluate_documents(facts(spark, {"x": ([("", None)], set())})).count() == 0


def test_product_map_covers_all_parts(spark):
    """The derived map has every third part, whatever its key; counted without the view."""
    from clauseaudit.sources import bindings

    sf = "/root/testdata/sf0.01"
    want = {r.p_partkey for r in spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_name").collect() if r.p_partkey % 3 == 0 and r.p_name.split(" ")[1] in ("ring", "bolt", "gear", "gizmo", "plate", "rod", "widget")}
    assert max(want) > 600 and {r.standard_id for r in bindings.reference(spark, sf).maps.select("standard_id").collect()} == want


def test_rules_share_the_extracted_citations(spark):
    """Once the citations are kept, no frame that derives from them runs the pattern again: it occurs only below the kept relation."""
    from clauseaudit.sources.bindings import facts

    f = facts(spark, "/root/testdata/sf0.001")
    f.extracted.persist()
    try:
        def seen(x):
            plan = x._jdf.queryExecution().executedPlan().toString()
            return plan.count("regexp_extract_all"), plan.count("InMemoryRelation")

        once, relations = seen(f.extracted)
        assert once > 0 and relations == 1
        for x in (f.resolved, f.near, f.cited, f.citations, f.abstained):
            searches, kept = seen(x)
            assert kept > 0 and searches == once * kept
    finally:
        f.extracted.unpersist()


def test_stored_facts_are_read_by_column(spark):
    """What several rules read is in tables: no frame is kept with all its columns, and R14 joins nothing again that other rules have joined."""
    from clauseaudit.sources.bindings import facts

    f, plain = (facts(spark, "/root/testdata/sf0.001", "l_orderkey % 300", store=store) for store in (True, False))
    x = rules.evaluate_documents(f)
    plan = x.groupBy("rule_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" not in plan and plan.count("Exchange hashpartitioning(doc_id") < 20
    rows = lambda y: sorted(map(str, y.drop("evidence").collect()))
    assert rows(x) == rows(rules.evaluate_documents(plain))
    spark.catalog.clearCache()


def test_reports_shuffle_no_texts_of_r07(spark):
    """A report has the texts that its findings have, which its plan groups by key."""
    import json

    from clauseaudit.sources import io
    from clauseaudit.sources.bindings import facts

    f = facts(spark, "/root/testdata/sf0.001", store=True)
    findings, texts = rules.keyed_findings(f)
    assert findings.where("rule_id = 'R07' and message_en is not null").count() == 0
    whole = rules.evaluate_documents(f)
    keyed, plain = (dict(x.collect()) for x in (io.json_report(f.clauses, findings, texts=texts), io.json_report(f.clauses, whole)))
    assert keyed == plain and any(y["rule_id"] == "R07" and "lists IS" in y["message_en"] for r in keyed.values() for y in json.loads(r)["findings"])

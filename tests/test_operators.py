"""Segmentation, extraction, mapping, diffs, provenance, review and evaluation on small rows."""

import datetime
import json
import random
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clauseaudit.functions import text as T
from clauseaudit.operators import diff, evaluate, extract, mapping, provenance, review, rules, segment
from clauseaudit.sources.reference import PRODUCT


def cites(spark, *texts):
    c = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "clause_id int, text string")
    return extract.extract_citations(c).orderBy("clause_id", "cit_no").collect()


def test_citations(spark):
    # Citations and their parts.
    got = cites(spark, "conform to IS 13252 (Part 1): 2010.", "IS/IEC 62368 Part 1: 2023", "IS 302-2-25", "IS 13252-2010", "लैपटॉप IS १३२५२ (भाग १): २०१०", "this is 2010 units and ISO 9001", None, "")
    rows = [(r.clause_id, r.raw, r.is_number, r.part, r.year) for r in got]
    assert rows[0] == (0, "IS 13252 (Part 1): 2010", "IS 13252", "1", 2010)
    assert rows[1][2:] == ("IS/IEC 62368", "1", 2023)
    assert rows[2][2:] == ("IS 302-2-25", None, None)
    assert rows[3][2:] == ("IS 13252", None, 2010)
    assert rows[4][2:] == ("IS 13252", "1", 2010) and rows[4][1] == "IS १३२५२ (भाग १): २०१०"
    assert len(rows) == 5


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=["a", " ", "\n", "\t", "é", "😀", " ", "."], max_size=40), min_size=1, max_size=20))
def test_segments_hold_their_offsets(spark, texts):
    x = segment.segment_clauses(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    for i, t in enumerate(texts):
        own = sorted((r for r in x if r.doc_id == i), key=lambda r: r.paragraph_index)
        assert [r.text for r in own] == [p.strip() for p in re.split(r"\n\s*\n+", t) if p.strip()]
        assert all(t[r.start_char : r.end_char] == r.text for r in own)


def test_vague_regex_and_dictionary(spark):
    c = spark.createDataFrame([(1, "of isi  QUALITY and ISI quality as per BIS")], "clause_id int, text string")
    assert [(r.phrase, r.span_start) for r in extract.extract_vague(c).orderBy("span_start").collect()] == [("isi  QUALITY", 3), ("ISI quality", 20), ("as per BIS", 32)]
    v = spark.createDataFrame([(1, "isi quality", "x")], "id int, term string, explanation string")
    assert [(r.phrase, r.span_start) for r in extract.match_vague_terms(c, v).collect()] == [("ISI quality", 20)]


def test_functions(spark):
    x = spark.createDataFrame([("५० Laptops units of x", "Laptop")], "a string, b string")
    r = x.select(T.normalise_mention(F.col("a")).alias("m"), T.fold_digits(F.lit("１२ｶﾞ")).alias("f"), T.detect_language(F.lit("abc मानक")).alias("l"), T.base_number(F.lit("आईएस 12 (भाग 3)")).alias("n"), T.edit1(F.lit("ab"), F.lit("ba")).alias("e"), T.count_line(F.lit(1), F.lit(3)).alias("c"), T.count_line(F.lit(0), F.lit(0)).alias("z")).first()
    assert (r.m, r.l, r.n, r.e, r.c, r.z) == ("laptops", "mixed", "IS 12", False, "1 of 3 (33.3%)", "0 of 0 (no applicable test cases)")
    assert len(r.f) == 4 and r.f.startswith("12")
    assert x.select(T.render("a {x} b {y}", {"x": F.lit(1)}).alias("m")).first().m == "a {x} b {y}"


def test_mapping(spark):
    p = spark.createDataFrame([(1, "Laptop / notebook / tablet", "IT", '["laptop","laptops"]', '["लैपटॉप"]'), (2, "Power adaptors for IT equipment", "IT", '["power adaptor"]', "[]"), (3, "Microwave ovens", "H", '["microwave oven","microwave"]', "[]")], PRODUCT)
    m = spark.createDataFrame([("50 laptops",), ("laptop computers",), ("cement bags",), ("लैपटॉप",), ("microwave ovens",), (None,)], "mention string")
    got = {r.mention: r for r in mapping.map_product(m, p).collect()}
    assert (got["50 laptops"].confidence, got["50 laptops"].product_id) == (0.98, 1)
    assert (got["laptop computers"].confidence, got["laptop computers"].method) == (0.92, "SYNONYM")
    assert got["cement bags"].is_unmapped and got["लैपटॉप"].confidence == 0.98 and got["microwave ovens"].method == "EXACT" and got[None].is_unmapped
    o = spark.createDataFrame([("cement bags", "MICROWAVE OVENS", "o", 2), ("cement bags", "x", "o", 1)], "mention string, name string, officer string, ts int")
    r = mapping.override_mapping(mapping.map_product(m, p), o, p).where("mention = 'cement bags'").first()
    assert (r.canonical_name, r.confidence, r.method, r.is_unmapped) == ("Microwave ovens", 1.0, "OFFICER_OVERRIDE", False)


def test_near_standards(spark):
    s = spark.createDataFrame([(1, "IS 13252"), (2, "IS 302-2-25")], "id int, is_number string")
    c = spark.createDataFrame([("IS 13253",), ("IS 13252",), ("IS 1325",), ("IS 133252",), ("IS 31252",)], "is_number string")
    assert sorted(r.is_number for r in mapping.suggest_near(c, s).collect()) == ["IS 1325", "IS 13253", "IS 133252"]


def test_near_standards_are_not_broadcast(spark):
    s = spark.createDataFrame([(1, "IS 13252"), (2, "IS 302-2-25")], "id int, is_number string")
    plan = mapping.suggest_near(s.select("is_number"), s)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [v#" in plan and "BroadcastHashJoin [v#" not in plan


def test_spans(spark):
    c = "array<struct<raw:string,span_start:int,span_end:int,is_number:string,year:int>>"
    text = "Laptops to IS 13252: 2010."
    items = [("IS 13252: 2010", 11, 25, "IS 13252", 2010), ("IS 9", 0, 4, "IS 9", None), ("IS 13252: 2010", 11, 25, "IS 13252", 2011)]
    r = extract.validate_spans(spark.createDataFrame([(text, [("Laptops", 0, 7)], items)], f"text string, products array<struct<text:string,span_start:int,span_end:int>>, citations {c}")).first()
    assert (len(r.products), len(r.citations), r.dropped, r.invented) == (1, 1, 2, 2)


def test_diffs(spark):
    a = spark.createDataFrame([("c1", 1, "one"), ("c2", 2, "two")], "clause_id string, ordinal int, text string")
    b = spark.createDataFrame([("c1", 1, "one more"), ("c2", 2, " two "), ("c3", 3, "three")], a.schema)
    x = diff.clause_diff(a, b, ["clause_id"])
    assert {r.clause_id: r.change for r in x.collect()} == {"c1": "modified", "c2": "unchanged", "c3": "added"}
    schema = "clause_id string, rule_id string, span_start int, span_end int, finding_no int, severity string"
    fa = spark.createDataFrame([("c1", "R06", None, None, 1, "W"), ("c2", "R09", 0, 0, 2, "I")], schema)
    fb = spark.createDataFrame([("c2", "R09", None, None, 4, "I"), ("c3", "R01", 1, 2, 3, "C")], schema)
    f = diff.finding_diff(fa, fb, ["clause_id", "rule_id"])
    assert {(r.clause_id, r.change) for r in f.collect()} == {("c1", "resolved"), ("c2", "retained"), ("c3", "added")}
    s = diff.diff_summary(x, f, fa, fb).first()
    assert (s.added_clauses, s.modified_clauses, s.retained_findings, s.total_a, s.total_b) == (1, 1, 1, 2, 2)
    assert diff.clause_diff(a, a, ["clause_id"]).where("change <> 'unchanged'").count() == 0


def test_provenance(spark):
    schema = "is_number string, title string, catalogue_url string, verified_on string, verified_by string, second_checked_by string, evidence_ref string"
    good = ("IS 1", "t", "https://x", "2026-01-01", "Asha", "Ben", "rec")
    rows = [good, (*good[:2], None, *good[3:]), (*good[:5], " asha", "rec"), (*good[:6], "UNVERIFIED claim"), (*good[:5], None, "rec"), (*good[:3], "2026-13-01", *good[4:])]
    x = provenance.provenance_status(spark.createDataFrame([(*r,) for r in rows], schema), "standards").collect()
    assert [r.provenance_status for r in x] == ["VERIFIED", "FAIL", "FAIL", "FAIL", "AWAITING_SECOND_CHECK", "FAIL"]


def test_review(spark):
    f = spark.createDataFrame([("f1",), ("f2",)], "finding_id string")
    d = spark.createDataFrame([("f1", "ACCEPT", "", "o", 1), ("f1", "REJECT", "", "o", 2), ("f9", "ACCEPT", "", "o", 1)], "finding_id string, decision string, reason string, decided_by string, ts int")
    assert {r.finding_id: r.decision for r in review.apply_decisions(f, d).collect()} == {"f1": "REJECT", "f2": None}
    assert [r.finding_id for r in review.unknown_decisions(f, d).collect()] == ["f9"]
    s = spark.createDataFrame([(1, datetime.datetime(2026, 1, 1)), (2, datetime.datetime(2026, 3, 1)), (3, None)], "id int, created_at timestamp")
    assert {r.id: r.purged for r in review.retention_split(s, datetime.datetime(2026, 3, 2)).collect()} == {1: True, 2: False, 3: False}


def test_percentiles_and_gate(spark):
    x = spark.createDataFrame([("a", float(v)) for v in [5, 1, 4, 2, 3]] + [("a", None)], "k string, v double")
    r = evaluate.latency_percentiles(x, ["k"], "v").first()
    assert (r.p50, r.p95, r.p99, r.least, r.mean, r.greatest, r.n) == (3.0, 5.0, 5.0, 1.0, 3.0, 5.0, 5)
    cases = spark.createDataFrame([("c1", "defect", "en", "R05;R06"), ("c2", "clean", "en", ""), ("c3", "abstain", "hi", "R10")], "case_id string, kind string, language string, expected_rules string")
    fired = spark.createDataFrame([("c1", "R06"), ("c1", "R05"), ("c1", "R14"), ("c3", "R10")], "case_id string, rule_id string")
    m = evaluate.metrics(evaluate.case_results(cases, evaluate.fired_rules(fired))).first()
    assert (m.planted, m.caught, m.false_alarms, m.abstained, m.gate) == (2, 2, 0, 1, True)


def test_mapping_eval(spark):
    cases = spark.createDataFrame([("3 ring", False), ("solar kiln", True), ("rings", True)], "mention string, expected_unmapped boolean")
    products = spark.createDataFrame([(1, "ring", "f", '["rings"]', "[]")], PRODUCT)
    x = evaluate.mapping_eval(cases, mapping.map_product(cases, products))
    assert {r.mention: r.status for r in x.collect()} == {"3 ring": "PASS", "solar kiln": "PASS", "rings": "FAIL"}
    assert evaluate.mapping_summary(x).first().asDict() == {"total": 3, "passed": 2, "total_unmapped": 2, "unmapped_correct": 1, "gate": False}


def test_lookups_and_filters(spark):
    f = spark.createDataFrame([("c1", "ERROR"), ("c1", "INFO"), ("c2", "ERROR")], "clause_id string, severity string")
    assert review.finding_filter(f).count() == 3 and review.finding_filter(f, "ERROR").count() == 2 and review.finding_filter(f, "ERROR", "c2").count() == 1
    t = spark.range(10).withColumn("v", F.lit("x"))
    assert review.get_by_id(t, 3).count() == 1 and review.get_by_id(t, 99).count() == 0
    assert [r.id for r in review.page(t, ["id"], offset=4, limit=3).collect()] == [4, 5, 6]
    log = spark.range(600).select(F.col("id").cast("timestamp").alias("ts"))
    assert review.recent_audit_logs(log).count() == 100 and review.recent_audit_logs(log, 9999).count() == 500


def test_candidates_equal_those_of_all_pairs(spark):
    """Equi-joins on words and rarest trigrams lose no pair of mention and term that scores."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcde", k=rng.randrange(1, 7)))
    phrase = lambda: rng.choice(["", "", "(", "-", "12 "]) + rng.choice([" ", "-", ", "]).join(word() for _ in range(rng.randrange(1, 4)))
    products = [(i, phrase() or "p", "f", json.dumps([phrase() for _ in range(3)] + ["--", "x", "ab"][: i % 4]), "[]") for i in range(60)]
    mentions = [(phrase(),) for _ in range(150)] + [(json.loads(p[3])[0],) for p in products[:20]] + [(f"with {p[1]} and",) for p in products[:20]] + [("",), ("--",), ("a -- b",)]
    p = spark.createDataFrame(products, "id int, canonical_name string, family string, synonyms_en string, synonyms_hi string")
    m = spark.createDataFrame(mentions, "mention string").distinct()
    terms = mapping.product_terms(p).withColumn("_norm", T.normalise_mention(F.col("term"))).withColumn("_lname", F.lower("canonical_name"))
    q = m.withColumn("_q", T.normalise_mention(F.col("mention")))
    want = {tuple(r) for r in mapping.score_pairs(q.crossJoin(terms)).collect()}
    got = mapping.scored_candidates(m, p)
    assert {tuple(r) for r in got.collect()} == want and {r[4] for r in want} == {"EXACT", "SYNONYM", "FUZZY"}
    assert not re.search("NestedLoop|Cartesian", got._jdf.queryExecution().executedPlan().toString())


def test_many_terms_equal_a_scan_of_each(spark):
    rng = random.Random(6)
    text = lambda k: "".join(rng.choices("aAbBc İ", k=rng.randrange(k)))
    clauses = spark.createDataFrame([(i, str(i), text(30)) for i in range(120)] + [(200, "n", None), (201, "e", "")], "doc_id int, clause_id string, text string")
    for short in (1, 3):
        terms = spark.createDataFrame([(i, "".join(rng.choices("abBc ", k=rng.randrange(short, 6))), "why") for i in range(80)], "id int, term string, explanation string")
        got, want = extract.match_many_terms(clauses, terms), extract.match_vague_terms(clauses, terms)
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())) and got.count()
        assert not re.search("NestedLoop|Cartesian", got._jdf.queryExecution().executedPlan().toString())
    odd = spark.createDataFrame([(1, None, ""), (2, "", "")], "id int, term string, explanation string")
    assert extract.match_many_terms(clauses, odd).count() == 0


def test_term_classes_and_their_anchors(spark):
    """Copies of a term make one row a clause, numbers of the same digits have anchors of their own, and classes with members are all pairs."""
    clauses = spark.createDataFrame([(i, str(i), f"supply OF red bolt to IS {10000 + 7 * i}, ünï İs") for i in range(150)], "doc_id int, clause_id string, text string")
    word = {0: "RED bolt", 1: "red BOLT", 2: "of", 3: "OF", 4: "Ünï", 5: "x" * 70, 6: "İs", 7: "i̇s"}
    terms = spark.createDataFrame([(i, word.get(i % 20, f"is {10000 + 7 * i}"), "why") for i in range(400)], "id int, term string, explanation string")
    got, want = extract.match_term_classes(clauses, terms), extract.match_vague_terms(clauses, terms)
    assert got.where("class_id = 0").select("n_terms").distinct().collect() == [(40,)] and got.where("class_id in (0, 2)").count() == 300
    every = got.join(extract.term_classes(terms), "class_id").select("doc_id", "clause_id", "term_id", "span_start", "span_end", "phrase")
    assert sorted(every.collect()) == sorted(want.select(every.columns).collect())
    anchors = extract._anchors(extract._classes(terms))
    assert anchors.where("_low like 'is %'").groupBy("_h").count().agg(F.max("count")).first()[0] <= 2 and extract._classes(terms).count() == anchors.count()


def test_pattern_runs_once_over_a_clause(spark):
    """However many fields of a citation are read, the plan holds one search for matches."""
    x = extract.extract_citations(spark.createDataFrame([(1, "IS 123: 2010")], "doc_id int, text string")).select("is_number", "year", "part", "span_start", "raw")
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and plan.count("regexp_replace") == 1


def test_first_citation_and_first_two_places(spark):
    x = spark.createDataFrame([(1, "see IS 13252-2010 and IS 5"), (2, "none"), (3, None)], "id int, note string")
    got = {r.id: r.citation for r in extract.normalize_citation(x, "note").collect()}
    assert (got[1].is_number, got[1].year, got[2], got[3]) == ("IS 13252", 2010, None, None)
    rows = [(1, "a", o, c, 0, 1, n, y, None) for o, c, n, y in ((3, 0, "IS 1", 2000), (1, 1, "IS 1", 2001), (1, 0, "IS 1", 2000), (2, 0, "IS 2", 2000))]
    places = spark.createDataFrame(rows, "doc_id int, clause_id string, ordinal int, cit_no int, span_start int, span_end int, number string, year int, part string").repartition(3)
    (two,) = rules.first_two_locations(places).collect()
    assert (two.number, two.a.ordinal, two.a.cit_no, two.b.cit_no) == ("IS 1", 1, 0, 1)


def test_override_and_confirmation(spark):
    p = spark.createDataFrame([(1, "ring", "f", "[]", "[]"), (2, "Bolt", "f", "[]", "[]")], "id int, canonical_name string, family string, synonyms_en string, synonyms_hi string")
    x = mapping.map_product(spark.createDataFrame([("ring",), ("cog",)], "mention string"), p)
    o = spark.createDataFrame([("ring", "x", "A", 1), ("ring", "bolt", "A", 2), ("cog", "mine", "A", 2), ("cog", "cog wheel", "A", 2)], "mention string, name string, officer string, ts int")
    got = {r.mention: r for r in mapping.override_mapping(x, o, p).collect()}
    assert (got["ring"].product_id, got["ring"].canonical_name, got["ring"].candidates, got["ring"].method) == (2, "Bolt", [], "OFFICER_OVERRIDE")
    assert (got["cog"].product_id, got["cog"].canonical_name, got["cog"].is_unmapped) == (None, "mine", False)  # of one time the greater name
    c = spark.createDataFrame([("ring", "A", "old", 1), ("ring", "B", "new", 2)], "mention string, officer string, notes string, ts int")
    got = {r.mention: r for r in mapping.confirm_mapping(x, c).collect()}
    assert (got["ring"].officer_confirmed, got["ring"].officer, got["cog"].officer_confirmed) == (True, "B", False)


def test_percentiles_of_hot_null_and_tied_keys(spark):
    rng = random.Random(7)
    rows = [("hot", rng.randrange(5000)) for _ in range(6000)] + [(None, i % 3) for i in range(50)] + [("one", 9), ("ties", 4), ("ties", 4), ("none", None)]
    x = spark.createDataFrame(rows, "k string, v int").repartition(3)
    want = {}
    for k in {k for k, v in rows if v is not None}:
        vs = sorted(v for q, v in rows if q == k and v is not None)
        at = lambda p, vs=vs: vs[min(len(vs), int(len(vs) * p) + 1) - 1]
        want[k] = (at(0.5), at(0.95), at(0.99), vs[0], sum(vs) / len(vs), vs[-1], len(vs))
    assert {r.k: tuple(r)[1:] for r in evaluate.latency_percentiles(x, ["k"], "v").collect()} == want
    assert evaluate.in_ranges(x.where("k = 'hot'"), ["k"], "v").select("_b").distinct().count() == evaluate.RANGES


def test_product_rules(spark):
    p = spark.createDataFrame([(1, "a"), (2, "b")], "id int, canonical_name string")
    c = spark.createDataFrame([(8, 1, "y"), (7, 1, "x")], "id int, product_id int, instrument string")
    assert {r.id: [z.instrument for z in r.rules] for r in review.product_rules(p, c).collect()} == {1: ["x", "y"], 2: []}


def test_log_rows_of_officers_work(spark):
    day = datetime.datetime(2026, 2, 1)
    f = spark.createDataFrame([("f1",)], "finding_id string")
    d = spark.createDataFrame([("f1", "ACCEPT", "", "o", 1), ("f1", "REJECT", "why", "o", 2), ("f9", "ACCEPT", "", "o", 1)], "finding_id string, decision string, reason string, decided_by string, ts int")
    assert sorted((r.action, r.record_id, r.user_id, json.loads(r.new_values)["decision"]) for r in review.decision_log(f, d).collect()) == [("FINDING_DECISION", "f1", "o", "ACCEPT"), ("FINDING_DECISION", "f1", "o", "REJECT")]
    s = spark.createDataFrame([(1, day - datetime.timedelta(days=40)), (2, day), (3, None)], "id int, created_at timestamp")
    for rows, n in ((s, 1), (s.where("id = 2"), 0)):
        (log,) = review.purge_log(review.retention_split(rows, day), day).collect()
        assert (log.action, log.purged, json.loads(log.new_values)["days"]) == ("RETENTION_PURGE", n, 30)
    a = spark.createDataFrame([(1, "u"), (2, "u")], "audit_id int, user_id string")
    r = spark.createDataFrame([(1, "u", "Officer", 5), (2, "v", "Officer", 5), (3, "v", "Admin", 5)], "audit_id int, user_id string, role string, ts int")
    assert [(x.action, x.record_id, x.user_id) for x in review.deletion_log(review.delete_audits(a, r)[1]).collect()] == [("DELETE_AUDIT", "1", "u")]
    t = spark.createDataFrame([(1, "old"), (1, "old")], "id int, term string")
    n = spark.createDataFrame([(5, "old"), (6, "new"), (7, "new")], "id int, term string")
    assert sorted(map(tuple, review.upsert_errors(t, n).collect())) == [(5, "old", "phrase exists"), (7, "new", "phrase repeated")]


def test_plain_forms_cost_no_pattern(spark):
    """``split`` compiles a pattern at each row, so extraction has none but of single characters; spans of several citations, folded digits and letters before a prefix."""
    x = spark.createDataFrame([(1, "XIS 12 IS 123 - 45 (Part ७): 2015, आईएस ४५६|IS/IEC 60335-1-2019 Part 2"), (2, None), (3, "none")], "doc_id int, text string")
    own = extract.extract_citations(x)
    assert not re.search(r"split\([^()]*(\([^()]*\))*[^()]*IEC\|ISO", own._jdf.queryExecution().optimizedPlan().toString())
    text = x.first().text
    got = own.orderBy("cit_no").collect()
    assert [(r.raw, r.is_number, r.part, r.year) for r in got] == [("IS 123 - 45 (Part ७): 2015", "IS 123-45", "7", 2015), ("आईएस ४५६", "IS 456", None, None), ("IS/IEC 60335-1-2019 Part 2", "IS/IEC 60335-1", "2", 2019)]
    assert all(text[r.span_start : r.span_end] == r.raw for r in got)
    numbers = ["IS 123-45", "IS/IEC 5", "IS/PART 5", "IS 5 (Part 2)", " IS 5", "IS 5\n", "आईएस 5", "IS ५"]
    y = spark.createDataFrame([(n,) for n in numbers], "n string").select(T.base_number(F.col("n"))).collect()
    assert [r[0] for r in y] == ["IS 123-45", "IS/IEC 5", "IS/", "IS 5", "IS 5", "IS 5", "IS 5", "IS 5"]


def test_clauses_are_made_once_for_all_rules(spark):
    """With the shared frames kept, none of them makes the clauses (a window over the line items) again."""
    from clauseaudit.sources.bindings import facts

    f = rules.shared(facts(spark, "/root/testdata/sf0.001"))
    try:
        for x in (f.extracted, f.products):  # kept themselves, and made of the kept clauses
            assert x._jdf.queryExecution().withCachedData().toString().count("InMemoryRelation") == 2
    finally:
        rules.release(f)

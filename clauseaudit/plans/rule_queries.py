"""Registered queries of the citation and rule operators, over clauses derived from line items, with their SQL."""

from __future__ import annotations

import dataclasses
import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseaudit.operators import diff, evaluate, incremental, mapping, review, rules
from clauseaudit.operators.extract import cross_check, extract_citations, match_many_terms, match_vague_terms, term_classes, with_fallback
from clauseaudit.operators.extractor import PatternExtractor, extract_keys, extract_with
from clauseaudit.sources import bindings
from clauseaudit.sources.bindings import facts
from clauseaudit.sources.reference import rule_catalogue
from clauseaudit.sources.scratch import put, shared_folder
from clauseaudit.streaming.intake import stream_pages

FLAT = ("doc_id", "clause_id", "rule_id", "severity", "span_start", "span_end", "message_en", "row_id", "url", "verified_on")
MANY = "l_orderkey % 300"  # documents of many orders, for the rules that need repeats


def flat(x: DataFrame) -> DataFrame:
    """A finding's main fields as plain columns."""
    return x.select(*FLAT[:7], F.col("evidence.row_id").alias("row_id"), F.col("evidence.url").alias("url"), F.col("evidence.verified_on").alias("verified_on"))


def _rule(rule: str, doc: str = "l_orderkey"):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = facts(spark, sf_dir, doc, store=rule in ("R08", "R14"))  # which read the citations more than once
        if rule == "R07":
            rules.room_for_texts(f.reference)
        return flat(rules.evaluate(f, (rule,)))

    return query


def extract_citations_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = extract_citations(bindings.clauses(spark, sf_dir).select("doc_id", "clause_id", "text"))
    return x.select("doc_id", "clause_id", "cit_no", "raw", "span_start", "span_end", "is_number", "part", "year")


def resolve_standard_q(spark: SparkSession, sf_dir: str, alias: bool = True) -> DataFrame:
    f = facts(spark, sf_dir)
    x = f.resolved if alias else mapping.resolve_standard(f.resolved.drop("std", "base_number"), f.reference.standards, alias=False)
    return x.select("doc_id", "clause_id", "is_number", "base_number", F.col("std.id").alias("standard_id"), F.col("std.is_number").alias("resolved_number"))


def suggest_near_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir)
    return mapping.suggest_near(f.resolved.where("std is null"), f.reference.standards)


def match_vague_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = bindings.clauses(spark, sf_dir).select("doc_id", "clause_id", "text")
    return match_vague_terms(c, bindings.reference(spark, sf_dir).vague_terms).select("doc_id", "clause_id", "term_id", "phrase", "span_start", "span_end")


_TERMS = "SELECT p_partkey AS id, CASE WHEN p_partkey % 50 = 1 THEN upper(p_name) WHEN p_partkey = 2 THEN 'of' ELSE concat('is ', CAST(10000 + 7 * p_partkey AS STRING)) END AS term, p_name AS explanation FROM {part}"


def match_many_terms_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term for every part: catalogue numbers, some names, and a word of two letters.  A row for each clause and term, equal terms too."""
    x = match_many_terms(bindings.clauses(spark, sf_dir).select("doc_id", "clause_id", "text"), bindings.sql(spark, sf_dir, _TERMS))
    return x.select("doc_id", "clause_id", "term_id", "phrase", "span_start", "span_end")


def term_classes_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_classes(bindings.sql(spark, sf_dir, _TERMS))


def map_product_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = bindings.reference(spark, sf_dir)
    x = mapping.map_product(bindings.sql(spark, sf_dir, "SELECT DISTINCT p_name AS mention FROM {part}"), r.products)
    return x.select("mention", "product_id", "canonical_name", "confidence", "method", "is_unmapped", F.size("candidates").cast("long").alias("n_candidates"))


_MENTIONS = """SELECT DISTINCT concat(CASE WHEN p_partkey % 4 = 0 THEN '12 ' ELSE '' END, CASE p_partkey % 5 WHEN 0 THEN split_part(p_name, ' ', 2) WHEN 1 THEN concat(split_part(p_name, ' ', 2), 's') WHEN 2 THEN concat('Steel ', split_part(p_name, ' ', 2), 's, ', split_part(p_name, ' ', 1))
 WHEN 3 THEN 'x' ELSE p_name END) AS mention FROM {part}"""


def map_product_hits_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, synonyms, synonyms inside a longer mention, parts of short synonyms and other names: every kind of score."""
    r = bindings.reference(spark, sf_dir)
    more = spark.sql("SELECT CAST(8 AS INT) AS id, 'cross' AS canonical_name, 'signs' AS family, '[\"x\"]' AS synonyms_en, '[\"x y\", \"xx\"]' AS synonyms_hi")
    x = mapping.map_product(bindings.sql(spark, sf_dir, _MENTIONS), r.products.unionByName(more))
    return x.select("mention", "product_id", "confidence", "method")


def override_mapping_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Officers' overrides of mapped names, two at one time and one to a name that is no product's."""
    r = bindings.reference(spark, sf_dir)
    x = mapping.map_product(bindings.sql(spark, sf_dir, "SELECT DISTINCT p_name AS mention FROM {part}"), r.products)
    o = bindings.sql(spark, sf_dir, f"SELECT DISTINCT p_name AS mention, n AS name, 'Asha' AS officer, 1 AS ts FROM {{part}} JOIN (VALUES ('RING'), ('Bolt'), ('own name')) AS t(n) ON {bindings.NOUN} IN ('gear', 'anvil') AND (n = 'own name') = ({bindings.NOUN} = 'anvil')")
    return mapping.override_mapping(x, o, r.products).select("mention", "product_id", "canonical_name", "confidence", "method", "is_unmapped", F.size("candidates").cast("long").alias("n_candidates"))


def resolve_product_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = bindings.reference(spark, sf_dir)
    m = bindings.sql(spark, sf_dir, f"SELECT p_partkey, {bindings.NOUN} AS text, CASE WHEN p_partkey % 4 = 0 THEN 'Rings' END AS canonical_product_id FROM {{part}}")
    return mapping.resolve_product(m, r.products).select("p_partkey", "text", F.col("product.id").alias("product_id"), F.col("product.family").alias("family"))


def used_rows_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.used_rows(facts(spark, sf_dir, store=True))


def evaluate_documents_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all rules, counted by rule and severity, documents of many orders."""
    x = rules.evaluate_documents(facts(spark, sf_dir, MANY, store=True))
    return x.groupBy("rule_id", "severity").agg(F.count("*").alias("n"), F.count_distinct("doc_id", "clause_id").alias("n_clauses"))


def evaluate_clauses_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = rules.evaluate_clauses(facts(spark, sf_dir, document_scope=False, store=True))
    return x.groupBy("rule_id", "severity").agg(F.count("*").alias("n"), F.count_distinct("doc_id", "clause_id").alias("n_clauses"))


def cited_number_set_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).cited


def severity_counts_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.severity_counts(rules.evaluate_documents(facts(spark, sf_dir, MANY, store=True)), ["doc_id"])


def audit_summary_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir, MANY, store=True)
    return evaluate.audit_summary(f.clauses, rules.evaluate_documents(f))


def fired_rules_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = rules.evaluate_documents(facts(spark, sf_dir, MANY, store=True)).withColumnRenamed("doc_id", "case_id")
    return evaluate.fired_rules(x).select("case_id", F.array_join("got", ";").alias("got"))


def evidence_completeness_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.evidence_completeness(rules.evaluate_documents(facts(spark, sf_dir, MANY, store=True)))


def finding_filter_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of all rules."""
    return flat(review.finding_filter(rules.evaluate_documents(facts(spark, sf_dir, MANY, store=True)), "ERROR")).drop("span_start", "span_end")


def mapping_eval_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names whose last noun is (or is not) a product, and how they are mapped."""
    cases = bindings.sql(spark, sf_dir, f"SELECT DISTINCT p_name AS mention, {bindings.NOUN} NOT IN (SELECT canonical_name FROM ({bindings.PRODUCTS})) AS expected_unmapped FROM {{part}}")
    mapped = mapping.map_product(cases.select("mention"), bindings.reference(spark, sf_dir).products)
    return evaluate.mapping_eval(cases, mapped).select("mention", "expected_unmapped", "is_unmapped", "status")


def mapping_summary_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.mapping_summary(mapping_eval_q(spark, sf_dir))


def edited_clauses_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every fifth part's clauses the year of the citations is struck out: those clauses are evaluated again."""
    f = facts(spark, sf_dir)
    some = ("R02", "R03", "R04", "R05")
    edited = f.clauses.where("part_key % 5 = 0").select("doc_id", "clause_id")
    new = dataclasses.replace(f, resolved=f.resolved.withColumn("year", F.lit(None).cast(f.resolved.schema["year"].dataType)))
    return flat(review.edited_clause_findings(rules.evaluate(f, some), edited, new, lambda g: rules.evaluate(g, some))).select("doc_id", "clause_id", "rule_id", "row_id")


def incremental_audit_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all rules after edits of clauses and of reference rows: a stored audit, brought up to date."""
    old, new = (bindings.reference(spark, sf_dir, edited) for edited in (False, True))
    before, after = (bindings.clauses(spark, sf_dir, MANY, edited).select("doc_id", "clause_id", "ordinal", "text", "mention") for edited in (False, True))
    state = incremental.audit(before, old, bindings.extract, shared_folder(spark, "audit"))
    spark.catalog.clearCache()
    rules.room_for_texts(new)
    return flat(incremental.update(state, after, old, new, bindings.extract, shared_folder(spark, "update")).findings)


#: Versions of rules that differ from the fixed ones: another severity and wording from a day on, none from a day on, none after a day, a placeholder that nothing fills.
_CHANGED = """SELECT 'R03' AS rule_id, true AS enabled, 'ERROR' AS severity, 'Cited {{cited_year}}, listed {{catalogue_year}}.' AS message_en, '2' AS rule_set_version, DATE '2025-05-01' AS valid_from, CAST(NULL AS DATE) AS valid_to
 UNION ALL SELECT 'R08', false, 'INFO', 'none', '2', DATE '2025-04-01', NULL UNION ALL SELECT 'R09', true, 'WARNING', 'See {{nothing}}: {{explanation}}', '2', DATE '2025-03-01', DATE '2025-06-01'"""
_DATES = f"SELECT doc_id, DATE '2025-01-01' + CAST(doc_id AS INT) AS audit_date FROM (SELECT DISTINCT {MANY.replace('l_', 'o_')} AS doc_id FROM {{orders}}) o WHERE doc_id % 10 <> 0"


def rules_as_data_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings under a catalogue of rule versions, each document under those of its own audit date (the day of the audit where it has none)."""
    catalogue = rule_catalogue(spark).unionByName(bindings.sql(spark, sf_dir, _CHANGED), allowMissingColumns=True)
    f = dataclasses.replace(facts(spark, sf_dir, MANY, store=True), catalogue=catalogue, audit_dates=bindings.sql(spark, sf_dir, _DATES))
    x = rules.evaluate(f, ("R03", "R04", "R08", "R09"))
    return x.select(*FLAT[:4], "message_en", "rule_set_version")


class _NumberReader(PatternExtractor):
    """Reads plain numbers only and fails on clauses about gizmos."""

    def extract(self, clauses, language_hints):
        if any("gizmo" in c for c in clauses):
            raise ValueError("no gizmos")
        return super().extract(clauses, language_hints)


def extractor_hook_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second extractor through the hook, part of its results out of a cache, then the native one where it failed, cross-checked."""
    c = bindings.clauses(spark, sf_dir).select("doc_id", "clause_id", "part_key", "text")
    reader = _NumberReader(r"IS (?P<number>\d{2,6})(?: \(Part (?P<part>\d+)\))?(?:: (?P<year>(?:19|20)\d\d))?")
    folder = shared_folder(spark, "cache")
    c = put(c, folder, "clauses")
    cache = put(extract_keys(c.where("part_key % 2 = 0"), reader), folder, "extractions")
    x = cross_check(with_fallback(extract_with(c, reader, cache, folder=folder)))
    return x.select("doc_id", "clause_id", "provider", "cached", F.substring_index("error", ":", 1).alias("error"), "extraction_uncertain", F.size("citations").alias("n_citations"), F.try_element_at("citations", F.lit(1))["is_number"].alias("is_number"), F.try_element_at("citations", F.lit(1))["span_start"].alias("span_start"))


def stream_pages_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses as pages that arrive in files, out of order and some of them twice: documents gathered by state, findings of all rules."""
    folder = shared_folder(spark, "pages")
    c = put(bindings.clauses(spark, sf_dir, MANY).select("doc_id", "ordinal", "text"), folder, "clauses")
    n = c.groupBy("doc_id").agg(F.count("*").cast("int").alias("page_count"))
    pages = c.join(n, "doc_id").select("doc_id", F.col("ordinal").alias("page_number"), "page_count", "text", (F.lit(datetime.datetime(2026, 1, 1)) + F.make_dt_interval(secs=F.col("ordinal"))).alias("intake_ts"))
    for part in (pages.where("page_number % 3 = 0"), pages.where("page_number % 3 <> 0 or page_number % 5 = 0"), pages.where("page_number % 7 = 0")):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")

    def extract(batch: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        x = batch.select("doc_id", F.concat(F.lit("c"), F.col("page_number").cast("string")).alias("clause_id"), F.col("page_number").alias("ordinal"), "text")
        named = x.withColumn("mention", F.regexp_extract("text", "^Supply of \\d+ ([a-z]+ [a-z]+)", 1))
        return x, *bindings.extract(named)

    stream_pages(spark, f"{folder}/in", pages.schema, extract, lambda: bindings.reference(spark, sf_dir), f"{folder}/out", f"{folder}/check", files_per_batch=2).awaitTermination()
    rules.room_for_texts(bindings.reference(spark, sf_dir))
    return flat(spark.read.parquet(f"{folder}/out/batch=*"))


def _drafts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = bindings.clauses(spark, sf_dir).select("doc_id", "clause_id", "ordinal", "text", "part_key")
    b = a.where("part_key % 7 <> 0").withColumn("text", F.when(F.col("part_key") % 5 == 0, F.concat("text", F.lit(" Revised."))).otherwise(F.col("text")))
    return a, b


def clause_diff_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.clause_diff(*_drafts(spark, sf_dir), ["doc_id", "clause_id"])


def _draft_findings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    r = bindings.reference(spark, sf_dir)
    out = []
    for d in _drafts(spark, sf_dir):
        x = match_vague_terms(d.select("doc_id", "clause_id", "part_key", "text"), r.vague_terms)
        out.append(x.select("doc_id", "clause_id", F.lit("R09").alias("rule_id"), F.when(F.col("part_key") % 2 == 0, F.col("span_start")).alias("span_start"), F.when(F.col("part_key") % 2 == 0, F.col("span_end")).alias("span_end"), F.col("part_key").alias("finding_no"), F.lit("INFO").alias("severity")))
    return out[0], out[1]


def finding_diff_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.finding_diff(*_draft_findings(spark, sf_dir), ["doc_id", "clause_id", "rule_id"])


def diff_summary_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _draft_findings(spark, sf_dir)
    return diff.diff_summary(clause_diff_q(spark, sf_dir), finding_diff_q(spark, sf_dir), a, b)


QUERIES = {f"rule_{r.lower()}_{n}": _rule(r, d) for r, n, d in (
    ("R01", "unknown_citation", "l_orderkey"), ("R02", "withdrawn", "l_orderkey"), ("R03", "year_differs", "l_orderkey"), ("R04", "part_mismatch", "l_orderkey"), ("R05", "cert_list_differs", "l_orderkey"),
    ("R06", "cert_not_mentioned", "l_orderkey"), ("R07", "no_standard_cited", "l_orderkey"), ("R08", "allied_absent", "l_orderkey"), ("R09", "vague_wording", "l_orderkey"), ("R10", "abstain", "l_orderkey"),
    ("R11", "contradiction", MANY), ("R12", "malformed", "l_orderkey"), ("R13", "wrong_family", "l_orderkey"), ("R14", "stale_row", "l_orderkey"),
)} | {
    "extract_citations": extract_citations_q, "resolve_standard": resolve_standard_q, "resolve_standard_strict": lambda s, d: resolve_standard_q(s, d, False), "suggest_near": suggest_near_q,
    "match_vague_terms": match_vague_q, "match_many_terms": match_many_terms_q, "term_classes": term_classes_q, "map_product": map_product_q, "map_product_hits": map_product_hits_q, "override_mapping": override_mapping_q, "resolve_product": resolve_product_q, "used_rows": used_rows_q, "evaluate_documents": evaluate_documents_q, "evaluate_clauses": evaluate_clauses_q,
    "cited_number_set": cited_number_set_q, "severity_counts": severity_counts_q, "audit_summary": audit_summary_q, "fired_rules": fired_rules_q, "eval_evidence_completeness": evidence_completeness_q,
    "finding_filter": finding_filter_q, "mapping_eval": mapping_eval_q, "mapping_summary": mapping_summary_q, "edited_clauses": edited_clauses_q, "incremental_audit": incremental_audit_q, "rules_as_data": rules_as_data_q, "extractor_hook": extractor_hook_q, "stream_pages_audit": stream_pages_q, "clause_diff": clause_diff_q, "finding_diff": finding_diff_q, "diff_summary": diff_summary_q,
}


def _views(doc: str = "l_orderkey") -> str:
    """DuckDB: the bindings, then citations (one a clause at most) resolved by base number, then products of clauses."""
    t = {"part": "part", "lineitem": "lineitem", "doc": doc}
    return f"""
WITH std AS ({bindings.STANDARDS.format(**t)}), cl AS ({bindings.CLAUSES.format(**t)}), prod AS ({bindings.PRODUCTS}), map AS ({bindings.MAPS.format(**t)}), cert AS ({bindings.CERTIFICATION}),
link AS ({bindings.LINKS.format(**t)}), vague AS ({bindings.VAGUE}),
m AS (SELECT *, regexp_extract(text, 'IS(?:/(IEC))? (\\d{{2,6}})(?: \\(Part (\\d+)\\))?(?:: ((?:19|20)\\d\\d))?', ['body', 'num', 'part', 'year']) AS g,
  regexp_extract(text, 'IS(?:/(IEC))? (\\d{{2,6}})(?: \\(Part (\\d+)\\))?(?:: ((?:19|20)\\d\\d))?', 0) AS raw FROM cl),
cite AS (SELECT doc_id, clause_id, ordinal, raw, CAST(strpos(text, raw) - 1 AS INT) AS span_start, CAST(strpos(text, raw) - 1 + length(raw) AS INT) AS span_end,
  concat('IS', CASE WHEN g.body <> '' THEN '/IEC' ELSE '' END, ' ', g.num) AS is_number, nullif(g.part, '') AS part, TRY_CAST(nullif(g.year, '') AS INT) AS year FROM m WHERE raw <> ''),
res AS (SELECT c.*, s.id AS sid, s.is_number AS snum, s.part AS spart, s.publication_year AS syear, s.status, s.catalogue_url, s.verified_on AS sdate, s.is_conflict OR s.status = 'CONFLICT' AS conf
  FROM cite c LEFT JOIN std s ON regexp_replace(s.is_number, ' \\(Part \\d+\\)', '') = c.is_number),
near AS (SELECT n.is_number, arg_min(s.is_number, s.id) AS candidate FROM (SELECT DISTINCT is_number FROM res WHERE sid IS NULL) n JOIN std s
  ON levenshtein(n.is_number, s.is_number) = 1 OR levenshtein(n.is_number, regexp_replace(s.is_number, ' \\(Part \\d+\\)', '')) = 1 GROUP BY 1),
cp AS (SELECT c.doc_id, c.clause_id, c.ordinal, c.text, c.mention, p.id AS pid, p.family FROM cl c LEFT JOIN prod p ON p.canonical_name = split_part(c.mention, ' ', 2))
"""


def _select(rule: str, severity: str, message: str, source: str, row: str = "NULL::INT", url: str = "NULL::VARCHAR", date: str = "NULL::VARCHAR", span: bool = True, doc: str = "l_orderkey", conf: str | None = None) -> str:
    sev = f"CASE WHEN coalesce({conf}, false) THEN 'CANNOT_VERIFY' ELSE '{severity}' END" if conf else f"'{severity}'"
    place = "span_start, span_end" if span else "NULL::INT AS span_start, NULL::INT AS span_end"
    return f"{_views(doc)} SELECT doc_id, clause_id, '{rule}' AS rule_id, {sev} AS severity, {place}, {message} AS message_en, {row} AS row_id, {url} AS url, {date} AS verified_on FROM {source}"


def _d(c: str) -> str:
    return f"coalesce(CAST({c} AS VARCHAR), '')"


_STD = {"row": "sid", "url": "catalogue_url", "date": _d("sdate"), "conf": "conf"}
_R05 = "(SELECT r.*, c.id AS cid, c.source_url AS curl, c.verified_on AS cdate, c.is_conflict AS cconf, s.is_number AS spec FROM res r JOIN cp USING (doc_id, clause_id) JOIN cert c ON c.product_id = cp.pid JOIN std s ON s.id = c.specified_standard_id WHERE r.sid IS NOT NULL AND s.id <> r.sid)"
_R06 = "(SELECT cp.*, c.id AS cid, c.source_url AS curl, c.verified_on AS cdate, c.is_conflict AS cconf FROM cp JOIN cert c ON c.product_id = cp.pid WHERE NOT contains(lower(text), 'isi mark'))"
_R08 = """(SELECT r.*, k.id AS kid, k.source_url AS kurl, k.verified_on AS kdate, k.is_conflict AS kconf, t.is_number AS allied FROM res r JOIN link k ON k.source_standard_id = r.sid JOIN std t ON t.id = k.target_standard_id
 WHERE NOT EXISTS (SELECT 1 FROM cite x WHERE x.doc_id = r.doc_id AND x.is_number IN (t.is_number, regexp_replace(t.is_number, ' \\(Part \\d+\\)', ''))))"""
_R13 = """(SELECT * FROM (SELECT r.*, w.id AS wid, w.source_url AS wurl, w.verified_on AS wdate, w.is_conflict AS wconf, o.canonical_name AS other, row_number() OVER (PARTITION BY r.doc_id, r.clause_id ORDER BY w.id) AS rn
 FROM res r JOIN cp USING (doc_id, clause_id) JOIN map w ON w.standard_id = r.sid JOIN prod o ON o.id = w.product_id WHERE cp.pid IS NOT NULL AND o.family <> cp.family
 AND NOT EXISTS (SELECT 1 FROM map y WHERE y.standard_id = r.sid AND y.product_id = cp.pid)) WHERE rn = 1)"""
_USED = f"""(SELECT doc_id, clause_id, 'standards' AS table_name, sid AS row_id, sdate AS verified_on FROM res WHERE sid IS NOT NULL
 UNION SELECT doc_id, clause_id, 'certification_rules', cid, cdate FROM {_R06} UNION SELECT doc_id, clause_id, 'certification_rules', cid, cdate FROM {_R05}
 UNION SELECT doc_id, clause_id, 'product_standard_map', wid, wdate FROM {_R13} UNION SELECT doc_id, clause_id, 'allied_links', kid, kdate FROM {_R08})"""
_R07 = """(SELECT cp.doc_id, cp.clause_id, z.* FROM cp LEFT JOIN (SELECT product_id, string_agg(s.is_number, ', ' ORDER BY map.id) AS names, min(map.id) FILTER (map.verified_on IS NOT NULL) AS mid,
  arg_min(map.source_url, map.id) FILTER (map.verified_on IS NOT NULL) AS murl, CAST(arg_min(map.verified_on, map.id) FILTER (map.verified_on IS NOT NULL) AS VARCHAR) AS mdate
  FROM map JOIN std s ON s.id = map.standard_id GROUP BY 1) z ON z.product_id = cp.pid WHERE cp.pid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cite x WHERE x.doc_id = cp.doc_id AND x.clause_id = cp.clause_id))"""
_R10 = "(SELECT cp.*, CAST(strpos(text, mention) - 1 AS INT) AS span_start, CAST(strpos(text, mention) - 1 + length(mention) AS INT) AS span_end FROM cp WHERE pid IS NULL AND NOT EXISTS (SELECT 1 FROM cite x WHERE x.doc_id = cp.doc_id AND x.clause_id = cp.clause_id))"
_R11 = """(SELECT doc_id, list(clause_id ORDER BY ordinal) AS l, arg_min(span_start, ordinal) AS span_start, arg_min(span_end, ordinal) AS span_end, l[1] AS clause_id, l[2] AS b FROM cite GROUP BY doc_id, is_number
 HAVING count(*) > 1 AND (count(DISTINCT year) > 1 OR count(DISTINCT part) > 1))"""


def _branches(doc: str) -> dict[str, str]:
    return {
        "R01": _select("R01", "CANNOT_VERIFY", "'This standard is not in our dataset, so we cannot check it.'", "res WHERE sid IS NULL AND is_number NOT IN (SELECT is_number FROM near)", doc=doc),
        "R02": _select("R02", "ERROR", f"'The catalogue shows this standard as ' || status || ' (verified ' || {_d('sdate')} || ').'", "res WHERE status IN ('Withdrawn', 'Superseded') AND sdate IS NOT NULL", **_STD, doc=doc),
        "R03": _select("R03", "WARNING", f"'The clause cites ' || year || '. The catalogue shows ' || syear || ' (verified ' || {_d('sdate')} || ').'", "res WHERE year <> syear", **_STD, doc=doc),
        "R04": _select("R04", "WARNING", f"'The cited part or section differs from the catalogue record (verified ' || {_d('sdate')} || ').'", "res WHERE spart IS NOT NULL AND coalesce(part, '') <> spart", **_STD, doc=doc),
        "R05": _select("R05", "ERROR", f"'The certification list specifies ' || spec || ' for this product. This clause cites ' || raw || '. (verified ' || {_d('cdate')} || ')'", _R05, "cid", "curl", _d("cdate"), conf="conf OR cconf", doc=doc),
        "R06": _select("R06", "WARNING", f"'A certification requirement is listed for this product and the clause does not mention it (verified ' || {_d('cdate')} || ').'", _R06, "cid", "curl", _d("cdate"), span=False, conf="cconf", doc=doc),
        "R07": _select("R07", "WARNING", "'No standard is cited for this product. The dataset lists ' || coalesce(names, 'standards in catalogue') || ' (verified ' || coalesce(mdate, 'verified date not recorded') || ').'", _R07, "mid", "murl", "mdate", span=False, doc=doc),
        "R08": _select("R08", "INFO", f"'A verified link lists ' || allied || ' alongside the cited standard (verified ' || {_d('kdate')} || ').'", _R08, "kid", "kurl", _d("kdate"), conf="conf OR kconf", doc=doc),
        "R09": _select("R09", "INFO", "'This wording does not name a standard: ' || explanation", "(SELECT cl.*, v.explanation, CAST(strpos(lower(text), lower(term)) - 1 AS INT) AS span_start, CAST(strpos(lower(text), lower(term)) - 1 + length(term) AS INT) AS span_end FROM cl JOIN vague v ON contains(lower(text), lower(term)))", doc=doc),
        "R10": _select("R10", "CANNOT_VERIFY", "'No applicable standard in our dataset.'", _R10, doc=doc),
        "R11": _select("R11", "WARNING", "'This standard is cited with different years or parts at ' || clause_id || ' and ' || b || '.'", _R11, doc=doc),
        "R12": _select("R12", "INFO", "'This citation looks close to ' || candidate || '. Please confirm.'", "res JOIN near USING (is_number) WHERE sid IS NULL", doc=doc),
        "R13": _select("R13", "WARNING", f"'The dataset links this standard to ' || other || ', not this product (verified ' || {_d('wdate')} || ').'", _R13, "wid", "wurl", _d("wdate"), conf="conf OR wconf", doc=doc),
        "R14": _select("R14", "INFO", "'A source row used here was last verified on ' || CAST(verified_on AS VARCHAR) || '.'", f"{_USED} WHERE DATE '2026-01-01' - verified_on > 180", "row_id", date="CAST(verified_on AS VARCHAR)", span=False, doc=doc),
    }


def _all(doc: str, drop: tuple[str, ...] = ()) -> str:
    """All rules in one statement: the shared views once, then the union of the rules' own parts."""
    parts = [s.removeprefix(_views(doc)) for r, s in _branches(doc).items() if r not in drop]
    return f"{_views(doc)} SELECT rule_id, severity, count(*) AS n, count(DISTINCT (doc_id, clause_id)) AS n_clauses FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL"


def _every(doc: str = MANY, some: tuple[str, ...] | None = None) -> str:
    """Findings of all (or some) rules, without the shared views."""
    return " UNION ALL ".join(x.removeprefix(_views(doc)) for r, x in _branches(doc).items() if some is None or r in some)


_A = "a AS (SELECT * FROM cl), b AS (SELECT doc_id, clause_id, ordinal, part_key, CASE WHEN part_key % 5 = 0 THEN text || ' Revised.' ELSE text END AS text FROM cl WHERE part_key % 7 <> 0)"
_CDIFF = "cd AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.clause_id, b.clause_id) AS clause_id, CASE WHEN a.text IS NULL THEN 'added' WHEN b.text IS NULL THEN 'removed' WHEN trim(a.text) <> trim(b.text) THEN 'modified' ELSE 'unchanged' END AS change, a.text AS old_text, b.text AS new_text FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.clause_id = b.clause_id)"
_FSIDE = "SELECT doc_id, clause_id, part_key AS finding_no, CASE WHEN part_key % 2 = 0 THEN strpos(lower(text), lower(term)) - 1 ELSE 0 END AS s, CASE WHEN part_key % 2 = 0 THEN strpos(lower(text), lower(term)) - 1 + length(term) ELSE 0 END AS e FROM {0} JOIN vague ON contains(lower(text), lower(term))"
_FDIFF = f"fa AS ({_FSIDE.format('a')}), fb AS ({_FSIDE.format('b')}), fd AS (SELECT coalesce(x.doc_id, y.doc_id) AS doc_id, coalesce(x.clause_id, y.clause_id) AS clause_id, 'R09' AS rule_id, CAST(coalesce(x.s, y.s) AS INT) AS span_start, CAST(coalesce(x.e, y.e) AS INT) AS span_end, CASE WHEN x.doc_id IS NULL THEN 'added' WHEN y.doc_id IS NULL THEN 'resolved' ELSE 'retained' END AS change, coalesce(y.finding_no, x.finding_no) AS finding_no, 'INFO' AS severity FROM fa x FULL JOIN fb y ON x.doc_id = y.doc_id AND x.clause_id = y.clause_id AND x.s = y.s AND x.e = y.e)"


def _edited_views(doc: str) -> str:
    """The views over the edited clauses and reference tables."""
    t, out = {"part": "part", "lineitem": "lineitem", "doc": doc}, _views(doc)
    for old, new in bindings.EDITED.items():
        for plain in (old.format(**t), old):
            out = out.replace(f"({plain})", f"({new.format(**t)})", 1) if f"({plain})" in out and f"({new.format(**t)})" not in out else out
    return out


def _grams(x: str) -> str:
    return f"list_distinct(list_transform(range(length({x}) + 2), lambda i: substr('  ' || {x} || '  ', i + 1, 3)))"


def _dice(a: str, b: str) -> str:
    return f"2.0 * len(list_intersect({_grams(a)}, {_grams(b)})) / (len({_grams(a)}) + len({_grams(b)}))"


#: Names are two words and no product's own name or synonym, so every candidate is fuzzy.
_MAP_PRODUCT = f"""
WITH prod AS ({bindings.PRODUCTS}), n AS (SELECT DISTINCT p_name AS mention FROM part), x AS (SELECT mention, id, canonical_name, canonical_name || 's' AS syn FROM n, prod),
y AS (SELECT mention, id, canonical_name, round_even(greatest({_dice('mention', 'canonical_name')}, {_dice('mention', 'syn')}, CASE WHEN list_contains(string_split(mention, ' '), syn) THEN 0.5 ELSE 0 END), 3) AS score FROM x),
z AS (SELECT mention, arg_min(id, (-score, id)) AS id, arg_min(canonical_name, (-score, id)) AS name, max(score) AS score, count(*) AS n FROM y WHERE score >= 0.4 GROUP BY 1)
SELECT mention, CASE WHEN score >= 0.75 THEN id END AS product_id, CASE WHEN score >= 0.75 THEN name END AS canonical_name, CAST(coalesce(score, 0) AS DOUBLE) AS confidence, CASE WHEN score >= 0.75 THEN 'FUZZY' ELSE 'UNMAPPED' END AS method,
 NOT coalesce(score >= 0.75, false) AS is_unmapped, coalesce(z.n, 0) AS n_candidates FROM n LEFT JOIN z USING (mention)
"""


#: All pairs of mentions and terms with every kind of score; a mention is lower-cased, without its leading quantity.
_MAP_HITS = f"""
WITH prod AS (SELECT id, canonical_name, [canonical_name || 's'] AS syns FROM ({bindings.PRODUCTS}) UNION ALL SELECT 8, 'cross', ['x', 'x y', 'xx']), n AS ({_MENTIONS.format(part='part')}),
q AS (SELECT mention, regexp_replace(lower(mention), '^[0-9]+ ', '') AS q FROM n), p AS (SELECT id, canonical_name, unnest(syns) AS syn, unnest(range(len(syns))) AS position FROM prod),
y AS (SELECT mention, q, id, syn, position, canonical_name, {_dice('q', 'canonical_name')} AS d0, {_dice('q', 'syn')} AS d1,
 len(list_intersect(regexp_extract_all(q, '[a-z0-9]+'), string_split(syn, ' '))) / len(list_distinct(list_concat(regexp_extract_all(q, '[a-z0-9]+'), string_split(syn, ' ')))) AS j,
 CASE WHEN q = syn THEN 0.98 WHEN length(syn) >= 3 AND regexp_matches(q, '(^|[^a-z0-9])' || syn || '($|[^a-z0-9])') THEN 0.92 WHEN length(syn) < 3 AND contains(syn, q) AND j >= 0.5 THEN 0.88 END AS hit FROM q, p),
s AS (SELECT mention, id, bool_or(q = canonical_name) AS exact, arg_min(hit, position) FILTER (hit IS NOT NULL) AS hit, max(greatest(d0, d1, j)) AS fuzzy FROM y GROUP BY 1, 2),
z AS (SELECT mention, id, CASE WHEN exact THEN 1.0 WHEN hit IS NOT NULL THEN hit WHEN fuzzy >= 0.4 THEN round_even(fuzzy, 3) END AS score, CASE WHEN exact THEN 'EXACT' WHEN hit IS NOT NULL THEN 'SYNONYM' ELSE 'FUZZY' END AS method FROM s),
b AS (SELECT * FROM z WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY mention ORDER BY score DESC, id) = 1)
SELECT mention, CAST(CASE WHEN score >= 0.75 THEN id END AS INT) AS product_id, CAST(coalesce(score, 0) AS DOUBLE) AS confidence, CASE WHEN score >= 0.75 THEN method ELSE 'UNMAPPED' END AS method FROM n LEFT JOIN b USING (mention)
"""


def oracle() -> dict[str, str]:
    own, many = _branches("l_orderkey"), _branches(MANY)
    out = {q: (many if q.startswith("rule_r11") else own)[q[5:8].upper()] for q in QUERIES if q.startswith("rule_r")}
    v, m = _views(), _views(MANY)
    noun = f"SELECT DISTINCT p_name AS mention, {bindings.NOUN} NOT IN (SELECT canonical_name FROM ({bindings.PRODUCTS})) AS expected_unmapped FROM part"
    cases = f"SELECT mention, expected_unmapped, is_unmapped, CASE WHEN is_unmapped = expected_unmapped THEN 'PASS' ELSE 'FAIL' END AS status FROM ({noun}) JOIN ({_MAP_PRODUCT}) USING (mention)"
    four = "doc_id, clause_id, rule_id, row_id"
    struck = _every("l_orderkey", ("R02", "R04", "R05"))  # no year, no finding of R03
    return out | {
        "finding_filter": f"{m} SELECT doc_id, clause_id, rule_id, severity, message_en, row_id, url, verified_on FROM ({_every()}) WHERE severity = 'ERROR'",
        "mapping_eval": cases,
        "mapping_summary": f"SELECT count(*) AS total, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (expected_unmapped) AS total_unmapped, count(*) FILTER (expected_unmapped AND is_unmapped) AS unmapped_correct, count(*) FILTER (expected_unmapped) = count(*) FILTER (expected_unmapped AND is_unmapped) AS gate FROM ({cases})",
        "edited_clauses": f"{v}, ed AS (SELECT doc_id, clause_id FROM cl WHERE part_key % 5 = 0) SELECT {four} FROM ({_every('l_orderkey', ('R02', 'R03', 'R04', 'R05'))}) ANTI JOIN ed USING (doc_id, clause_id) UNION ALL SELECT {four} FROM ({struck}) SEMI JOIN ed USING (doc_id, clause_id)",
        "incremental_audit": f"{_edited_views(MANY)} SELECT {', '.join(FLAT)} FROM ({_every()})",
        "rules_as_data": f"""{m}, dates AS ({_DATES.format(orders='orders')}), fnd AS (SELECT x.*, coalesce(audit_date, DATE '2026-01-01') AS d FROM ({_every(MANY, ('R03', 'R04', 'R08', 'R09'))}) x LEFT JOIN dates USING (doc_id)),
 w AS (SELECT *, (rule_id = 'R03' AND d >= DATE '2025-05-01') OR (rule_id = 'R09' AND d >= DATE '2025-03-01') AS changed FROM fnd WHERE NOT (rule_id = 'R08' AND d >= DATE '2025-04-01') AND NOT (rule_id = 'R09' AND d >= DATE '2025-06-01'))
 SELECT doc_id, clause_id, rule_id, CASE WHEN NOT changed OR severity = 'CANNOT_VERIFY' THEN severity WHEN rule_id = 'R03' THEN 'ERROR' ELSE 'WARNING' END AS severity,
  CASE WHEN NOT changed THEN message_en WHEN rule_id = 'R03' THEN regexp_replace(message_en, '^The clause cites (\\d+)[.] The catalogue shows (\\d+) .*$', 'Cited \\1, listed \\2.') ELSE 'See {{nothing}}: {{explanation}}' END AS message_en, CASE WHEN changed THEN '2' ELSE '0.1.0' END AS rule_set_version FROM w""".replace("{{", "{").replace("}}", "}"),
        "extractor_hook": f"""{v} SELECT doc_id, clause_id, CASE WHEN g THEN 'RegexFallback' ELSE 'primary' END AS provider, NOT g AND (part_key % 2 = 0 OR text IN (SELECT text FROM cl WHERE part_key % 2 = 0)) AS cached, CASE WHEN g THEN 'ValueError' END AS error, NOT g AND iec AS extraction_uncertain,
 CAST(raw <> '' AND (g OR NOT iec) AS INT) AS n_citations, CASE WHEN raw <> '' AND (g OR NOT iec) THEN concat('IS', CASE WHEN iec THEN '/IEC' ELSE '' END, ' ', num) END AS is_number, CASE WHEN raw <> '' AND (g OR NOT iec) THEN CAST(strpos(text, raw) - 1 AS INT) END AS span_start
 FROM (SELECT doc_id, clause_id, part_key, text, raw, g.num AS num, contains(text, 'IS/IEC') AS iec, contains(text, 'gizmo') AS g FROM m)""",
        "stream_pages_audit": f"{m} SELECT {', '.join(FLAT)} FROM ({_every()})",
        "extract_citations": f"{v} SELECT doc_id, clause_id, 0 AS cit_no, raw, span_start, span_end, is_number, part, year FROM cite",
        "resolve_standard": f"{v} SELECT doc_id, clause_id, is_number, is_number AS base_number, sid AS standard_id, snum AS resolved_number FROM res",
        "resolve_standard_strict": f"{v} SELECT c.doc_id, c.clause_id, c.is_number, c.is_number AS base_number, s.id AS standard_id, s.is_number AS resolved_number FROM cite c LEFT JOIN std s ON s.is_number = c.is_number",
        "suggest_near": f"{v} SELECT n.is_number, s.is_number AS candidate, min(s.id) AS catalogue_id FROM (SELECT DISTINCT is_number FROM res WHERE sid IS NULL) n JOIN std s ON levenshtein(n.is_number, s.is_number) = 1 OR levenshtein(n.is_number, regexp_replace(s.is_number, ' \\(Part \\d+\\)', '')) = 1 GROUP BY ALL",
        "match_vague_terms": f"{v} SELECT doc_id, clause_id, id AS term_id, substr(text, strpos(lower(text), lower(term)), length(term)) AS phrase, CAST(strpos(lower(text), lower(term)) - 1 AS INT) AS span_start, CAST(strpos(lower(text), lower(term)) - 1 + length(term) AS INT) AS span_end FROM cl JOIN vague ON contains(lower(text), lower(term))",
        "match_many_terms": f"{v}, terms AS ({_TERMS.format(part='part')}) SELECT doc_id, clause_id, id AS term_id, substr(text, strpos(lower(text), lower(term)), length(term)) AS phrase, CAST(strpos(lower(text), lower(term)) - 1 AS INT) AS span_start, CAST(strpos(lower(text), lower(term)) - 1 + length(term) AS INT) AS span_end FROM cl JOIN terms ON contains(lower(text), lower(term))",
        "term_classes": f"SELECT id AS term_id, min(id) OVER (PARTITION BY lower(term), length(term)) AS class_id FROM ({_TERMS.format(part='part')}) t",
        "map_product": _MAP_PRODUCT,
        "map_product_hits": _MAP_HITS,
        "override_mapping": f"SELECT mention, CASE split_part(mention, ' ', 2) WHEN 'gear' THEN 1 WHEN 'anvil' THEN NULL ELSE product_id END AS product_id, CASE split_part(mention, ' ', 2) WHEN 'gear' THEN 'ring' WHEN 'anvil' THEN 'own name' ELSE canonical_name END AS canonical_name, CASE WHEN split_part(mention, ' ', 2) IN ('gear', 'anvil') THEN 1.0 ELSE confidence END AS confidence, CASE WHEN split_part(mention, ' ', 2) IN ('gear', 'anvil') THEN 'OFFICER_OVERRIDE' ELSE method END AS method, is_unmapped AND split_part(mention, ' ', 2) NOT IN ('gear', 'anvil') AS is_unmapped, CASE WHEN split_part(mention, ' ', 2) IN ('gear', 'anvil') THEN 0 ELSE n_candidates END AS n_candidates FROM ({_MAP_PRODUCT})",
        "resolve_product": f"{v} SELECT p_partkey, {bindings.NOUN} AS text, coalesce(k.id, p.id) AS product_id, coalesce(k.family, p.family) AS family FROM part LEFT JOIN prod k ON p_partkey % 4 = 0 AND k.canonical_name = 'ring' LEFT JOIN prod p ON p.canonical_name = {bindings.NOUN}",
        "used_rows": f"{v} SELECT * FROM {_USED}",
        "evaluate_documents": _all(MANY), "evaluate_clauses": _all("l_orderkey", ("R11",)).replace("x.doc_id = r.doc_id AND x.is_number IN", "x.doc_id = r.doc_id AND x.clause_id = r.clause_id AND x.is_number IN"),
        "cited_number_set": f"{v} SELECT DISTINCT doc_id, is_number AS number FROM cite",
        "severity_counts": f"{m} SELECT doc_id, count(*) FILTER (severity = 'ERROR') AS error, count(*) FILTER (severity = 'WARNING') AS warning, count(*) FILTER (severity = 'INFO') AS info, count(*) FILTER (severity = 'CANNOT_VERIFY') AS cannot_verify FROM ({_every()}) GROUP BY 1",
        "audit_summary": f"{m} SELECT doc_id, total_clauses, coalesce(total_findings, 0) AS total_findings FROM (SELECT doc_id, count(*) AS total_clauses FROM cl GROUP BY 1) LEFT JOIN (SELECT doc_id, count(*) AS total_findings FROM ({_every()}) GROUP BY 1) USING (doc_id)",
        "fired_rules": f"{m} SELECT doc_id AS case_id, string_agg(DISTINCT rule_id, ';' ORDER BY rule_id) AS got FROM ({_every()}) WHERE rule_id <> 'R14' GROUP BY 1",
        "eval_evidence_completeness": f"{m} SELECT count(*) FILTER (url IS NOT NULL OR verified_on IS NOT NULL) AS complete, count(*) AS total FROM ({_every()}) WHERE rule_id IN ('R02', 'R03', 'R04', 'R05', 'R06', 'R07', 'R08', 'R13')",
        "clause_diff": f"{v}, {_A}, {_CDIFF} SELECT * FROM cd", "finding_diff": f"{v}, {_A}, {_FDIFF} SELECT * FROM fd",
        "diff_summary": f"{v}, {_A}, {_CDIFF}, {_FDIFF} SELECT (SELECT count(*) FILTER (change = 'added') FROM cd) AS added_clauses, (SELECT count(*) FILTER (change = 'removed') FROM cd) AS removed_clauses, (SELECT count(*) FILTER (change = 'modified') FROM cd) AS modified_clauses, (SELECT count(*) FILTER (change = 'unchanged') FROM cd) AS unchanged_clauses, (SELECT count(*) FILTER (change = 'added') FROM fd) AS added_findings, (SELECT count(*) FILTER (change = 'resolved') FROM fd) AS resolved_findings, (SELECT count(*) FILTER (change = 'retained') FROM fd) AS retained_findings, (SELECT count(*) FROM fa) AS total_a, (SELECT count(*) FROM fb) AS total_b",
    }

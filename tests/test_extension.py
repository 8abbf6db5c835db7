"""Rules as data, and extractors through the hook."""

import dataclasses
import datetime

from pyspark.sql import functions as F
from test_incremental import extract, frame
from test_rules import CASES, reference

from clauseaudit.functions.text import cache_key
from clauseaudit.operators import catalogue, extractor, rules
from clauseaudit.operators.extract import fallback_chain, with_fallback
from clauseaudit.operators.extractor import CannedExtractor, PatternExtractor, cacheable, extract_with, run_extractor
from clauseaudit.sources.reference import rule_catalogue

VERSION = "rule_id string, enabled boolean, severity string, message_en string, message_hi string, rule_set_version string, valid_from date, valid_to date"


def day(n):
    return datetime.date(2026, 1, n)


def test_fixed_catalogue_changes_nothing(spark):
    c = frame(spark, CASES)
    f = rules.build_facts(c.select("doc_id", "clause_id", "ordinal", "text"), *extract(c), reference(spark))
    plain = rules.evaluate_documents(f)
    under = rules.evaluate_documents(dataclasses.replace(f, catalogue=rule_catalogue(spark)))
    assert plain.columns == under.columns and plain.count() > 0
    rows = lambda x: sorted(map(str, x.collect()))
    assert rows(plain) == rows(under)
    off = rule_catalogue(spark).withColumn("enabled", F.col("rule_id") != "R01").withColumn("severity", F.when(F.col("rule_id") == "R12", "ERROR").otherwise(F.col("severity")))
    changed = rules.evaluate_documents(dataclasses.replace(f, catalogue=off))
    assert plain.where("rule_id = 'R01'").count() > 0 and changed.where("rule_id = 'R01'").count() == 0
    assert {r.severity for r in changed.where("rule_id = 'R12'").collect()} == {"ERROR"}


def test_versions_by_date(spark):
    v = [
        ("R1", True, "INFO", "old {a}", None, "1", None, None), ("R1", True, "ERROR", "new {a}{b}", "{b} है", "2", day(10), day(20)), ("R1", True, "INFO", "tie", None, "0", day(10), None),
        ("R2", True, "INFO", "x", None, "1", day(5), None), ("R2", False, "INFO", "x", None, "2", day(8), None), ("R3", True, "INFO", "has {nothing}", None, "1", None, None),
    ]
    rows = [("d1", "R1"), ("d12", "R1"), ("d25", "R1"), ("d1", "R2"), ("d6", "R2"), ("d9", "R2"), ("none", "R3"), ("d1", "R9")]
    x = spark.createDataFrame([(r, d, "c") for d, r in rows], "rule_id string, doc_id string, clause_id string")
    x = x.withColumns({"finding_id": F.lit("f"), "severity": F.lit("INFO"), "span_start": F.lit(0), "message_en": F.lit("m"), "message_hi": F.lit(None).cast("string"), "rule_set_version": F.lit("0"), "evidence": F.struct(F.lit(1).alias("row_id"))})
    x = x.withColumns({"_params": F.create_map(F.lit("a"), F.lit("{b}$1"), F.lit("b"), F.lit("B")), "_conflict": F.col("doc_id") == "none"})
    dates = spark.createDataFrame([(d, day(int(d[1:]))) for d in ("d1", "d6", "d9", "d12", "d25")] + [("d12", day(30))], "doc_id string, audit_date date")
    got = catalogue.apply_catalogue(x, spark.createDataFrame(v, VERSION), day(28), dates).collect()
    assert sorted((r.doc_id, r.rule_id, r.severity, r.message_en, r.message_hi) for r in got) == [
        ("d1", "R1", "INFO", "old {b}$1", None), ("d12", "R1", "ERROR", "new {b}$1B", "B है"), ("d6", "R2", "INFO", "x", None), ("none", "R3", "CANNOT_VERIFY", "has {nothing}", None),
    ]


def test_extractor_rows_fail_alone(spark):
    known = {"to IS 12": {"citations": [{"raw": "IS 12", "span_start": 3, "span_end": 8, "is_number": "IS 12"}, {"raw": "IS 13", "span_start": 0, "span_end": 5, "is_number": "IS 13"}]}, "odd": {"citations": "no list"}, "": {}}
    c = spark.createDataFrame([(1, "to IS 12"), (2, "unknown"), (3, "odd"), (4, None), (5, "to IS 12")], "id int, text string")
    got = {r.id: r for r in run_extractor(c, CannedExtractor(known)).collect()}
    assert [got[i].error and got[i].error.split(":")[0] for i in range(1, 6)] == [None, "KeyError", "ArrowTypeError" if "ArrowTypeError" in (got[3].error or "") else got[3].error.split(":")[0], None, None]
    assert len(got[1].citations) == 2 and got[2].citations == [] and got[3].citations == [] and got[4].citations == []
    checked = {r.id: r for r in extract_with(c, CannedExtractor(known)).collect()}
    assert len(checked[1].citations) == 1 and checked[1].dropped == 1 and checked[1].invented == 1 and len(checked) == 5
    assert run_extractor(c.where("id < 0"), CannedExtractor(known)).count() == 0


def test_cache_spares_the_extractor(spark):
    """A cached clause is not extracted again, errors are not cached, and spans are checked against the clause's own text."""
    c = spark.createDataFrame([(1, "to IS 12"), (2, "  to IS 12"), (3, "to IS 77: 2010")], "id int, text string")
    reader = PatternExtractor(r"IS (?P<number>\d+)(?:: (?P<year>\d{4}))?", model_id="canned-1")
    cache = cacheable(extract_with(c.where("id = 1"), reader))
    assert cache.count() == 1 and cache.first().key == c.where("id = 1").select(cache_key(F.col("text"), F.lit("1"), F.lit("canned-1"))).first()[0]
    got = {r.id: r for r in extract_with(c, CannedExtractor({}), cache).collect()}  # knows no clause: what it is asked is an error
    assert [got[i].cached for i in (1, 2, 3)] == [True, True, False] and got[3].error.startswith("KeyError")
    assert len(got[1].citations) == 1 and got[2].citations == [] and got[2].dropped == 1  # another text, another place
    assert [x.year for x in extract_with(c, reader).where("id = 3").first().citations] == [2010]
    assert cacheable(extract_with(c, CannedExtractor({}), cache)).count() == 0


def failing():
    """An extractor that fails on batches with a clause that has an x; made here, so that it is pickled whole."""

    class Failing(PatternExtractor):
        def extract(self, clauses, language_hints):
            if any("x" in c for c in clauses):
                raise ValueError("x")
            return [{"citations": [self._item(m) for m in self.pattern.finditer(c)]} for c in clauses]

    return Failing(r"IS (?P<number>\d+)")


def test_failed_rows_of_a_batch_make_columns_once(monkeypatch):
    reader, made = failing(), []
    plain = extractor._columns
    monkeypatch.setattr(extractor, "_columns", lambda results: made.append(len(results)) or plain(results))
    texts = [f"IS {i}" + " x" * (i % 8 == 0) for i in range(400)]
    got = extractor._results(reader, texts, [None] * 400)
    assert made == [400] and [len(c) for c in got[1].to_pylist()] == [int(i % 8 > 0) for i in range(400)] and got[4].to_pylist() == [None if i % 8 else "ValueError: x" for i in range(400)]


def test_keys_of_the_cache_and_fallback_without_a_join(spark):
    c = spark.createDataFrame([(1, "to IS 12 and IS 13"), (2, "IS 14 x"), (3, "to IS 12 and IS 13"), (4, None), (5, "none")], "id int, text string")
    reader = failing()
    rows = lambda x: sorted(map(str, x.collect()))
    keys, got = extractor.extract_keys(c, reader), extract_with(c, reader)
    assert rows(keys) == rows(cacheable(got).select(keys.columns)) and keys.count() == 3
    found = got.where("error is null").select("key", "citations").dropDuplicates(["key"])
    want = fallback_chain(got.select("id", "text", "key", "error"), found, found.where("false"))
    x = with_fallback(got)
    fields = ["id", "provider", "reduced_mode", "citations", "_regex"]
    assert rows(x.select(fields)) == rows(want.select(fields)) and "Join" in want._jdf.queryExecution().optimizedPlan().toString()


def test_extractor_shuffles_bytes_of_keys(spark, tmp_path):
    """Keys are hex outside and 32 bytes in every shuffle, and what is written on the way changes no row."""
    from clauseaudit.operators.extractor import PatternExtractor, extract_keys, extract_with

    reader = PatternExtractor(r"IS (?P<number>\d+)")
    c = spark.createDataFrame([(i, f"IS {i % 7}0 and more") for i in range(40)] + [(40, None)], "doc_id int, text string")
    cache = extract_keys(c.where("doc_id % 7 = 3"), reader)
    own, written = extract_with(c, reader, cache), extract_with(c, reader, cache, folder=str(tmp_path))
    rows = lambda x: sorted(map(str, x.collect()))
    assert rows(own) == rows(written) and own.where("cached").count() == 6 and own.where("length(key) <> 64 or key <> lower(key)").count() == 0
    assert spark.read.parquet(f"{tmp_path}/made").count() == 7 and spark.read.parquet(f"{tmp_path}/made").where("octet_length(key) = 32").count() == 7

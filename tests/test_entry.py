"""Registered queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
SAMPLE = ("rule_r04_part_mismatch", "rule_r08_allied_absent", "rule_r11_contradiction", "resolve_standard", "clause_diff", "segment_clauses", "mention_similarity", "provenance_check", "needed_cells", "prohibited_text_scan", "apply_decisions", "row_change_log", "regression_gate", "latency_percentiles")


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
        return "-"
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else f"{v:.9g}"
    return str(v).removesuffix(" 00:00:00")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_and_sql(spark, db, name):
    a, b = __spark_entry__.queries()[name](spark, SF).toPandas(), db.sql(__spark_entry__.oracle_sql()[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    rows = lambda d: sorted(tuple(plain(v) for v in r) for r in d[cols].astype(object).itertuples(index=False))
    assert rows(a) == rows(b)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_json_reports_have_findings_of_all_rules(spark, db):
    """Findings in the reports, counted by rule, against the SQL of the rules."""
    import json
    from collections import Counter

    reports = [json.loads(r.report) for r in __spark_entry__.queries()["sink_json_report"](spark, SF).collect()]
    got = Counter(f["rule_id"] for r in reports for f in r["findings"])
    sql = __spark_entry__.oracle_sql()
    for rule, name in (("R01", "rule_r01_unknown_citation"), ("R02", "rule_r02_withdrawn"), ("R07", "rule_r07_no_standard_cited"), ("R09", "rule_r09_vague_wording"), ("R13", "rule_r13_wrong_family"), ("R14", "rule_r14_stale_row")):
        assert got[rule] == db.sql(f"select count(*) from ({sql[name]})").fetchall()[0][0] > 0


def test_snapshot_of_four_levels_and_sql(spark, monkeypatch):
    """Tables with more rows than three levels hold: leaves of one row stand for large tables."""
    from clauseaudit.plans import data_queries
    from clauseaudit.sources import io

    monkeypatch.setattr(io, "LEAF", 1)
    own = data_queries.snapshot_manifest(spark, sf := "/root/testdata/sf0.01").collect()
    c = duckdb.connect()
    for t in data_queries._SNAP:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet{'/*' if os.path.isdir(f'{sf}/{t}.parquet') else ''}'")
    assert c.sql("select count(*) > 16 ** 3 from orders").fetchall() == [(True,)]
    assert sorted((r.table_name, r.n, r.checksum) for r in own) == sorted(c.sql(data_queries._snapshot_sql(leaf=1)).fetchall())


def test_clauses_of_a_product_stay_in_their_tasks(spark):
    """The reference rows of R07 come to the clauses, whatever their estimated size."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = __spark_entry__.queries()["rule_r07_no_standard_cited"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin [product_id#" in plan and "SortMergeJoin [product_id#" not in plan


def test_many_terms_has_a_row_for_each_term(spark, tmp_path):
    """Copies of a name are terms of their own, as in the SQL."""
    c = duckdb.connect()
    c.sql(f"create table part as select * replace (p_partkey + 1000 * i as p_partkey) from '{SF}/part.parquet', range(2) r(i)")
    c.sql("alter table part drop i")
    c.sql(f"create view lineitem as select * from '{SF}/lineitem.parquet'")
    for t in ("part", "lineitem"):
        c.sql(f"copy {t} to '{tmp_path}/{t}.parquet'")
    got = __spark_entry__.queries()["match_many_terms"](spark, str(tmp_path)).toPandas()
    want = c.sql(__spark_entry__.oracle_sql()["match_many_terms"]).df()
    rows = lambda d: sorted(map(tuple, d[sorted(got.columns)].astype(str).itertuples(index=False)))
    assert rows(got) == rows(want) and got.duplicated(["doc_id", "clause_id", "phrase"]).any()


def test_long_texts_of_r07_are_written_once(spark, tmp_path):
    """A product of many standards has a long text, which a file holds once and not with each finding."""
    c = duckdb.connect()
    c.sql(f"create table part as select p_partkey + 200 * i as p_partkey, p_name, p_size from '{SF}/part.parquet', range(1500) r(i)")
    c.sql(f"create view lineitem as select * from '{SF}/lineitem.parquet'")
    for t in ("part", "lineitem"):
        c.sql(f"copy {t} to '{tmp_path}/{t}.parquet'")
    spark.conf.unset("parquet.dictionary.page.size")
    __spark_entry__.queries()["rule_r07_no_standard_cited"](spark, str(tmp_path)).coalesce(4).write.parquet(f"{tmp_path}/out")
    digest = "count(*), count(distinct md5(message_en)), sum(length(message_en)), max(length(message_en)), bit_xor(hash(doc_id, clause_id, md5(message_en), row_id, url, verified_on))"
    got = c.sql(f"select {digest} from '{tmp_path}/out/*.parquet'").fetchall()
    assert got == c.sql(f"select {digest} from ({__spark_entry__.oracle_sql()['rule_r07_no_standard_cited']})").fetchall()
    size = sum(os.path.getsize(p) for p in glob.glob(f"{tmp_path}/out/*.parquet"))
    assert got[0][2] > 60_000_000 and size < got[0][2] / 10
    spark.conf.unset("parquet.dictionary.page.size")


def test_incremental_audit_has_room_for_long_texts(spark, tmp_path, monkeypatch):
    """Its findings are written with the texts of R07 as a dictionary; the audit itself plays no part here."""
    from types import SimpleNamespace

    from clauseaudit.plans import rule_queries

    c = duckdb.connect()
    c.sql(f"copy (select p_partkey + 200 * i as p_partkey, p_name, p_size from '{SF}/part.parquet', range(1500) r(i)) to '{tmp_path}/part.parquet'")
    c.sql(f"copy (select * from '{SF}/lineitem.parquet') to '{tmp_path}/lineitem.parquet'")
    monkeypatch.setattr(rule_queries, "flat", lambda x: x)
    monkeypatch.setattr(rule_queries.incremental, "audit", lambda *a: None)
    monkeypatch.setattr(rule_queries.incremental, "update", lambda *a: SimpleNamespace(findings=None))
    spark.conf.unset("parquet.dictionary.page.size")
    rule_queries.incremental_audit_q(spark, str(tmp_path))
    assert int(spark.conf.get("parquet.dictionary.page.size", "0")) > 1 << 20
    spark.conf.unset("parquet.dictionary.page.size")

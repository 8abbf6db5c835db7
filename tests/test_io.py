"""Uploads, snapshots, reference files and the stream."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from clauseaudit.operators.extract import extract_citations
from clauseaudit.operators.segment import segment_clauses
from clauseaudit.sources import io
from clauseaudit.sources.reference import load_reference_tables, rule_catalogue
from clauseaudit.streaming.intake import stream_audit, stream_pages


def test_upload_gate(spark):
    files = {"a.txt": b"ok", "b.txt": b"a\x00b", "c.txt": b"", "d.pdf": b"%PDF-1", "e.pdf": b"x", "f.docx": b"PK\x03\x04", "g.exe": b"x", "h.txt": b"MZ", "i.TXT": b"#!/bin/sh"}
    x = io.upload_safety_gate(spark.createDataFrame(list(files.items()), "path string, content binary"))
    assert {r.path: r.reject_reason for r in x.collect()} == {"a.txt": None, "b.txt": "NUL in text", "c.txt": "empty", "d.pdf": None, "e.pdf": "no PDF header", "f.docx": None, "g.exe": "suffix not allowed", "h.txt": "program", "i.TXT": "program"}


def test_scans(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("one\n\nzwei ü".encode())
    (tmp_path / "b.pdf").write_bytes(b"%PDF-")
    got = {r.path.rpartition("/")[2]: r for r in io.scan_binary_corpus(spark, str(tmp_path)).collect()}
    assert got["a.txt"].text == "one\n\nzwei ü" and got["b.pdf"].quarantined
    assert segment_clauses(io.scan_text_corpus(spark, str(tmp_path / "a.txt"))).count() == 2


def test_snapshot(spark, tmp_path):
    t = {"a": spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")}
    io.snapshot_tables(t, str(tmp_path))
    assert io.verify_snapshot(spark, str(tmp_path)).count() == 0
    left = {"a": spark.createDataFrame([(2, "kept")], "id int, v string")}
    assert sorted(map(tuple, io.restore_snapshot(spark, str(tmp_path), left, {"a": ["id"]})["a"].collect())) == [(1, "x"), (2, "kept")]
    spark.createDataFrame([(3, "z")], "id int, v string").write.mode("append").parquet(str(tmp_path / "a"))
    with pytest.raises(ValueError):
        io.restore_snapshot(spark, str(tmp_path), left, {"a": ["id"]})


def _write(folder, bad=False):
    common = "verified_on,verified_by,second_checked_by,evidence_ref"
    row = "2026-01-01,asha,ben,rec"
    (folder / "standards.csv").write_text(f"is_number,title,publication_year,status,superseded_by,catalogue_url,{common}\nIS 1,a,2010,Active,IS 2,https://x,{row}\nIS 2,b,,Active,,{'http' if bad else 'https'}://x,{row}\nIS 1,again,2011,Active,,https://x,{row}\n")
    (folder / "products.csv").write_text('canonical_name,family,synonyms_en,synonyms_hi\nRing,f,"[""rings""]",[]\n')
    (folder / "product_standard_map.csv").write_text(f"product,is_number,relation,source_url,{common}\nRing,IS 1,PRIMARY,https://x,{row}\nBolt,IS 1,PRIMARY,https://x,{row}\n")
    (folder / "certification_rules.csv").write_text(f"product,scheme,specified_is_number,instrument,source_url,{common}\nRing,CRS,IS 1,Order,https://x,{row}\n")
    (folder / "allied_links.csv").write_text(f"from_is_number,to_is_number,relation,source_url,{common}\nIS 1,IS 2,NORMATIVE,https://x,{row}\n")


def test_reference_files(spark, tmp_path):
    _write(tmp_path)
    t = load_reference_tables(spark, str(tmp_path))
    assert {n: t[n].count() for n in t} == {"standards": 2, "products": 1, "product_standard_map": 1, "certification_rules": 1, "allied_links": 1, "quarantine": 0}
    assert t["standards"].where("is_number = 'IS 1'").first().title == "a"
    _write(tmp_path, bad=True)
    with pytest.raises(ValueError, match="https"):
        load_reference_tables(spark, str(tmp_path))
    assert load_reference_tables(spark, str(tmp_path), strict=False)["quarantine"].count() == 1
    assert rule_catalogue(spark).count() == 14


def test_reference_folders(spark, tmp_path):
    """Tables of several files: places in each file, dense ids over all, the first row of a key by file and line."""
    _write(tmp_path)
    (tmp_path / "standards.csv").unlink()
    (tmp_path / "standards.csv").mkdir()
    head = "is_number,title,publication_year,status,superseded_by,catalogue_url,verified_on,verified_by,second_checked_by,evidence_ref\n"
    line = lambda n, title, url="https://x": f'IS {n},"{title}",2010,Active,,{url},2026-01-01,asha,ben,rec\n'
    (tmp_path / "standards.csv" / "b.csv").write_text(head + line(5, "b5") + line(1, "b1") + line(9, "b9", "http://x"))
    (tmp_path / "standards.csv" / "a.csv").write_text(head + line(1, "two\nlines") + line(8, "bad", "http://x") + line(2, "a2") + line(1, "again"))
    t = load_reference_tables(spark, str(tmp_path), strict=False)
    assert sorted((r.id, r.is_number, r.title, r.file, r.line_no) for r in t["standards"].collect()) == [(1, "IS 1", "two\nlines", "a.csv", 2), (2, "IS 2", "a2", "a.csv", 4), (3, "IS 5", "b5", "b.csv", 2)]
    assert sorted((r.file, r.line_no) for r in t["quarantine"].collect()) == [("a.csv", 3), ("b.csv", 4)]
    assert t["allied_links"].select("source_standard_id", "target_standard_id").collect() == [(1, 2)]
    with pytest.raises(ValueError, match="standards line 3"):
        load_reference_tables(spark, str(tmp_path))


def test_pages_become_documents(spark, tmp_path):
    """Pages out of order, repeated and late; a document that never is complete; a restart; findings of all rules, once."""
    from test_rules import reference

    schema = "doc_id string, page_number int, page_count int, text string, intake_ts timestamp"
    at = lambda hour: datetime.datetime(2026, 1, 1) + datetime.timedelta(hours=hour)
    one, two = "Pumps conforming to IS 999: 2010.", "Pumps conforming to IS 999: 2015."

    def put(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def extract(batch):
        x = batch.select("doc_id", F.concat(F.lit("p"), F.col("page_number").cast("string")).alias("clause_id"), F.col("page_number").alias("ordinal"), "text", "complete")
        mentions = spark.createDataFrame([], "doc_id string, clause_id string, pos int, text string, span_start int, span_end int, canonical_product_id string")
        seen.extend((r.doc_id, r.clause_id, r.complete) for r in x.collect())
        return x, extract_citations(x.select("doc_id", "clause_id", "ordinal", "text")), mentions

    seen = []
    run = lambda: stream_pages(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, extract, lambda: reference(spark), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    put(("d", 2, 2, two, at(0)), ("e", 1, 3, one, at(0)), (None, 1, 1, one, at(0)))
    run()
    assert seen == []
    put(("d", 1, 2, one, at(0.5)), ("d", 1, 2, "other", at(0.5)), ("e", 3, 3, None, at(0.5)))
    run()
    assert sorted(seen) == [("d", "p1", True), ("d", "p2", True)]
    put(("d", 1, 2, "again", at(1)), ("f", 1, 1, "as per BIS", at(5)))
    run()
    put(("e", 2, 3, two, at(0.2)), ("g", 1, 1, one, at(9)))  # too late for e
    run()
    assert sorted(seen) == [("d", "p1", True), ("d", "p2", True), ("e", "p1", False), ("e", "p3", False), ("f", "p1", True), ("g", "p1", True)]
    x = spark.read.parquet(str(tmp_path / "out/batch=*"))
    assert x.where("rule_id = 'R11'").select("doc_id").collect() == [("d",)] and x.groupBy("finding_id").count().where("count > 1").count() == 0
    assert {r.doc_id for r in x.where("rule_id = 'R09'").collect()} == {"f"}


def test_stream(spark, tmp_path):
    def put(n, ids):
        rows = [(i, f"clause {i}\n\nsecond", datetime.datetime(2026, 1, 1, 0, n)) for i in ids]
        spark.createDataFrame(rows, "doc_id int, text string, intake_ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    put(0, [1, 2])
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    run = lambda: stream_audit(spark, str(tmp_path / "in"), schema, segment_clauses, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    run()
    put(1, [2, 3])
    run()
    x = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r["count"]) for r in x.groupBy("doc_id").count().collect()) == [(1, 2), (2, 2), (3, 2)]
    batch = segment_clauses(spark.read.parquet(str(tmp_path / "in")).dropDuplicates(["doc_id"]))
    assert x.select("doc_id", "text").exceptAll(batch.select("doc_id", "text")).count() == 0


def test_append_and_reports(spark, tmp_path):
    f = spark.createDataFrame([("d", "c1", "R01", "INFO", None, "m")], "doc_id string, clause_id string, rule_id string, severity string, span_start int, message_en string")
    io.append_audit(f, str(tmp_path / "t"), "2026-01-01")
    io.append_audit(f, str(tmp_path / "t"), "2026-01-02")
    assert io.read_appended(spark, str(tmp_path / "t"), "findings").where("audit_date = '2026-01-02'").count() == 1
    c = spark.createDataFrame([("d", "c1", 1, "text")], "doc_id string, clause_id string, ordinal int, text string")
    r = io.banner_check(io.json_report(c, f)).first()
    assert r.has_banner and '"total_findings":1' in r.report
    a = spark.createDataFrame([("d", 7, "tender.txt", "2026-01-01", "DONE")], "doc_id string, audit_id int, document_name string, created_at string, status string")
    meta = json.loads(io.json_report(c, f, a).first().report)
    assert [meta[k] for k in ("audit_id", "document_name", "created_at", "status")] == [7, "tender.txt", "2026-01-01", "DONE"]
    row = io.csv_report(f.withColumns({"url": F.lit(None).cast("string"), "verified_on": F.lit("x")})).first()
    assert row["Evidence URL"] == "" and list(row.asDict()) == list(io.CSV_COLUMNS)


def test_csv_report_begins_with_the_banner(spark, tmp_path):
    """Every file is a report of its own; a second report takes the place of the first, and one without findings has its head."""
    path, texts = tmp_path / "r", ['a, "b"', "# no comment\nnext", "", "ü"]
    rows = [(i, f"c{i}", texts[i % 4]) for i in range(40)]
    f = spark.createDataFrame(rows, "doc_id int, clause_id string, message_en string").repartition(3)
    for x, mode in ((f.where("doc_id < 0"), "overwrite"), (f, "overwrite"), (f.where("doc_id = 1"), "append")):
        io.write_csv_report(x, str(path), ("doc_id",), mode)
        files = sorted(path.glob("part-*"))
        head = [p.read_text().split("\n")[:2] for p in files]
        assert files and all(h == [f"# {io.BANNER}", ",".join((*io.CSV_COLUMNS, "doc_id"))] for h in head)
        assert sorted(p.name for p in path.iterdir() if p not in files) == ["_SUCCESS"]
    got = io.read_csv_report(spark, str(path), ("doc_id",)).select(F.col("doc_id").cast("int"), "Clause ID", "English Message")
    assert sorted(map(tuple, got.collect())) == sorted([*rows, rows[1]])

    def fail(batches):
        for b in batches:
            raise RuntimeError("lost")
            yield b

    with pytest.raises(Exception, match="lost"):
        io.write_csv_report(f.mapInArrow(fail, f.schema), str(path), ("doc_id",))
    assert io.read_csv_report(spark, str(path), ("doc_id",)).count() == 41 and not list(path.glob("_staged*"))


def test_eval_corpus_round_trip(spark, tmp_path):
    rows = [("1", "en", "clean", 'a, "quoted"\nline', "R01;R02", None), ("2", "hi", "defect", "लैपटॉप", None, "n")]
    io.write_eval_corpus(spark.createDataFrame(rows, "case_id string, language string, kind string, clause string, expected_rules string, notes string"), str(tmp_path / "c"))
    assert sorted(map(tuple, io.scan_eval_corpus(spark, str(tmp_path / "c")).collect())) == rows


def test_audit_and_restore_reports(spark, tmp_path):
    f = spark.createDataFrame([("d", "c1", "R01", "INFO", None, "m")], "doc_id string, clause_id string, rule_id string, severity string, span_start int, message_en string")
    a = spark.createDataFrame([("d", "u", datetime.datetime(2026, 1, 1))], "doc_id string, user_id string, ts timestamp")
    log = io.append_audit(f, str(tmp_path / "f"), "2026-01-01", a, f.select("doc_id", "clause_id")).collect()
    assert [(r.action, r.record_id) for r in log] == [("CREATE_AUDIT", "d")] and io.read_appended(spark, str(tmp_path / "f"), "clauses").count() == 1
    t = spark.range(5)
    io.snapshot_tables({"t": t}, str(tmp_path / "s"), "2")
    assert spark.read.parquet(str(tmp_path / "s/_manifest_rows")).first().app_version == "2"
    assert io.rows_restored(spark, str(tmp_path / "s"), {"t": t.where("id < 3")}, {"t": ["id"]}).first().rows_restored == 2
    files = io.ingest_limits(spark.createDataFrame([("a", 10, 1), ("b", 10, 500)], "doc_id string, n_bytes long, page_count int"))
    assert [tuple(r) for r in io.ingest_errors(files).collect()] == [("b", "too many pages")]


def test_snapshot_tree_names_the_changed_bucket(spark, tmp_path):
    rows = [(i, f"v{i}", None if i % 7 else i / 3) for i in range(3000)] + [(5, "v5", 5.0), (5, "v5", 5.0)]
    x = spark.createDataFrame(rows, "id int, v string, `a.b` double")
    first = io.root(*io.leaves(x)).first()
    assert first == io.root(*io.leaves(x.orderBy(F.desc("id")).repartition(5))).first() and first.n == 3002
    assert io.root(*io.leaves(x.where("not (id = 5 and `a.b` = 5.0)").union(x.where("id = 5 and `a.b` = 5.0").limit(1)))).first() != first  # equal rows count each
    assert io.root(*io.leaves(x.where("false"))).first().n == 0
    assert io.leaves(x)[1] == 1 and io.leaves(spark.range(20_000))[1] == 2
    io.snapshot_tables({"t": x, "u": x}, str(tmp_path))
    assert io.verify_snapshot(spark, str(tmp_path)).count() == 0
    changed = x.withColumn("v", F.when(F.col("id") == 77, "other").otherwise(F.col("v")))
    changed.write.mode("overwrite").parquet(str(tmp_path / "u"))
    (bad,) = io.verify_snapshot(spark, str(tmp_path)).collect()
    trees = [{r.bucket: r.digest for r in io.leaves(t)[0].collect()} for t in (x, changed)]
    assert (bad.table_name, bad.n, bad.n2) == ("u", 3002, 3002) and bad.bucket == min(b for b in trees[0] if trees[0][b] != trees[1][b])


def test_append_is_exactly_once(spark, tmp_path):
    path = str(tmp_path)
    f = spark.createDataFrame([("d", "c1")], "doc_id string, clause_id string")
    a = spark.createDataFrame([("d", "u", datetime.datetime(2026, 1, 1))], "doc_id string, user_id string, ts timestamp")
    io.stage_batch({"findings": f.union(f)}, path, "x", "2026-01-01")  # a run that failed before its commit
    assert io.append_audit(f, path, "2026-01-01", a, batch="x").count() == 1
    assert io.append_audit(f, path, "2026-01-01", a, batch="x").count() == 0  # again: nothing
    io.append_audit(f, path, "2026-01-01", batch="y")
    io.stage_batch({"findings": f}, path, "z", "2026-01-02")
    got = io.read_appended(spark, path, "findings").select("batch_id", F.col("audit_date").cast("string")).collect()
    assert sorted(map(tuple, got)) == [("x", "2026-01-01"), ("y", "2026-01-01")] and io.read_appended(spark, path, "audits").count() == 1


def test_long_texts_of_r07_are_in_a_sink_once(spark, tmp_path):
    """A batch's folder holds a product's text once, however many findings give it."""
    from clauseaudit.sources.reference import empty_reference

    schema = "doc_id string, page_number int, page_count int, text string, intake_ts timestamp"
    spark.createDataFrame([(f"d{i}", 1, 1, "Ten ovens.", datetime.datetime(2026, 1, 1)) for i in range(40)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    standards = spark.range(120_000).select(F.col("id").cast("int"), F.concat(F.lit("IS "), F.col("id") + 1_000_000).alias("is_number"), F.lit(None).cast("string").alias("part"), F.lit(2000).alias("publication_year"), F.lit("Active").alias("status"), F.lit("").alias("catalogue_url"), F.lit(None).cast("date").alias("verified_on"), F.lit(False).alias("is_conflict"))
    maps = standards.select("id", F.lit(1).alias("product_id"), F.col("id").alias("standard_id"), F.lit("").alias("source_url"), "verified_on", "is_conflict")
    products = spark.createDataFrame([(1, "ovens", "kitchen", "[]", "[]")], "id int, canonical_name string, family string, synonyms_en string, synonyms_hi string")

    def extract(batch):
        x = batch.select("doc_id", F.lit("p").alias("clause_id"), F.col("page_number").alias("ordinal"), "text")
        mentions = x.select("doc_id", "clause_id", F.lit(0).alias("pos"), F.lit("ovens").alias("text"), F.lit(4).alias("span_start"), F.lit(9).alias("span_end"), F.lit(None).cast("string").alias("canonical_product_id"))
        return x, extract_citations(x), mentions

    stream_pages(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, extract, lambda: empty_reference(spark, datetime.date(2026, 1, 1), standards=standards, maps=maps, products=products), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out/batch=*")).agg(F.count("*"), F.sum(F.length("message_en")), F.count_distinct("message_en")).first()
    size = sum(p.stat().st_size for p in tmp_path.glob("out/batch=*/*.parquet"))
    assert got[0] == 40 and got[1] > 40 * 1_400_000 and got[2] == 1 and size < got[1] / 10

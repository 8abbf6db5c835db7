"""Registered queries of the text, segmentation, reference-data, review and evaluation operators, with their SQL."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseaudit.functions import text as T
from clauseaudit.operators import evaluate, extract, provenance, review, segment
from clauseaudit.sources import bindings, io
from clauseaudit.sources.scratch import shared_folder

AS_OF = bindings.AS_OF
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its name, with DuckDB SQL that gives the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Texts

_CONV = "SELECT conv_id AS doc_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, role) AS text FROM conversations GROUP BY 1"


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(turns, lambda t: t["text"]), "\n\n").alias("text"))


@query("SELECT conv_id AS doc_id, 'paste_' || row_number() OVER w AS clause_id, CAST(row_number() OVER w AS INT) AS paragraph_index, text, CAST(coalesce(sum(length(text) + 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS start_char, CAST(coalesce(sum(length(text) + 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(text) AS INT) AS end_char, 'en' AS language, 'text' AS source_type FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role)")
def segment_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with a blank line between turns: the clauses are the turns."""
    return segment.segment_clauses(_conversations(spark, sf_dir))


@query("SELECT conv_id AS doc_id, 'pdf_p' || turn || '_1' AS clause_id, CAST(turn AS INT) AS page_number, trim(text, chr(10) || chr(9) || ' ') AS text, CAST(coalesce(sum(length(trim(text, chr(10) || chr(9) || ' ')) + 2) OVER w, 0) AS INT) AS start_char, CAST(coalesce(sum(length(trim(text, chr(10) || chr(9) || ' ')) + 2) OVER w, 0) + length(trim(text, chr(10) || chr(9) || ' ')) AS INT) AS end_char FROM conversations WHERE trim(text, chr(10) || chr(9) || ' ') <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def assemble_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pages."""
    x = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_number"), "text")
    return segment.assemble_pages(x)


@query("SELECT conv_id AS doc_id, string_agg(trim(text, chr(10) || chr(9) || ' '), chr(10) || chr(10) ORDER BY turn) AS full_text FROM conversations WHERE trim(text, chr(10) || chr(9) || ' ') <> '' GROUP BY 1")
def pages_full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.full_text(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_number"), "text"))


@query("WITH x AS (SELECT doc_id, CAST(i AS INT) - 1 AS idx, trim(l, chr(9) || ' ') AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)), y AS (SELECT *, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS start_char FROM x WHERE text <> '') SELECT doc_id, 'docx_p' || idx AS clause_id, idx, text, start_char, CAST(start_char + length(text) AS INT) AS end_char FROM y")
def paragraphs_to_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as paragraphs."""
    x = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("idx", "text"))
    return segment.paragraphs_to_clauses(x)


@query("WITH x AS (SELECT o_custkey AS doc_id, o_orderkey AS row_no, concat_ws(' | ', nullif(o_orderstatus, ''), nullif(trim(o_orderpriority), ''), CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey AS VARCHAR) END) AS text FROM orders) SELECT doc_id, 'docx_t1_r' || row_no AS clause_id, CAST(row_number() OVER w AS INT) AS paragraph_index, text, CAST(coalesce(sum(length(text) + 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS start_char, 'docx_table' AS source_type FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY row_no)")
def flatten_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as rows of a table, some cells blank."""
    cells = F.array("o_orderstatus", "o_orderpriority", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey").cast("string")).otherwise("  "))
    return segment.flatten_table_rows(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.lit(1).alias("table_no"), F.col("o_orderkey").alias("row_no"), cells.alias("cells")))


@query("SELECT doc_id, 'ocr_corrected_1' AS clause_id, 1 AS paragraph_index, 'Corrected ' || (doc_id % 3) AS text, 0 AS start_char, 11 AS end_char, 'en' AS language, 'ocr_verified' AS source_type, 1.0::DOUBLE AS ocr_confidence FROM documents WHERE doc_id % 4 = 0")
def apply_text_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two corrections of every fourth document; the later one counts."""
    d = table(spark, sf_dir, "documents")
    c = d.where("doc_id % 4 = 0").select("doc_id", F.explode(F.array(F.struct(F.lit(1).alias("ts"), F.lit("old").alias("corrected")), F.struct(F.lit(2).alias("ts"), F.concat(F.lit("Corrected "), F.col("doc_id") % 3).alias("corrected")))).alias("c")).select("doc_id", "c.*")
    return segment.apply_text_corrections(d, c)


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '[ऀ-ॿ]') AND regexp_matches(text, '[A-Za-z]') THEN 'mixed' WHEN regexp_matches(text, '[ऀ-ॿ]') THEN 'hi' ELSE 'en' END AS language, CASE WHEN length(text) > 80 THEN substr(text, 1, 77) || '...' ELSE text END AS snippet FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || ' मानक' WHEN doc_id % 3 = 1 THEN 'मानक १२३' ELSE text END AS text FROM documents)")
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, some with Devanagari put in; their language and snippet."""
    text = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" मानक"))).when(F.col("doc_id") % 3 == 1, "मानक १२३").otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text")).select("doc_id", T.detect_language(F.col("text")).alias("language"), T.snippet(F.col("text")).alias("snippet"))


@query("WITH x AS (SELECT p_partkey, translate('IS ' || p_partkey || ' (Part ' || p_size || '): 20' || lpad(CAST(p_size AS VARCHAR), 2, '0'), '0123456789', '०१२३४५६७८९') AS raw FROM part) SELECT p_partkey, translate(raw, '०१२३४५६७८९', '0123456789') AS folded, translate(raw, '०१२३४५६७८९', '0123456789') AS normalised, regexp_replace(translate(raw, '०१२३४५६७८९', '0123456789'), '\\s*\\(Part \\d+\\)', '') AS base FROM x")
def fold_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations in Devanagari digits: folded, normalised and without their part."""
    raw = F.concat(F.lit("IS "), F.col("p_partkey"), F.lit(" (Part "), F.col("p_size"), F.lit("): 20"), F.lpad(F.col("p_size").cast("string"), 2, "0"))
    x = table(spark, sf_dir, "part").select("p_partkey", F.translate(raw, "0123456789", T.DEVANAGARI_DIGITS).alias("raw"))
    return x.select("p_partkey", T.fold_digits(F.col("raw")).alias("folded"), T.normalise_citation(F.col("raw")).alias("normalised"), T.base_number(F.col("raw")).alias("base"))


@query("WITH n AS (SELECT DISTINCT p_name FROM part), t AS (SELECT p_name, list_distinct(string_split(p_name, ' ')) AS w, list_distinct(list_transform(range(length(p_name) + 2), lambda i: substr('  ' || p_name || '  ', i + 1, 3))) AS g FROM n) SELECT a.p_name AS a, b.p_name AS b, length(list_intersect(a.w, b.w)) / length(list_distinct(list_concat(a.w, b.w))) AS jaccard, 2.0 * length(list_intersect(a.g, b.g)) / (length(a.g) + length(b.g)) AS dice, levenshtein(a.p_name, b.p_name) = 1 AS edit1 FROM t a, t b WHERE a.p_name < b.p_name")
def mention_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token Jaccard, trigram Dice and one-edit test of pairs of product names (a list of 64)."""
    n = table(spark, sf_dir, "part").select("p_name").distinct()
    x = n.select(F.col("p_name").alias("a")).join(n.select(F.col("p_name").alias("b")), F.col("a") < F.col("b"))
    return x.select("a", "b", T.token_jaccard(F.col("a"), F.col("b")).alias("jaccard"), T.trigram_dice(F.col("a"), F.col("b")).alias("dice"), T.edit1(F.col("a"), F.col("b")).alias("edit1"))


@query("SELECT p_partkey, trim(split_part(lower(p_name), ' units', 1)) AS mention FROM part")
def normalize_mention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with a quantity before and a stop word after."""
    raw = F.concat(F.lit("  "), F.col("p_size"), F.lit(" "), F.upper("p_name"), F.lit(" units of grade "), F.col("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", T.normalise_mention(raw).alias("mention"))


@query("SELECT page_id, contains(lower(html), 'crs') OR contains(lower(html), 'compulsory registration scheme') OR contains(lower(html), 'bis registration') OR contains(lower(html), 'isi mark') OR contains(lower(html), 'registration under') AS mentions, sha256(trim(html) || '||v1||m') AS key FROM pages")
def mentions_certification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as clauses: whether they mention certification, and their cache key."""
    return table(spark, sf_dir, "pages").select("page_id", T.mentions_certification(F.col("html")).alias("mentions"), T.cache_key(F.trim("html"), F.lit("v1"), F.lit("m")).alias("key"))


@query("WITH d AS (SELECT doc_id, replace(replace(text, ' and ', ' ISI quality '), ' of ', ' as per BIS ') AS t FROM documents), s AS (SELECT doc_id, phrase, string_split(t, phrase) AS parts FROM d, (VALUES ('the'), ('ISI quality'), ('as per BIS')) AS p(phrase)), u AS (SELECT *, unnest(range(1, len(parts))) AS i FROM s) SELECT doc_id, phrase, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * length(phrase) AS INT) AS span_start, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + i * length(phrase) AS INT) AS span_end FROM u")
def extract_vague(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All occurrences of all patterns, and of one more, in documents of which two common words are replaced by vague wording."""
    x = table(spark, sf_dir, "documents").select("doc_id", F.replace(F.replace("text", F.lit(" and "), F.lit(" ISI quality ")), F.lit(" of "), F.lit(" as per BIS ")).alias("text"))
    return extract.extract_vague(x, (*extract.VAGUE_PATTERNS, "(?-i)the")).select("doc_id", "phrase", "span_start", "span_end")


@query("WITH x AS (SELECT l_orderkey % 1000 AS k, l_partkey, l_suppkey, l_linenumber, 'IS ' || (10000 + l_partkey) || ': 2010' AS raw, CASE WHEN l_suppkey % 5 = 0 THEN 1999 ELSE 2010 END AS year, CASE WHEN l_linenumber % 2 = 0 THEN 4 ELSE 3 END AS s FROM lineitem) SELECT count(*) FILTER (s = 4 AND contains(raw, CAST(year AS VARCHAR))) AS kept, count(*) FILTER (NOT (s = 4 AND contains(raw, CAST(year AS VARCHAR)))) AS dropped, count(*) FILTER (s = 4 AND NOT contains(raw, CAST(year AS VARCHAR))) AS invented FROM x")
def validate_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations with right and wrong spans and years, counted."""
    raw = F.concat(F.lit("IS "), F.lit(10000) + F.col("l_partkey"), F.lit(": 2010"))
    start = F.when(F.col("l_linenumber") % 2 == 0, 4).otherwise(3)
    item = F.struct(raw.alias("raw"), start.alias("span_start"), (start + F.length(raw)).alias("span_end"), F.concat(F.lit("IS "), F.lit(10000) + F.col("l_partkey")).alias("is_number"), F.when(F.col("l_suppkey") % 5 == 0, 1999).otherwise(2010).alias("year"))
    x = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("See "), raw, F.lit(".")).alias("text"), F.array(item).alias("citations"))
    return extract.validate_spans(x).agg(F.sum(F.size("citations")).alias("kept"), F.sum("dropped").alias("dropped"), F.sum("invented").alias("invented"))


def _extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = bindings.sql(spark, sf_dir, "SELECT p_partkey AS clause_id, CAST(p_partkey AS STRING) AS key, concat('Item as in IS ', CAST(10000 + p_partkey AS STRING), '.') AS text FROM {part}")
    made = extract.with_citations(c)
    wrong = F.transform("citations", lambda z: z.withField("is_number", F.lit("IS 1")))
    primary = made.where("clause_id % 3 = 0").withColumn("citations", F.when(F.col("clause_id") % 2 == 0, wrong).otherwise(F.col("citations")))
    secondary = made.where("clause_id % 3 = 1")
    return extract.cross_check(extract.fallback_chain(c, primary, secondary))


@query("SELECT p_partkey AS clause_id, CASE p_partkey % 3 WHEN 0 THEN 'primary' WHEN 1 THEN 'secondary' ELSE 'RegexFallback' END AS provider, p_partkey % 3 = 2 AS reduced_mode, p_partkey % 6 = 0 AS extraction_uncertain FROM part")
def extraction_fallback_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractions from two models and the native one, cross-checked."""
    return _extractions(spark, sf_dir).select("clause_id", "provider", "reduced_mode", "extraction_uncertain")


@query("SELECT user_id % 50 AS key, CAST(min(event_id) AS BIGINT) AS n FROM events WHERE user_id % 50 >= 20 GROUP BY 1")
def extraction_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that the cache lacks, with their first event."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("key"), F.col("event_id"))
    cache = e.where("key < 20").select("key").distinct()
    return extract.cache_misses(e.groupBy("key").agg(F.min("event_id").alias("n")), cache)


@query("SELECT event_id AS clause_id, user_id % 50 AS key, true AS cached FROM events WHERE user_id % 50 < 20")
def extraction_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("clause_id"), (F.col("user_id") % 50).alias("key"))
    return extract.cache_hits(e, e.where("key < 20").groupBy("key").agg(F.min("clause_id").alias("clause_id")))


# Uploads and ingestion


@query("WITH x AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN '/a.txt' WHEN 1 THEN '/a.PDF' WHEN 2 THEN '/a.pdf' WHEN 3 THEN '/a.exe' WHEN 4 THEN '/a.docx' ELSE '/b.txt' END AS suffix FROM pages) SELECT page_id || suffix AS path, page_id % 6 IN (0, 2) AS accepted, CASE page_id % 6 WHEN 1 THEN 'no PDF header' WHEN 3 THEN 'suffix not allowed' WHEN 4 THEN 'program' WHEN 5 THEN 'empty' END AS reject_reason FROM x")
def upload_safety_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as uploads: fine, without header, of another suffix, programs, empty."""
    k = F.col("page_id") % 6
    name = F.element_at(F.array(*map(F.lit, ("/a.txt", "/a.PDF", "/a.pdf", "/a.exe", "/a.docx", "/b.txt"))), (k + 1).cast("int"))
    head = F.when(k == 2, "%PDF-").when(k == 4, "MZ").otherwise("x")
    content = F.when(k == 5, "").otherwise(F.concat(head, F.coalesce("html", F.lit(""))))
    return io.upload_safety_gate(table(spark, sf_dir, "pages").select(F.concat(F.col("page_id").cast("string"), name).alias("path"), content.cast("binary").alias("content")))


_FILES = "SELECT doc_id, n_chars AS n_bytes, CAST(n_chars // 50 AS BIGINT) AS page_count, length(string_split(text, chr(10))) AS n_clauses, CASE WHEN n_chars > 20000 THEN 'file too large' WHEN n_chars // 50 > 100 THEN 'too many pages' END AS error_message FROM documents"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("n_bytes"), F.floor(F.col("n_chars") / 50).alias("page_count"), F.size(F.split("text", "\n", -1)).cast("long").alias("n_clauses"))
    return io.ingest_limits(x, max_bytes=20000)


@query(f"SELECT *, CASE WHEN error_message IS NULL THEN 'SUCCESS' ELSE 'ERROR' END AS status FROM ({_FILES})")
def ingest_size_page_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir)


@query(f"SELECT count(*) AS total_files, count(*) FILTER (error_message IS NULL) AS succeeded, count(error_message) AS failed, CAST(coalesce(sum(n_clauses) FILTER (error_message IS NULL), 0) AS BIGINT) AS total_clauses FROM ({_FILES})")
def ingest_batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.ingest_batch_summary(_files(spark, sf_dir))


# Reference rows

_CURATED = """SELECT p_partkey AS id, p_partkey + 1 AS line_no, CASE WHEN p_partkey % 17 = 0 THEN '' ELSE concat('IS ', CAST(p_partkey AS STRING)) END AS is_number, CASE WHEN p_partkey % 19 = 0 THEN ' ' ELSE p_name END AS title,
 CASE WHEN p_partkey % 13 = 0 THEN 'http://x' ELSE 'https://x' END AS catalogue_url, CASE WHEN p_partkey % 11 = 0 THEN '2025/01/01' ELSE '2025-01-01' END AS verified_on, 'Asha' AS verified_by,
 CASE WHEN p_partkey % 5 = 0 THEN 'asha ' WHEN p_partkey % 2 = 0 THEN 'Ben' END AS second_checked_by, CASE WHEN p_partkey % 23 = 0 THEN 'Unverified claim' ELSE 'record' END AS evidence_ref,
 CASE WHEN p_partkey % 29 = 0 THEN 'Lost' ELSE 'Active' END AS status, CASE WHEN p_partkey % 7 = 0 THEN '95' ELSE '1995' END AS publication_year FROM {part}"""
_CUR = _CURATED.format(part="part")
_MISSING = "list_filter([CASE WHEN is_number = '' THEN 'is_number' END, CASE WHEN trim(title) = '' THEN 'title' END], lambda f: f IS NOT NULL)"
_PROBLEMS = f"""list_filter([CASE WHEN len({_MISSING}) > 0 THEN 'missing: ' || array_to_string({_MISSING}, ', ') END, CASE WHEN id % 23 = 0 THEN 'contains prohibited term UNVERIFIED' END, CASE WHEN id % 11 = 0 THEN 'verified_on is not YYYY-MM-DD' END,
 CASE WHEN id % 13 = 0 THEN 'catalogue_url must start with https://' END, CASE WHEN id % 29 = 0 THEN 'unknown status Lost' END, CASE WHEN id % 7 = 0 THEN 'publication_year must be 4 digits' END, CASE WHEN id % 5 = 0 THEN 'second_checked_by must differ from verified_by' END], lambda p: p IS NOT NULL)"""


def _curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bindings.sql(spark, sf_dir, _CURATED)


@query(f"SELECT id, array_to_string({_PROBLEMS}, '; ') AS problems FROM ({_CUR})")
def provenance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.provenance_check(_curated(spark, sf_dir), "standards").select("id", F.array_join("problems", "; ").alias("problems"))


@query(f"SELECT id, CASE WHEN len({_PROBLEMS}) > 0 THEN 'FAIL' WHEN second_checked_by IS NULL THEN 'AWAITING_SECOND_CHECK' ELSE 'VERIFIED' END AS provenance_status FROM ({_CUR})")
def provenance_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.provenance_status(_curated(spark, sf_dir), "standards").select("id", "provenance_status")


@query(f"SELECT 'standards' AS table_name, count(*) AS n, count(*) FILTER (s = 'VERIFIED') AS verified, count(*) FILTER (s = 'AWAITING_SECOND_CHECK') AS awaiting, count(*) FILTER (s = 'FAIL') AS failed, string_agg(DISTINCT verified_on, ',' ORDER BY verified_on) AS dates FROM (SELECT *, CASE WHEN len({_PROBLEMS}) > 0 THEN 'FAIL' WHEN second_checked_by IS NULL THEN 'AWAITING_SECOND_CHECK' ELSE 'VERIFIED' END AS s FROM ({_CUR}))")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.coverage_report({"standards": _curated(spark, sf_dir)})


@query(f"SELECT line_no, CASE WHEN is_number <> '' THEN is_number ELSE 'row-' || line_no END AS identifier, unnest({_MISSING}) AS field FROM ({_CUR})")
def needed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.needed_cells(_curated(spark, sf_dir), "standards")


@query(f"SELECT id, CASE WHEN id % 3 = 0 THEN ' ASHA' ELSE 'Cy' END AS checker, CASE WHEN id % 3 = 0 THEN 'REJECTED' ELSE 'ACCEPTED' END AS outcome, CASE WHEN id % 3 <> 0 THEN 'Cy' END AS second_checked_by FROM ({_CUR}) WHERE id % 2 = 0")
def two_person_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _curated(spark, sf_dir)
    return provenance.two_person_check(x, x.where("id % 2 = 0").select("id", F.when(F.col("id") % 3 == 0, " ASHA").otherwise("Cy").alias("checker")))


@query(f"SELECT id, CASE WHEN id % 4 = 0 THEN 'New' ELSE title END AS title, CASE WHEN id % 8 = 0 THEN DATE '2026-01-01' ELSE DATE '2025-01-01' END AS verified_on, CASE WHEN id % 8 = 0 THEN 'fresh' ELSE evidence_ref END AS evidence_ref FROM ({_CUR})")
def apply_row_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _curated(spark, sf_dir).withColumn("verified_on", F.lit(datetime.date(2025, 1, 1)))
    u = x.where("id % 4 = 0").select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("ts")).withColumn("title", F.when(F.col("ts") == 2, "New").otherwise("Old")).withColumn("new_evidence", F.when((F.col("id") % 8 == 0) & (F.col("ts") == 2), "fresh"))
    return provenance.apply_row_updates(x, u, ("title",), AS_OF).select("id", "title", "verified_on", "evidence_ref")


@query(f"SELECT id, is_number FROM ({_CUR}) WHERE second_checked_by IS NULL")
def unverified_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.unverified_queue(_curated(spark, sf_dir)).select("id", "is_number")


_STD = bindings.STANDARDS.format(part="part")


@query(f"SELECT id, verified_on FROM ({_STD}) WHERE verified_on IS NULL OR verified_on < DATE '2026-01-01' - 180")
def stale_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.stale_rows(bindings.sql(spark, sf_dir, bindings.STANDARDS), AS_OF).select("id", "verified_on")


@query("SELECT doc_id, 'text' AS column_name, s AS snippet FROM documents, (VALUES ('copyright'), ('license'), ('all rights reserved')) AS t(s) WHERE contains(lower(text), s) UNION ALL SELECT doc_id, 'source', s FROM documents, (VALUES ('copyright'), ('license'), ('all rights reserved')) AS t(s) WHERE contains(lower(source), s)")
def prohibited_text_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.prohibited_text_scan(table(spark, sf_dir, "documents"), "doc_id", ["text", "source"], ("copyright", "license", "all rights reserved"))


@query(f"SELECT id FROM (SELECT id, CASE WHEN id % 6 = 0 THEN 'Full_Standard copy' ELSE evidence_ref END AS e FROM ({_CUR})) WHERE regexp_matches(lower(e), 'full_standard|standard_text|is_text')")
def evidence_ref_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _curated(spark, sf_dir).withColumn("evidence_ref", F.when(F.col("id") % 6 == 0, "Full_Standard copy").otherwise(F.col("evidence_ref")))
    return provenance.evidence_ref_scan(x).select("id")


_REASON = "CASE WHEN is_number = '' THEN 'missing is_number' WHEN trim(title) = '' THEN 'missing title' WHEN id % 13 = 0 THEN 'url must start with https://' WHEN id % 23 = 0 THEN 'evidence missing or unverified' END"


@query(f"SELECT line_no, {_REASON} AS reason, CAST(publication_year AS INT) AS publication_year, CASE WHEN {_REASON} IS NULL THEN DATE '2026-01-01' END AS verified_on FROM ({_CUR})")
def bulk_import_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.bulk_import(_curated(spark, sf_dir), AS_OF, "ops").select("line_no", "reason", "publication_year", "verified_on")


@query(f"SELECT count(*) AS total, count(*) FILTER ({_REASON} IS NULL) AS imported, count({_REASON}) AS rejected FROM ({_CUR})")
def bulk_import_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.import_report(provenance.bulk_import(_curated(spark, sf_dir), AS_OF, "ops")).drop("errors")


@query(f"SELECT id, is_number, status FROM ({_STD}) ORDER BY id LIMIT 50 OFFSET 20")
def list_standards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the catalogue's public fields; the page size is the feature."""
    return bindings.sql(spark, sf_dir, bindings.STANDARDS).select("id", "is_number", "status").orderBy("id").offset(20).limit(50)


#: Products are the nouns of part names, certification rules come from suppliers.
_NOUNS = "SELECT CAST(min(p_partkey) AS INT) AS id, split_part(p_name, ' ', 2) AS canonical_name, concat('family ', CAST(min(p_size) % 3 AS STRING)) AS family FROM {part} GROUP BY split_part(p_name, ' ', 2)"
_RULES = f"SELECT CAST(s_suppkey AS INT) AS id, p.id AS product_id, concat('Order ', CAST(s_suppkey AS STRING)) AS instrument FROM {{supplier}} JOIN ({_NOUNS}) p ON p.id % 4 = s_suppkey % 5"
_N, _C = _NOUNS.format(part="part"), _RULES.format(part="part", supplier="supplier")


@query(f"SELECT p.id, p.canonical_name, CAST(count(c.id) AS BIGINT) AS n_rules, coalesce(string_agg(c.instrument, ';' ORDER BY c.id), '') AS instruments FROM ({_N}) p LEFT JOIN ({_C}) c ON c.product_id = p.id GROUP BY ALL")
def product_rules_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = review.product_rules(bindings.sql(spark, sf_dir, _NOUNS), bindings.sql(spark, sf_dir, _RULES))
    return x.select("id", "canonical_name", F.size("rules").cast("long").alias("n_rules"), F.array_join(F.transform("rules", lambda z: z["instrument"]), ";").alias("instruments"))


@query(f"SELECT id, canonical_name, family FROM ({_N}) ORDER BY id LIMIT 4 OFFSET 2")
def list_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the products of the catalogue."""
    return review.page(bindings.sql(spark, sf_dir, _NOUNS), ["id", "canonical_name", "family"], offset=2, limit=4)


@query(f"SELECT id, is_number, status FROM ({_STD}) WHERE id = 21")
def get_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.get_by_id(bindings.sql(spark, sf_dir, bindings.STANDARDS), 21).select("id", "is_number", "status")


@query(f"SELECT (SELECT count(*) FROM ({bindings.PRODUCTS})) AS products, (SELECT count(DISTINCT family) FROM ({bindings.PRODUCTS})) AS families, (SELECT count(*) FROM ({_STD})) AS standards, (SELECT count(*) FROM ({bindings.MAPS.format(part='part')})) AS maps, (SELECT count(*) FROM ({bindings.CERTIFICATION.format(part='part')})) AS certification_rules, (SELECT count(*) FROM ({bindings.LINKS.format(part='part')})) AS links")
def coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = bindings.reference(spark, sf_dir)
    return provenance.coverage_counts(r.products, r.standards, r.maps, r.certification_rules, r.links)


# Review: events as the log of actions


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query("WITH f AS (SELECT o_orderkey AS finding_id FROM orders), d AS (SELECT user_id AS finding_id, arg_max(event_type, (ts, event_id)) AS decision, max(ts) AS decided_on FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1) SELECT finding_id, decision, decided_on FROM f LEFT JOIN d USING (finding_id)")
def apply_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _events(spark, sf_dir).where("event_type in ('click', 'purchase')").select(F.col("user_id").alias("finding_id"), F.col("event_type").alias("decision"), F.lit("").alias("reason"), F.lit("").alias("decided_by"), "ts")
    return review.apply_decisions(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("finding_id")), d).select("finding_id", "decision", "decided_on")


@query("SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def unknown_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("finding_id"))
    return review.unknown_decisions(f, _events(spark, sf_dir).select("event_id", F.col("user_id").alias("finding_id"))).select("event_id", F.col("finding_id").alias("user_id"))


@query("SELECT event_id, ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 10 DAYS AS purged FROM events")
def retention_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _events(spark, sf_dir).withColumn("created_at", F.col("ts"))
    return review.retention_split(x, datetime.datetime(2024, 1, 20), 10).select("event_id", "purged")


@query("SELECT 'RETENTION_PURGE' AS action, 'sessions' AS table_name, count(*) FILTER (ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 10 DAYS) AS purged FROM events")
def retention_purge_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = datetime.datetime(2024, 1, 20)
    x = review.retention_split(_events(spark, sf_dir).withColumn("created_at", F.col("ts")), day, 10)
    return review.purge_log(x, day, 10).select("action", "table_name", "purged")


@query("SELECT CAST(user_id AS VARCHAR) AS record_id, 'FINDING_DECISION' AS action, 'findings' AS table_name, ts, event_type AS decision FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("finding_id"))
    d = _events(spark, sf_dir).select(F.col("user_id").alias("finding_id"), F.col("event_type").alias("decision"), F.lit("").alias("reason"), F.lit("o").alias("decided_by"), "ts")
    return review.decision_log(f, d).select("record_id", "action", "table_name", "ts", F.get_json_object("new_values", "$.decision").alias("decision"))


@query("SELECT p_partkey AS id, p_name AS term, CASE WHEN o THEN 'phrase exists' ELSE 'phrase repeated' END AS error FROM (SELECT p_partkey, p_name, p_name IN (SELECT p_name FROM part WHERE p_partkey % 5 = 0 AND p_partkey % 50 <> 5) AS o, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS r FROM part WHERE p_partkey % 5 <> 0) q WHERE o OR r > 1")
def vague_terms_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New terms whose phrase is there or comes twice."""
    x = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("term"))
    return review.upsert_errors(x.where("id % 5 = 0 and id % 50 <> 5"), x.where("id % 5 <> 0"))


_DEL = "SELECT o_orderkey AS audit_id, o_orderkey % 7 AS user_id, CASE WHEN o_orderkey % 10 = 0 THEN 'Admin' ELSE 'Officer' END AS role FROM orders WHERE o_orderkey % 2 = 0"


@query(f"SELECT audit_id, CASE WHEN role = 'Admin' OR o_custkey % 7 = r.user_id THEN 'DELETED' ELSE 'REJECTED' END AS outcome FROM ({_DEL}) r JOIN orders ON o_orderkey = audit_id")
def delete_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    req = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("audit_id"), (F.col("o_orderkey") % 7).alias("user_id"), F.when(F.col("o_orderkey") % 10 == 0, "Admin").otherwise("Officer").alias("role"))
    return review.delete_audits(o.select(F.col("o_orderkey").alias("audit_id"), (F.col("o_custkey") % 7).alias("user_id")), req)[1].select("audit_id", "outcome")


@query(f"SELECT CAST(audit_id AS VARCHAR) AS record_id, 'DELETE_AUDIT' AS action FROM ({_DEL}) r JOIN orders ON o_orderkey = audit_id WHERE role = 'Admin' OR o_custkey % 7 = r.user_id")
def deletion_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    req = bindings.sql(spark, sf_dir, f"SELECT *, TIMESTAMP '2026-01-01 00:00:00' AS ts FROM ({_DEL.replace('FROM orders', 'FROM {orders}')}) r")
    return review.deletion_log(review.delete_audits(o.select(F.col("o_orderkey").alias("audit_id"), (F.col("o_custkey") % 7).alias("user_id")), req)[1]).select("record_id", "action")


@query(f"SELECT doc_id, error_message FROM ({_FILES}) WHERE error_message IS NOT NULL")
def ingest_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error list of a batch."""
    return io.ingest_errors(_files(spark, sf_dir))


@query("SELECT p_name AS term, CASE WHEN min(p_partkey) FILTER (p_partkey % 5 = 0) IS NOT NULL THEN min(p_partkey) FILTER (p_partkey % 5 = 0) ELSE min(p_partkey) END AS id FROM part GROUP BY 1")
def vague_terms_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as terms: those of every fifth part are there, the others come new."""
    p = table(spark, sf_dir, "part")
    have = p.where("p_partkey % 5 = 0").groupBy(F.col("p_name").alias("term")).agg(F.min("p_partkey").alias("id"))
    return review.upsert_terms(have, p.where("p_partkey % 5 <> 0").select(F.col("p_name").alias("term"), F.col("p_partkey").alias("id")))


@query("SELECT p_partkey AS id, p_name AS term FROM part WHERE p_partkey % 3 <> 0")
def vague_terms_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("term"))
    return review.delete_terms(p, p.where("id % 3 = 0"))


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 100 OFFSET 10")
def recent_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.recent(_events(spark, sf_dir).select("event_id", "ts"), ["ts", "event_id"], 100, 10)


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def recent_audit_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest log rows: more are asked for than are given."""
    return review.recent_audit_logs(_events(spark, sf_dir).select("event_id", "ts"), 2000, ("event_id",))


@query("SELECT p_partkey AS id, p_name AS term FROM part ORDER BY term")
def vague_terms_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.terms_sorted(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("term")))


@query("SELECT coalesce(b.p_partkey, a.p_partkey) AS p_partkey, CASE WHEN a.p_partkey IS NULL THEN 'INSERT' ELSE 'UPDATE' END AS action FROM (SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey % 3 <> 0) a RIGHT JOIN (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'x' ELSE p_name END AS p_name, p_size FROM part) b USING (p_partkey) WHERE a.p_partkey IS NULL OR a.p_name IS DISTINCT FROM b.p_name")
def row_change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    after = p.withColumn("p_name", F.when(F.col("p_partkey") % 4 == 0, "x").otherwise(F.col("p_name")))
    return review.row_change_log(p.where("p_partkey % 3 <> 0"), after, "p_partkey").select("p_partkey", "action")


@query("SELECT f.o_orderkey AS doc_id, CASE WHEN length(o_orderpriority || o_orderpriority || o_orderstatus) > 80 THEN 'long' ELSE coalesce(CASE WHEN f.o_orderkey % 5 <> 0 THEN o_orderpriority || o_orderpriority || o_orderstatus END, 'N/A') END AS snippet, CASE WHEN f.o_orderkey % 2 = 0 THEN 'ACCEPT' ELSE 'Pending Review' END AS decision FROM orders f")
def findings_with_clause_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumns({"doc_id": F.col("o_orderkey"), "clause_id": F.lit("c1")})
    c = o.where("doc_id % 5 <> 0").select("doc_id", "clause_id", F.concat("o_orderpriority", "o_orderpriority", "o_orderstatus").alias("text"))
    return review.findings_with_clause_text(o.select("doc_id", "clause_id", F.when(F.col("doc_id") % 2 == 0, "ACCEPT").alias("decision")), c).select("doc_id", "snippet", "decision")


@query("SELECT l_orderkey AS doc_id, CASE WHEN l_orderkey % 4 = 0 THEN 'new' ELSE 'old' END AS state, count(*) AS n FROM lineitem GROUP BY 1, 2")
def replace_clause_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of edited documents' clauses give way to new ones."""
    f = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("clause_id"), F.lit("old").alias("state"))
    new = f.where("doc_id % 4 = 0").withColumn("state", F.lit("new"))
    return review.replace_clause_findings(f, new.select("doc_id", "clause_id"), new).groupBy("doc_id", "state").agg(F.count("*").alias("n"))


# Evaluation


_CASES = "SELECT doc_id AS case_id, CASE WHEN lang = 'fr' THEN 'clean' WHEN lang = 'de' THEN 'abstain' WHEN lang = 'es' THEN 'adversarial' ELSE 'defect' END AS kind, lang AS language, CASE WHEN toxic = 1 THEN ['R09'] WHEN quality = 0 THEN ['R01', 'R10'] ELSE [] END AS expected, list_sort(list_filter([CASE WHEN contains(text, 'the') AND toxic = 1 THEN 'R09' END, CASE WHEN quality = 0 THEN 'R10' END, CASE WHEN quality = 0 AND doc_id % 2 = 0 THEN 'R01' END], lambda r: r IS NOT NULL)) AS got FROM labels JOIN documents USING (doc_id)"
_RES = f"SELECT *, expected = got AS passed FROM ({_CASES})"


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as expectations, predicates on the documents as fired rules."""
    x = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").withColumn("case_id", F.col("doc_id"))
    kind = F.when(F.col("lang") == "fr", "clean").when(F.col("lang") == "de", "abstain").when(F.col("lang") == "es", "adversarial").otherwise("defect")
    cases = x.select("case_id", kind.alias("kind"), F.col("lang").alias("language"), F.when(F.col("toxic") == 1, "R09").when(F.col("quality") == 0, "R10;R01").otherwise("").alias("expected_rules"))
    rules = F.array_compact(F.array(F.when(F.contains("text", F.lit("the")) & (F.col("toxic") == 1), "R09"), F.when(F.col("quality") == 0, "R10"), F.when((F.col("quality") == 0) & (F.col("case_id") % 2 == 0), "R01"), F.lit("R14")))
    return evaluate.case_results(cases, evaluate.fired_rules(x.select("case_id", F.explode(rules).alias("rule_id"))))


@query(f"SELECT case_id, kind, language, array_to_string(expected, ';') AS expected, array_to_string(got, ';') AS got, passed FROM ({_RES})")
def eval_case_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).withColumns({"expected": F.array_join("expected", ";"), "got": F.array_join("got", ";")})


_METRICS = f"SELECT CAST(coalesce(sum(len(expected)) FILTER (kind = 'defect'), 0) AS BIGINT) AS planted, CAST(coalesce(sum(len(list_intersect(expected, got))) FILTER (kind = 'defect'), 0) AS BIGINT) AS caught, count(*) FILTER (kind = 'clean' AND len(got) > 0) AS false_alarms, count(*) FILTER (kind = 'clean') AS clean, count(*) FILTER (kind = 'abstain' AND list_contains(got, 'R10') AND passed) AS abstained, count(*) FILTER (kind = 'abstain') AS abstain, count(*) FILTER (kind = 'adversarial' AND passed) AS adversarial_passed, count(*) FILTER (kind = 'adversarial') AS adversarial FROM ({_RES})"


@query(f"SELECT *, planted = caught AND false_alarms = 0 AND abstained = abstain AS gate FROM ({_METRICS})")
def regression_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, false alarms, abstentions and adversarial cases, and the gate over them."""
    return evaluate.metrics(_results(spark, sf_dir))


@query(f"SELECT case_id, kind, language, array_to_string(list_filter(expected, lambda e: NOT list_contains(got, e)), ';') AS missing, array_to_string(list_filter(got, lambda g: NOT list_contains(expected, g)), ';') AS unexpected FROM ({_RES}) WHERE NOT passed")
def failed_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details of the cases that the gates fail."""
    return evaluate.failed_cases(_results(spark, sf_dir)).withColumns({"missing": F.array_join("missing", ";"), "unexpected": F.array_join("unexpected", ";")})


@query("SELECT CAST(doc_id AS VARCHAR) AS case_id, lang AS language, CASE WHEN toxic = 1 THEN 'R09' END AS expected_rules, CAST(length(text) AS INT) AS n, md5(text) AS clause_md5 FROM labels JOIN documents USING (doc_id) WHERE text <> ''")
def scan_eval_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents written as the cases' CSV, with their quotes, commas and line breaks, and read again."""
    x = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").where("text <> ''")
    folder = shared_folder(spark, "cases")
    io.write_eval_corpus(x.select(F.col("doc_id").cast("string").alias("case_id"), F.col("lang").alias("language"), F.lit("defect").alias("kind"), F.col("text").alias("clause"), F.when(F.col("toxic") == 1, "R09").alias("expected_rules"), F.lit("a, \"b\"").alias("notes")), folder)
    y = io.scan_eval_corpus(spark, folder).where(F.col("notes") == 'a, "b"')
    return y.select("case_id", "language", "expected_rules", F.length("clause").alias("n"), F.md5("clause").alias("clause_md5"))


@query(f"SELECT language, count(*) FILTER (passed) AS passed, count(*) AS total, count(*) FILTER (passed) / count(*) AS rate, CASE WHEN count(*) FILTER (passed) / count(*) >= 0.9 THEN 'SUPPORTED' ELSE 'NOT_SUPPORTED' END AS status, printf('%d of %d (%.1f%%)', count(*) FILTER (passed), count(*), 100.0 * count(*) FILTER (passed) / count(*)) AS summary FROM ({_RES}) GROUP BY 1")
def language_quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.language_quality_gate(_results(spark, sf_dir))


@query("WITH x AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, min(value) FILTER (r >= least(n, floor(n * 0.5) + 1)) AS p50, min(value) FILTER (r >= least(n, floor(n * 0.95) + 1)) AS p95, min(value) FILTER (r >= least(n, floor(n * 0.99) + 1)) AS p99, min(value) AS least, max(value) AS greatest, round(avg(value), 4) AS mean, count(*) AS n FROM x GROUP BY 1")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.latency_percentiles(_events(spark, sf_dir), ["event_type"], "value").withColumn("mean", F.round("mean", 4))


@query("WITH x AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) AS r, count(*) OVER () AS n FROM lineitem) SELECT 'all' AS key, min(v) FILTER (r >= floor(n * 0.5) + 1) AS p50, min(v) FILTER (r >= floor(n * 0.95) + 1) AS p95, min(v) FILTER (r >= floor(n * 0.99) + 1) AS p99, min(v) AS least, max(v) AS greatest, count(*) AS n FROM x")
def percentiles_of_one_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All line items under one key: its ranges are put in order apart."""
    x = table(spark, sf_dir, "lineitem").withColumn("key", F.lit("all"))
    return evaluate.latency_percentiles(x, ["key"], "l_extendedprice").drop("mean")


@query("SELECT 'part' AS table_name, count(*) AS n FROM part UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'events', count(*) FROM events")
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.table_counts({t: table(spark, sf_dir, t) for t in ("part", "orders", "events")})


_RUNS = "SELECT event_type AS candidate, user_id AS clause_id, CASE WHEN user_id % 4 = 0 THEN 'hi' ELSE 'en' END AS language, event_id % 9 <> 0 AS valid, CASE WHEN event_type = 'error' AND event_id % 500 = 2 THEN 1 ELSE 0 END AS invented, event_id % 2 AS matched, 1 AS expected, 1 + event_id % 2 AS produced, CASE WHEN user_id % 3 = 0 THEN 'same' ELSE CAST(event_id % 2 AS STRING) END AS output, value AS ms FROM {events}"
_R = _RUNS.format(events="events")


_SCORES = f"WITH r AS ({_R}), p AS (SELECT candidate, ms, row_number() OVER (PARTITION BY candidate ORDER BY ms) AS k, count(*) OVER (PARTITION BY candidate) AS n FROM r) SELECT a.candidate, round(avg(CAST(valid AS DOUBLE)), 4) AS valid_schema_rate, CAST(sum(invented) AS BIGINT) AS invented, round(sum(matched) / sum(expected), 4) AS recall, round(sum(matched) / sum(produced), 4) AS precision, round(avg(CAST(produced = expected AS DOUBLE)) FILTER (language = 'hi'), 4) AS hindi_accuracy, any_value(b.repeatability) AS repeatability, any_value(c.p50) AS p50, any_value(c.p95) AS p95, sum(invented) > 0 AS rejected FROM r a JOIN (SELECT candidate, round(avg(CAST(d = 1 AS DOUBLE)), 4) AS repeatability FROM (SELECT candidate, clause_id, count(DISTINCT output) AS d FROM r GROUP BY ALL) GROUP BY 1) b USING (candidate) JOIN (SELECT candidate, min(ms) FILTER (k >= floor(n * 0.5) + 1) AS p50, min(ms) FILTER (k >= floor(n * 0.95) + 1) AS p95 FROM p GROUP BY 1) c USING (candidate) GROUP BY 1"


@query(_SCORES)
def extractor_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.extractor_scorecard(bindings.sql(spark, sf_dir, _RUNS))


@query(f"SELECT candidate, CAST(row_number() OVER w AS INT) AS place, CASE row_number() OVER w WHEN 1 THEN 'primary' WHEN 2 THEN 'fallback' END AS role FROM ({_SCORES}) WHERE NOT rejected WINDOW w AS (ORDER BY recall DESC, hindi_accuracy DESC, repeatability DESC, p50, candidate)")
def rank_extractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.rank_extractors(evaluate.extractor_scorecard(bindings.sql(spark, sf_dir, _RUNS))).select("candidate", "place", "role")


# Reports


@query()
def sink_json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of documents as JSON, findings of all rules."""
    from clauseaudit.operators import rules

    f = bindings.facts(spark, sf_dir, store=True)
    findings, texts = rules.keyed_findings(f)
    return io.banner_check(io.json_report(f.clauses, findings, texts=texts))


@query("SELECT 'pending' AS decision, doc_id, CAST(length(text) AS VARCHAR) || ' \"#\", ' || chr(10) || '# ' || coalesce(lang, '') AS message_en, concat('https://x.example/', doc_id) AS url, source AS rule_id FROM documents")
def sink_csv_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as findings with quotes, commas, line breaks and number signs in their messages, written under the banner and read back."""
    message = F.concat(F.length("text").cast("string"), F.lit(' "#", \n# '), F.coalesce("lang", F.lit("")))
    x = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("clause_id"), F.col("source").alias("rule_id"), message.alias("message_en"), F.concat(F.lit("https://x.example/"), F.col("doc_id").cast("string")).alias("url"), F.lit("pending").alias("decision"))
    folder = f"{shared_folder(spark, 'report')}"
    io.write_csv_report(x, folder, ("doc_id",))
    y = io.read_csv_report(spark, folder, ("doc_id",))
    empty = lambda c: F.when(F.col(c) != "", F.col(c))
    return y.select(F.col("Decision").alias("decision"), F.col("doc_id").cast("long").alias("doc_id"), empty("English Message").alias("message_en"), F.col("Evidence URL").alias("url"), empty("Rule ID").alias("rule_id"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT event_type) AS BIGINT) AS kinds FROM events")
def sink_audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as audit-log rows with their values as JSON, counted."""
    x = review.log_rows(_events(spark, sf_dir), "EVENT", "events", "event_id")
    return x.agg(F.count("new_values").alias("n"), F.count_distinct(F.get_json_object("new_values", "$.event_type")).alias("kinds"))


@query("SELECT CAST(event_id AS VARCHAR) AS record_id, 'EVENT' AS action, CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS batch_id, DATE '2026-01-01' AS audit_date FROM events")
def sink_audit_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows of events in two batches, one appended twice, and one that never was committed; read back."""
    folder, x = shared_folder(spark, "append"), _events(spark, sf_dir)
    for batch, own in (("even", "event_id % 2 = 0"), ("odd", "event_id % 2 <> 0"), ("even", "event_id % 2 = 0")):
        io.append_audit(review.log_rows(x.where(own), "EVENT", "events", "event_id"), folder, "2026-01-01", batch=batch)
    io.stage_batch({"findings": review.log_rows(x, "EVENT", "events", "event_id")}, folder, "failed", "2026-01-02")
    return io.read_appended(spark, folder, "findings").select("record_id", "action", "batch_id", "audit_date")


_SNAP = {"part": ("p_name", "p_partkey", "p_size"), "orders": ("o_custkey", "o_orderkey", "o_orderstatus"), "documents": ("doc_id", "lang", "n_chars", "source", "text")}
_ITEM = "coalesce(CAST(length(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_ROWS = " UNION ALL ".join(f"SELECT '{t}' AS t, sha256({' || '.join(_ITEM.format(c) for c in cols)}) AS h FROM {t}" for t, cols in _SNAP.items())
_UP = "SELECT t, greatest(d - 1, 0) AS d, substr(b, 1, greatest(d - 1, 0)) AS b, CASE WHEN d = 0 THEN any_value(g) ELSE sha256(string_agg(b || ':' || g, '' ORDER BY b)) END AS g, CAST(sum(n) AS BIGINT) AS n FROM {0} GROUP BY t, d, substr(b, 1, greatest(d - 1, 0))"


def _snapshot_sql(leaf: int = io.LEAF, most: int = 9) -> str:
    """A tree's depth grows by one each time its table has more than ``leaf`` times another power of sixteen rows; ``most`` levels are enough for any table."""
    depth = " + ".join(["1", *(f"CAST(count(*) > {leaf * 16**d} AS BIGINT)" for d in range(1, most))])
    ups = ", ".join(f"u{d} AS ({_UP.format(f'u{d - 1}' if d > 1 else 'l')})" for d in range(1, most + 1))
    return f"WITH r AS ({_ROWS}), z AS (SELECT t, {depth} AS d FROM r GROUP BY 1), l AS (SELECT t, d, substr(h, 1, d) AS b, sha256(string_agg(h, '' ORDER BY h)) AS g, count(*) AS n FROM r JOIN z USING (t) GROUP BY 1, 2, 3), {ups} SELECT t AS table_name, n, g AS checksum FROM u{most}"


@query(_snapshot_sql())
def snapshot_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots of three tables' digest trees; of columns that both engines write as the same text."""
    return io.manifest({t: table(spark, sf_dir, t).select(*cols) for t, cols in _SNAP.items()})


# Streaming


@query("SELECT doc_id, 'paste_1' AS clause_id, id AS term_id, substr(t, strpos(lower(t), term), length(term)) AS phrase, CAST(strpos(lower(t), term) - 1 AS INT) AS span_start FROM (SELECT doc_id, trim(text, chr(10) || chr(9) || chr(13) || ' ') AS t FROM documents) JOIN (VALUES (1, 'license'), (2, 'copyright')) AS v(id, term) ON contains(lower(t), term)")
def stream_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a stream of files, cut into clauses and scanned for terms batch by batch; the sink's rows."""
    from clauseaudit.streaming import intake

    docs = table(spark, sf_dir, "documents")
    schema = docs.select("doc_id", "text").schema
    terms = spark.sql("SELECT id, term, '' AS explanation FROM VALUES (1, 'license'), (2, 'copyright') AS t(id, term)")
    folder = shared_folder(spark, "stream")

    def audit(batch: DataFrame) -> DataFrame:
        x = extract.match_vague_terms(segment.segment_clauses(batch).select("doc_id", "clause_id", "text"), terms)
        return x.select("doc_id", "clause_id", "term_id", "phrase", "span_start")

    intake.stream_audit(spark, f"{sf_dir}/documents.parque[t]", schema, audit, f"{folder}/out", f"{folder}/check").awaitTermination()
    return spark.read.schema("doc_id bigint, clause_id string, term_id int, phrase string, span_start int").parquet(f"{folder}/out/batch=*")

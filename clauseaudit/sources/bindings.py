"""Rule inputs derived from the driver's tables: one clause for each line item, a catalogue from parts.

The views are SQL that Spark and DuckDB read alike.  ``{part}`` and ``{lineitem}`` stand for the tables.
"""

from __future__ import annotations

import dataclasses
import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseaudit.operators.extract import extract_citations
from clauseaudit.operators.rules import Facts, build_facts
from clauseaudit.sources.reference import ReferenceData
from clauseaudit.sources.scratch import put, shared_folder

AS_OF = datetime.date(2026, 1, 1)

STANDARDS = """
SELECT CAST(p_partkey AS INT) AS id,
 CASE WHEN p_partkey % 5 = 0 THEN concat('IS ', CAST(10000 + 7*p_partkey AS STRING), ' (Part ', CAST(p_size % 4 + 1 AS STRING), ')')
      WHEN p_partkey % 5 = 1 THEN concat('IS/IEC ', CAST(10000 + 7*p_partkey AS STRING))
      ELSE concat('IS ', CAST(10000 + 7*p_partkey AS STRING)) END AS is_number,
 CASE WHEN p_partkey % 5 = 0 THEN CAST(p_size % 4 + 1 AS STRING) END AS part,
 CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(1990 + p_partkey % 30 AS INT) END AS publication_year,
 CASE WHEN p_partkey % 13 = 0 THEN 'Withdrawn' WHEN p_partkey % 17 = 0 THEN 'Superseded'
      WHEN p_partkey % 19 = 0 THEN 'CONFLICT' WHEN p_partkey % 7 = 0 THEN 'UNKNOWN' ELSE 'Active' END AS status,
 concat('https://catalogue.example/', CAST(p_partkey AS STRING)) AS catalogue_url,
 CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE DATE '2025-01-01' + CAST(p_partkey % 400 AS INT) END AS verified_on,
 p_partkey % 29 = 0 AS is_conflict
FROM {part}
"""

_TEXT = """concat('Supply of ', CAST(CAST(l_quantity AS INT) AS STRING), ' ', p_name,
   CASE WHEN l_suppkey % 9 = 0 THEN '' ELSE concat(' conforming to ', CASE WHEN l_partkey % 5 = 1 THEN 'IS/IEC ' ELSE 'IS ' END,
     CASE WHEN l_suppkey % 9 = 1 THEN CAST(10001 + 7*l_partkey AS STRING) WHEN l_suppkey % 9 = 2 THEN CAST(900000 + l_partkey % 50000 AS STRING)
          ELSE CAST(10000 + 7*l_partkey AS STRING) END,
     CASE WHEN l_partkey % 5 = 0 AND l_suppkey % 4 <> 0 THEN concat(' (Part ', CAST(p_size % 4 + 1 AS STRING), ')') ELSE '' END,
     CASE WHEN l_linenumber = 1 THEN '' ELSE concat(': ', CAST(1990 + (l_partkey + CASE WHEN l_suppkey % 6 = 0 THEN 1 ELSE 0 END) % 30 AS STRING)) END) END,
   CASE WHEN l_linenumber % 3 = 0 THEN ' with ISI mark' ELSE '' END,
   CASE WHEN l_returnflag = 'R' THEN ' of ISI quality' ELSE '' END, '.')"""

#: A document is one order, or with {doc} another grouping of orders.
CLAUSES = f"""
SELECT doc_id, CAST(ordinal AS INT) AS ordinal, concat('c', CAST(ordinal AS STRING)) AS clause_id, l_partkey AS part_key, p_name AS mention, {_TEXT} AS text
FROM (SELECT {{doc}} AS doc_id, row_number() OVER (PARTITION BY {{doc}} ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS ordinal,
             l.*, p.p_name, p.p_size
      FROM {{lineitem}} l JOIN {{part}} p ON l.l_partkey = p.p_partkey) q
"""

PRODUCTS = """
SELECT CAST(id AS INT) AS id, canonical_name, family, concat('["', canonical_name, 's"]') AS synonyms_en, '[]' AS synonyms_hi
FROM (VALUES (1, 'ring', 'fasteners'), (2, 'bolt', 'fasteners'), (3, 'gear', 'machinery'), (4, 'gizmo', 'machinery'), (5, 'plate', 'fasteners'), (6, 'rod', 'fasteners'), (7, 'widget', 'machinery')) AS t(id, canonical_name, family)
"""
NOUN = "split_part(p_name, ' ', 2)"
MAPS = f"""
SELECT CAST(p_partkey AS INT) AS id, CASE WHEN p_partkey % 6 = 0 THEN d.id % 7 + 1 ELSE d.id END AS product_id, CAST(p_partkey AS INT) AS standard_id, concat('https://map.example/', CAST(p_partkey AS STRING)) AS source_url,
 CASE WHEN p_partkey % 2 = 0 THEN DATE '2025-01-01' + CAST(p_partkey % 400 AS INT) END AS verified_on, p_partkey % 31 = 0 AS is_conflict
FROM {{part}} JOIN ({PRODUCTS}) d ON d.canonical_name = {NOUN} WHERE p_partkey % 3 = 0
"""
CERTIFICATION = """
SELECT CAST(id AS INT) AS id, CAST(product_id AS INT) AS product_id, CAST(std AS INT) AS specified_standard_id, 'CRS' AS scheme, concat('Order ', CAST(id AS STRING)) AS instrument,
 concat('https://cert.example/', CAST(id AS STRING)) AS source_url, DATE '2025-03-01' + CAST(id * 100 AS INT) AS verified_on, id = 3 AS is_conflict
FROM (VALUES (1, 1, 7), (2, 3, 11), (3, 5, 14)) AS t(id, product_id, std)
"""
LINKS = """
SELECT CAST(p_partkey AS INT) AS id, CAST(p_partkey AS INT) AS source_standard_id, CAST(p_partkey + 1 AS INT) AS target_standard_id, concat('https://link.example/', CAST(p_partkey AS STRING)) AS source_url,
 DATE '2025-01-01' + CAST(p_partkey % 400 AS INT) AS verified_on, p_partkey % 40 = 0 AS is_conflict
FROM {part} WHERE p_partkey % 10 = 0
"""
VAGUE = """
SELECT CAST(id AS INT) AS id, term, 'en' AS language, explanation
FROM (VALUES (1, 'ISI quality', 'Names no number.'), (2, 'as per BIS', 'Names the bureau only.')) AS t(id, term, explanation)
"""

#: The same after officers' edits: of clauses in every twentieth document, and of some rows of each reference table.
EDITED = {
    CLAUSES: f"""SELECT doc_id, ordinal, clause_id, part_key, mention, CASE WHEN doc_id % 20 = 3 AND part_key % 5 = 0 THEN replace(replace(text, ': 19', ': 20'), 'ISI quality', 'as per BIS') ELSE text END AS text
 FROM ({CLAUSES}) c WHERE NOT (doc_id % 20 = 3 AND part_key % 7 = 1) UNION ALL SELECT doc_id, ordinal + 100000, concat('n', clause_id), part_key, mention, text FROM ({CLAUSES}) d WHERE doc_id % 20 = 4 AND part_key % 11 = 0""",
    STANDARDS: f"""SELECT id, is_number, part, CASE WHEN id % 83 = 0 THEN publication_year + 1 ELSE publication_year END AS publication_year, CASE WHEN id % 89 = 0 THEN 'Withdrawn' ELSE status END AS status, catalogue_url, verified_on, is_conflict
 FROM ({STANDARDS}) s WHERE id % 101 <> 0""",
    MAPS: f"SELECT id, product_id, standard_id, source_url, verified_on, is_conflict FROM ({MAPS}) m WHERE id % 102 <> 0",
    CERTIFICATION: f"SELECT id, product_id, specified_standard_id, scheme, concat(instrument, CASE WHEN id = 3 THEN ' amended' ELSE '' END) AS instrument, source_url, verified_on, is_conflict FROM ({CERTIFICATION}) c WHERE id <> 2",
    LINKS: f"SELECT id, source_standard_id, CAST(CASE WHEN id % 70 = 0 THEN target_standard_id + 1 ELSE target_standard_id END AS INT) AS target_standard_id, source_url, verified_on, is_conflict FROM ({LINKS}) k WHERE id % 90 <> 0",
    VAGUE: f"SELECT id, term, language, CASE WHEN id = 2 THEN 'Names an office.' ELSE explanation END AS explanation FROM ({VAGUE}) v",
}


def sql(spark: SparkSession, sf_dir: str, text: str, **names: str) -> DataFrame:
    """A view's rows over the Parquet tables of ``sf_dir``."""
    tables = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in ("part", "lineitem", "events", "documents", "conversations", "labels", "orders", "pages", "supplier", "customer")}
    return spark.sql(text.format(**(tables | names)))


def clauses(spark: SparkSession, sf_dir: str, doc: str = "l_orderkey", edited: bool = False) -> DataFrame:
    return sql(spark, sf_dir, EDITED[CLAUSES] if edited else CLAUSES, doc=doc)


def reference(spark: SparkSession, sf_dir: str, edited: bool = False) -> ReferenceData:
    x = [sql(spark, sf_dir, EDITED.get(t, t) if edited else t) for t in (STANDARDS, PRODUCTS, MAPS, CERTIFICATION, LINKS, VAGUE)]
    return ReferenceData(*x, as_of=AS_OF)


def extract(c: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Citations of clauses, and their product nouns as mentions."""
    noun = F.element_at(F.split("mention", " "), -1)
    at = F.expr("locate(mention, text) - 1")
    mentions = c.select("doc_id", "clause_id", F.lit(0).alias("pos"), noun.alias("text"), at.alias("span_start"), (at + F.length("mention")).alias("span_end"), F.lit(None).cast("string").alias("canonical_product_id"))
    return extract_citations(c.select("doc_id", "clause_id", "ordinal", "text")), mentions


def facts(spark: SparkSession, sf_dir: str, doc: str = "l_orderkey", document_scope: bool = True, store: bool = False) -> Facts:
    """Clauses, extracted citations and the product noun of each clause as its mention.  With ``store`` what several rules read is written to the shared
    folder first: as Parquet it is a part of what a cache of all columns takes, and what was shuffled for it is freed."""
    keep = (lambda x, name: put(x, shared_folder(spark, "facts"), name)) if store else None
    c = clauses(spark, sf_dir, doc)
    c = keep(c, "clauses") if keep else c
    f = build_facts(c.select("doc_id", "clause_id", "ordinal", "text"), *extract(c), reference(spark, sf_dir), document_scope=document_scope, keep=keep)
    return dataclasses.replace(f, source=c)

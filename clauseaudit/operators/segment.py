"""Documents to clauses with exact offsets.

The pieces between blank lines tile the text, so a clause's start is the length of all pieces before it plus its leading white
space.  Everything is a higher-order function over one row; nothing is shuffled but for pages and tables, by document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clauseaudit.functions.text import detect_language

_PIECES = "regexp_extract_all(text, r'(?s)(.+?)(?:\\n(?U:\\s)*\\n+|\\z)', 0)"
_SEGMENTS = r"""
filter(transform(_pieces, (p, k) -> named_struct(
  'start', cast(aggregate(slice(_pieces, 1, k), 0, (a, q) -> a + length(q)) + length(regexp_extract(p, r'(?s)^((?U:\s)*)', 1)) as int),
  'text', regexp_replace(p, r'^(?U:\s)+|(?U:\s)+$', ''))), s -> s.text <> '')
"""


def segment_clauses(docs: DataFrame, base_id: str = "paste", source_type: str = "text") -> DataFrame:
    """(doc_id, text) -> one row for each blank-line separated clause, numbered from 1 after empty ones went."""
    x = docs.select("doc_id", "text", F.expr(_PIECES).alias("_pieces"))
    x = x.select("doc_id", F.posexplode(F.expr(_SEGMENTS)).alias("_n", "s"))
    text = F.col("s.text")
    return x.select(
        "doc_id", F.concat(F.lit(f"{base_id}_"), (F.col("_n") + 1).cast("string")).alias("clause_id"), (F.col("_n") + 1).alias("paragraph_index"), text.alias("text"),
        F.col("s.start").alias("start_char"), (F.col("s.start") + F.length(text)).alias("end_char"), detect_language(text).alias("language"), F.lit(source_type).alias("source_type"),
    )


def assemble_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, text) -> clauses with offsets in the joined document, ids ``pdf_p{page}_{n}``."""
    x = pages.withColumn("text", F.regexp_replace("text", "^(?U:\\s)+|(?U:\\s)+$", "")).where("text <> ''")
    order = Window.partitionBy("doc_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_base", F.coalesce(F.sum(F.length("text") + 2).over(order), F.lit(0)))
    x = x.select("doc_id", "page_number", "_base", "text", F.expr(_PIECES).alias("_pieces"))
    x = x.select("doc_id", "page_number", "_base", F.posexplode(F.expr(_SEGMENTS)).alias("_n", "s"))
    start = (F.col("_base") + F.col("s.start")).cast("int")
    return x.select(
        "doc_id", F.concat(F.lit("pdf_p"), F.col("page_number").cast("string"), F.lit("_"), (F.col("_n") + 1).cast("string")).alias("clause_id"),
        "page_number", F.col("s.text").alias("text"), start.alias("start_char"), (start + F.length("s.text")).alias("end_char"),
    )


def full_text(pages: DataFrame) -> DataFrame:
    """Trimmed pages in order, joined by a blank line."""
    x = pages.withColumn("text", F.regexp_replace("text", "^(?U:\\s)+|(?U:\\s)+$", "")).where("text <> ''")
    ordered = F.array_sort(F.collect_list(F.struct("page_number", "text")))
    return x.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n\n").alias("full_text"))


def paragraphs_to_clauses(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, idx, text) -> clauses that keep their paragraph's number; empty ones take no place in the offsets."""
    x = paragraphs.withColumn("text", F.regexp_replace("text", "^(?U:\\s)+|(?U:\\s)+$", "")).where("text <> ''")
    order = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 2).over(order), F.lit(0)).cast("int")
    x = x.withColumn("start_char", start)
    return x.select("doc_id", F.concat(F.lit("docx_p"), F.col("idx").cast("string")).alias("clause_id"), "idx", "text", "start_char", (F.col("start_char") + F.length("text")).alias("end_char"))


def flatten_table_rows(rows: DataFrame) -> DataFrame:
    """(doc_id, table_no, row_no, cells) -> one clause a row: trimmed cells that are not empty, joined by `` | ``."""
    cells = F.filter(F.transform("cells", lambda c: F.regexp_replace(c, "^(?U:\\s)+|(?U:\\s)+$", "")), lambda c: c != "")
    x = rows.withColumn("text", F.array_join(cells, " | ")).where("text <> ''")
    order = Window.partitionBy("doc_id").orderBy("table_no", "row_no")
    start = F.coalesce(F.sum(F.length("text") + 2).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    x = x.withColumn("paragraph_index", F.row_number().over(order)).withColumn("start_char", start)
    name = F.concat(F.lit("docx_t"), F.col("table_no").cast("string"), F.lit("_r"), F.col("row_no").cast("string"))
    return x.select("doc_id", name.alias("clause_id"), "paragraph_index", "text", "start_char", F.lit("docx_table").alias("source_type"))


def apply_text_corrections(docs: DataFrame, corrections: DataFrame) -> DataFrame:
    """Documents with their last correction (doc_id, corrected, ts), cut again; confidence becomes 1."""
    last = Window.partitionBy("doc_id").orderBy(F.desc("ts"), F.desc("corrected"))
    latest = corrections.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").select("doc_id", "corrected")
    x = docs.join(latest, "doc_id").select("doc_id", F.col("corrected").alias("text"))
    return segment_clauses(x, "ocr_corrected", "ocr_verified").withColumn("ocr_confidence", F.lit(1.0))

"""Checks of reference rows: provenance, integrity, curation queues, prohibited content."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fields that a row of each table must have.
_PROVENANCE = ("verified_on", "verified_by", "evidence_ref")
REQUIRED = {
    "standards": ("is_number", "title", "catalogue_url", *_PROVENANCE),
    "product_standard_map": ("product", "is_number", "relation", "source_url", *_PROVENANCE),
    "certification_rules": ("product", "scheme", "specified_is_number", "instrument", "source_url", *_PROVENANCE),
    "allied_links": ("from_is_number", "to_is_number", "relation", "source_url", *_PROVENANCE),
}
# States of a standard.
STATUSES = ("Active", "Withdrawn", "Superseded", "UNKNOWN", "")
# Wording of standards' own text, which must not be stored.
PROHIBITED_SNIPPETS = (
    "this standard specifies requirements for",
    "clause 1 scope",
    "clause 2 normative references",
    "clause 3 terms and definitions",
    "shall withstand a test voltage of",
    "tensile strength shall not be less than",
    "copyright bureau of indian standards",
    "all rights reserved. no part of this publication may be reproduced",
)
# Names in a reference that betray copied text.
EVIDENCE_MARKS = ("full_standard", "standard_text", "is_text")


def _text(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))


def missing_fields(table: str, columns: list[str]) -> Column:
    """Required fields that are blank; a column that the table lacks is blank."""
    return F.array_compact(F.array(*[F.when(_text(f) == "", F.lit(f)) if f in columns else F.lit(f) for f in REQUIRED[table]]))


def provenance_check(rows: DataFrame, table: str) -> DataFrame:
    """``rows`` with an array of problems, empty for a sound row."""
    has = rows.columns
    missing = missing_fields(table, has)
    problems = [F.when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))]
    unverified = F.lit(False)
    for c in has:
        unverified = unverified | F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("unverified"))
    problems.append(F.when(unverified, "contains prohibited term UNVERIFIED"))
    if "verified_on" in has:
        on = _text("verified_on")
        iso = on.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(on, "yyyy-MM-dd").isNotNull()
        problems.append(F.when((on != "") & ~iso, "verified_on is not YYYY-MM-DD"))
    for c in ("catalogue_url", "source_url"):
        if c in has:
            problems.append(F.when((_text(c) != "") & ~_text(c).startswith("https://"), f"{c} must start with https://"))
    if "status" in has and table == "standards":
        problems.append(F.when(~_text("status").isin(*STATUSES), F.concat(F.lit("unknown status "), _text("status"))))
    if "publication_year" in has:
        problems.append(F.when((_text("publication_year") != "") & ~_text("publication_year").rlike("^[0-9]{4}$"), "publication_year must be 4 digits"))
    if {"verified_by", "second_checked_by"} <= set(has):
        by, second = F.lower(_text("verified_by")), F.lower(_text("second_checked_by"))
        problems.append(F.when((second != "") & (by == second), "second_checked_by must differ from verified_by"))
    return rows.withColumn("problems", F.array_compact(F.array(*problems)))


def provenance_status(rows: DataFrame, table: str) -> DataFrame:
    x = provenance_check(rows, table)
    second = _text("second_checked_by") if "second_checked_by" in rows.columns else F.lit("")
    return x.withColumn("provenance_status", F.when(F.size("problems") > 0, "FAIL").when(second == "", "AWAITING_SECOND_CHECK").otherwise("VERIFIED"))


def needed_cells(rows: DataFrame, table: str) -> DataFrame:
    """(line_no, identifier, field) for each blank required cell."""
    names = [F.expr(f"nullif(trim({c}), '')") for c in ("is_number", "product") if c in rows.columns]
    ident = F.coalesce(*names, F.concat(F.lit("row-"), F.col("line_no").cast("string")))
    return rows.select("line_no", ident.alias("identifier"), F.explode(missing_fields(table, rows.columns)).alias("field"))


def two_person_check(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """Sign-off requests (id, checker) on rows (id, verified_by): the checker must be someone else."""
    x = requests.join(rows.select("id", "verified_by"), "id")
    same = F.lower(F.trim("checker")) == F.lower(F.trim("verified_by"))
    return x.select("id", "checker", F.when(same, "REJECTED").otherwise("ACCEPTED").alias("outcome"), F.when(~same, F.col("checker")).alias("second_checked_by"))


def apply_row_updates(rows: DataFrame, updates: DataFrame, fields: tuple[str, ...], as_of: datetime.date) -> DataFrame:
    """Last update (id, ts, fields, new_evidence) of each row: set fields replace, new evidence also renews ``verified_on``."""
    u = updates.groupBy("id").agg(F.max_by(F.struct(*fields, "new_evidence"), "ts").alias("u"))
    x = rows.join(u, "id", "left")
    x = x.withColumns({f: F.coalesce(F.col(f"u.{f}"), F.col(f)) for f in fields})
    renewed = F.col("u.new_evidence").isNotNull()
    return x.withColumns({"verified_on": F.when(renewed, F.lit(as_of)).otherwise(F.col("verified_on")), "evidence_ref": F.coalesce("u.new_evidence", "evidence_ref")}).drop("u")


def unverified_queue(rows: DataFrame) -> DataFrame:
    return rows.where("second_checked_by is null").orderBy(F.desc("id"))


def stale_rows(rows: DataFrame, as_of: datetime.date, days: int = 180) -> DataFrame:
    return rows.where(F.col("verified_on").isNull() | (F.col("verified_on") < F.date_sub(F.lit(as_of), days)))


def prohibited_text_scan(rows: DataFrame, key: str, columns: list[str], snippets: tuple[str, ...] = (*PROHIBITED_SNIPPETS, "unverified")) -> DataFrame:
    """(key, column_name, snippet) for every cell that holds a snippet; one pass over the rows."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lower(F.col(c).cast("string")).alias("v")) for c in columns])
    x = rows.select(key, F.explode(cells).alias("cell")).where("cell.v is not null")
    hits = F.filter(F.array(*map(F.lit, snippets)), lambda s: F.contains(F.col("cell.v"), s))
    return x.select(key, "cell.column_name", F.explode(hits).alias("snippet"))


def evidence_ref_scan(rows: DataFrame) -> DataFrame:
    return rows.where(F.lower("evidence_ref").rlike("|".join(EVIDENCE_MARKS)))


def bulk_import(rows: DataFrame, as_of: datetime.date, user: str) -> DataFrame:
    """Rows (line_no, is_number, title, publication_year, catalogue_url, evidence_ref) with the first failing reason, or stamped."""
    reason = (
        F.when(_text("is_number") == "", "missing is_number").when(_text("title") == "", "missing title").when(~_text("catalogue_url").startswith("https://"), "url must start with https://")
        .when((_text("evidence_ref") == "") | F.contains(F.upper(_text("evidence_ref")), F.lit("UNVERIFIED")), "evidence missing or unverified")
    )
    ok = F.col("reason").isNull()
    x = rows.withColumn("reason", reason)
    year = F.when(_text("publication_year").rlike("^[0-9]+$"), F.expr("try_cast(trim(publication_year) as int)"))
    return x.withColumns({"publication_year": year, "verified_on": F.when(ok, F.lit(as_of)), "verified_by": F.when(ok, F.lit(user))})


def import_report(checked: DataFrame) -> DataFrame:
    bad = F.when(F.col("reason").isNotNull(), F.struct("line_no", "reason"))
    return checked.agg(F.count("*").alias("total"), F.count_if(F.col("reason").isNull()).alias("imported"), F.count("reason").alias("rejected"), F.to_json(F.array_sort(F.collect_list(bad))).alias("errors"))


def coverage_report(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n, verified, awaiting, failed, dates) of each checked table."""
    out = None
    for name, rows in tables.items():
        x = provenance_status(rows, name).groupBy().agg(
            F.count("*").alias("n"), *[F.count_if(F.col("provenance_status") == s).alias(c) for s, c in (("VERIFIED", "verified"), ("AWAITING_SECOND_CHECK", "awaiting"), ("FAIL", "failed"))],
            F.array_join(F.array_sort(F.collect_set(F.expr("nullif(trim(cast(verified_on as string)), '')"))), ",").alias("dates"),
        ).withColumn("table_name", F.lit(name))
        out = x if out is None else out.unionByName(x)
    return out


def coverage_counts(products: DataFrame, standards: DataFrame, maps: DataFrame, certification: DataFrame, links: DataFrame) -> DataFrame:
    """One row: products, families, standards, mapped pairs, certification rules and links."""
    n = lambda x, c: x.agg(F.count("*").alias(c))
    x = products.agg(F.count("*").alias("products"), F.count_distinct("family").alias("families"))
    for y, c in ((standards, "standards"), (maps, "maps"), (certification, "certification_rules"), (links, "links")):
        x = x.join(n(y, c))  # rows of one each
    return x

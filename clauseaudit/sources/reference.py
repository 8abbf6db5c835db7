"""Reference data as small dimension tables, and the rule catalogue."""

from __future__ import annotations

import dataclasses
import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauseaudit.functions.text import parse_synonyms

RULE_SET_VERSION = "0.1.0"

# Id, name, severity and message of each rule.
RULES = (
    ("R01", "Unknown citation", "CANNOT_VERIFY", "This standard is not in our dataset, so we cannot check it."),
    ("R02", "Superseded or withdrawn", "ERROR", "The catalogue shows this standard as {status} (verified {verified_on})."),
    ("R03", "Year differs", "WARNING", "The clause cites {cited_year}. The catalogue shows {catalogue_year} (verified {verified_on})."),
    ("R04", "Part or section mismatch", "WARNING", "The cited part or section differs from the catalogue record (verified {verified_on})."),
    ("R05", "Differs from certification list", "ERROR", "The certification list specifies {specified} for this product. This clause cites {cited}. (verified {verified_on})"),
    ("R06", "Certification not mentioned", "WARNING", "A certification requirement is listed for this product and the clause does not mention it (verified {verified_on})."),
    ("R07", "No standard cited", "WARNING", "No standard is cited for this product. The dataset lists {standards} (verified {verified_on})."),
    ("R08", "Allied standard absent", "INFO", "A verified link lists {allied} alongside the cited standard (verified {verified_on})."),
    ("R09", "Vague wording", "INFO", "This wording does not name a standard: {explanation}"),
    ("R10", "Abstain", "CANNOT_VERIFY", "No applicable standard in our dataset."),
    ("R11", "Internal contradiction", "WARNING", "This standard is cited with different years or parts at {location_a} and {location_b}."),
    ("R12", "Malformed citation", "INFO", "This citation looks close to {candidate}. Please confirm."),
    ("R13", "Wrong product family", "WARNING", "The dataset links this standard to {other_product}, not this product (verified {verified_on})."),
    ("R14", "Stale row", "INFO", "A source row used here was last verified on {verified_on}."),
)
SEVERITY = {r[0]: r[2] for r in RULES}
MESSAGE = {r[0]: r[3] for r in RULES}
# Fixed value: the explanation of a term that has none.
NO_EXPLANATION = "Refers to quality generally without specifying a standard number."

STANDARD = "id int, is_number string, part string, publication_year int, status string, catalogue_url string, verified_on date, is_conflict boolean"
PRODUCT = "id int, canonical_name string, family string, synonyms_en string, synonyms_hi string"
MAP = "id int, product_id int, standard_id int, source_url string, verified_on date, is_conflict boolean"
CERTIFICATION = "id int, product_id int, specified_standard_id int, scheme string, instrument string, source_url string, verified_on date, is_conflict boolean"
LINK = "id int, source_standard_id int, target_standard_id int, source_url string, verified_on date, is_conflict boolean"
VAGUE = "id int, term string, language string, explanation string"


@dataclasses.dataclass
class ReferenceData:
    """The lookups that rules read; any DataFrames with these columns will do."""

    standards: DataFrame
    products: DataFrame
    maps: DataFrame
    certification_rules: DataFrame
    links: DataFrame
    vague_terms: DataFrame
    as_of: datetime.date
    stale_days: int = 180


def rule_catalogue(spark: SparkSession) -> DataFrame:
    """The fixed rules as catalogue rows, enabled and valid at all times; ``operators.catalogue`` evaluates such rows."""
    schema = "rule_id string, name string, severity string, message_en string, message_hi string, rule_set_version string, enabled boolean, valid_from date, valid_to date"
    return spark.createDataFrame([(*r, None, RULE_SET_VERSION, True, None, None) for r in RULES], schema)


def product_terms(products: DataFrame) -> DataFrame:
    """(product_id, canonical_name, family, term, position) of names (position 0) and synonyms, English before Hindi."""
    terms = F.concat(F.array("canonical_name"), parse_synonyms(F.col("synonyms_en")), parse_synonyms(F.col("synonyms_hi")))
    return products.select(F.col("id").alias("product_id"), "canonical_name", "family", F.posexplode(terms).alias("position", "term"))


def load_reference_tables(spark: SparkSession, folder: str, strict: bool = True) -> dict[str, DataFrame]:
    """Five CSV files to dimensions with ids and resolved natural keys.

    A table is ``<name>.csv``: one file, or a folder of files with a header each, which count in order of their names.  ``line_no`` is a row's place in
    its file, the header being 1.  Rows with provenance problems stop a strict load; otherwise they go to ``quarantine``.  The first row of a
    natural key (by file, then line) wins and rows whose keys do not resolve are dropped."""
    from clauseaudit.operators.provenance import provenance_check

    read = lambda name: numbered(spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(f"{folder}/{name}.csv"))
    good, bad = {}, []
    for name in ("standards", "product_standard_map", "certification_rules", "allied_links"):
        x = provenance_check(read(name), name)
        bad.append(x.where(F.size("problems") > 0).select(F.lit(name).alias("table_name"), "file", "line_no", "problems"))
        good[name] = x.where(F.size("problems") == 0).drop("problems")
    quarantine = bad[0].unionByName(bad[1]).unionByName(bad[2]).unionByName(bad[3])
    if strict and (first := quarantine.orderBy("table_name", "file", "line_no").limit(1).collect()):
        raise ValueError(f"{first[0]['table_name']} line {first[0]['line_no']}: {'; '.join(first[0]['problems'])}")
    first_of = lambda x, *keys: with_ids(_first(x, keys))
    standards = first_of(good["standards"], "is_number")
    standards = standards.join(standards.select(F.col("id").alias("superseded_by_id"), F.col("is_number").alias("superseded_by")), "superseded_by", "left") if "superseded_by" in standards.columns else standards
    products = first_of(read("products"), "canonical_name")
    s = standards.select(F.col("id").alias("standard_id"), "is_number")
    p = products.select(F.col("id").alias("product_id"), F.col("canonical_name").alias("product"))
    maps = with_ids(good["product_standard_map"].join(p, "product").join(s, "is_number"))
    cert = with_ids(good["certification_rules"].join(p, "product").join(s.toDF("specified_standard_id", "specified_is_number"), "specified_is_number"))
    links = with_ids(good["allied_links"].join(s.toDF("source_standard_id", "from_is_number"), "from_is_number").join(s.toDF("target_standard_id", "to_is_number"), "to_is_number"))
    return {"standards": standards, "products": products, "product_standard_map": maps, "certification_rules": cert, "allied_links": links, "quarantine": quarantine}


def _first(x: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("file", "line_no")
    return x.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def numbered(x: DataFrame) -> DataFrame:
    """``x``, read from files that are not split, with ``file`` (its name) and ``line_no``.

    A task reads a file from its start to its end, so a row's number is its distance from the file's first row; one row a file is
    shuffled and joined back."""
    x = x.withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)).withColumn("_id", F.monotonically_increasing_id())
    first = x.groupBy("file").agg(F.min("_id").alias("_first"))
    return x.join(first, "file").withColumn("line_no", F.col("_id") - F.col("_first") + 2).drop("_id", "_first")


def with_ids(x: DataFrame) -> DataFrame:
    """Dense ids from 1 in order of file and line: each file's rows are numbered apart, and the counts of the files before are added."""
    from pyspark.sql import Window

    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    offset = x.groupBy("file").agg(F.count("*").alias("_n")).select("file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    own = F.row_number().over(Window.partitionBy("file").orderBy("line_no", *[c for c in x.columns if c not in ("file", "line_no")]))
    return x.withColumn("_own", own).join(offset, "file").withColumn("id", (F.col("_own") + F.col("_offset")).cast("int")).drop("_own", "_offset")


def empty_reference(spark: SparkSession, as_of: datetime.date, **tables: DataFrame) -> ReferenceData:
    """Reference data with the given tables, the others empty."""
    schemas = {"standards": STANDARD, "products": PRODUCT, "maps": MAP, "certification_rules": CERTIFICATION, "links": LINK, "vague_terms": VAGUE}
    filled = {k: tables.get(k, spark.createDataFrame([], T._parse_datatype_string(v))) for k, v in schemas.items()}
    return ReferenceData(**filled, as_of=as_of)

"""The fourteen rules as joins of clauses, citations and products with the reference tables.

``Facts`` holds the frames that rules share; each rule is a function of it that returns findings.  Only R11, document-scope R08
and the per-clause flags of R10 group rows, by document or clause.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clauseaudit.functions.text import base_number, finding_id, is_stale, mentions_certification, render
from clauseaudit.operators.catalogue import apply_catalogue
from clauseaudit.operators.extract import match_vague_terms
from clauseaudit.operators.mapping import first_near, resolve_product, resolve_standard
from clauseaudit.sources.reference import MESSAGE, NO_EXPLANATION, RULE_SET_VERSION, SEVERITY, ReferenceData

KEY = ("doc_id", "clause_id")
_EVIDENCE = {"url": "string", "verified_on": "string", "row_id": "int", "instrument": "string", "candidate": "string", "term": "string", "explanation": "string", "other_product": "string", "locations": "array<string>"}


@dataclasses.dataclass
class Facts:
    clauses: DataFrame  # doc_id, clause_id, ordinal, text, mentions_certification
    resolved: DataFrame  # citations with std and base_number
    near: DataFrame  # is_number, candidate of unresolved citations
    products: DataFrame  # doc_id, clause_id, product (resolved, distinct)
    abstained: DataFrame  # doc_id, clause_id, span of clauses on which R10 fires
    vague: DataFrame  # doc_id, clause_id, span, term, explanation
    cited: DataFrame  # scope key and number
    reference: ReferenceData
    document_scope: bool
    citations: DataFrame  # doc_id, clause_id, ordinal, cit_no, span_start, span_end, number (its base), year, part
    extracted: DataFrame  # the citations as they came, with base_number; the frames above derive from it
    catalogue: DataFrame | None = None  # versions of rules (see operators.catalogue); without them the fixed rules hold
    audit_dates: DataFrame | None = None  # doc_id, audit_date: which version holds; without it that of reference.as_of
    keep: Callable[[DataFrame, str], DataFrame] | None = None  # stores a frame under a name; where there is one, frames that several rules read are stored already
    rows: dict[str, DataFrame] = dataclasses.field(default_factory=dict)  # joined rows of R05, R06, R08 and R13 that are stored, for them and R14
    source: DataFrame | None = None  # what clauses, citations and mentions are made of, if making it again costs more than reading it


def build_facts(clauses: DataFrame, citations: DataFrame, mentions: DataFrame, reference: ReferenceData, vague: DataFrame | None = None, document_scope: bool = True, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> Facts:
    """``clauses`` (doc_id, clause_id, ordinal, text), ``citations`` (doc_id, clause_id, ordinal, cit_no, raw, span_start, span_end, is_number, part, year),
    ``mentions`` (doc_id, clause_id, pos, text, span_start, span_end, canonical_product_id), ``vague`` phrases extracted elsewhere.

    ``keep`` stores a frame under a name and gives it back: with it the frames that several rules read are stored once, and the rules read of them the
    columns that they need."""
    held = keep or (lambda x, name: x)
    flag = F.col("mentions_certification") if "mentions_certification" in clauses.columns else None
    clauses = clauses.withColumn("mentions_certification", mentions_certification(F.col("text"), flag))
    extracted = citations.withColumn("base_number", base_number(F.col("is_number")))
    resolved = held(resolve_standard(extracted, reference.standards), "resolved")
    if keep:
        extracted = resolved.drop("std")
    near = held(first_near(resolved.where("std is null"), reference.standards), "near")
    m = resolve_product(mentions, reference.products)
    products = held(m.where("product is not null").select(*KEY, "product").distinct(), "products")
    cites = extracted.select(*KEY).distinct()
    none = m.groupBy(*KEY).agg(F.count("product").alias("n"), F.min(F.struct("pos", "span_start", "span_end")).alias("f")).where("n = 0")
    abstained = none.join(cites, list(KEY), "left_anti").select(*KEY, "f.span_start", "f.span_end")
    found = match_vague_terms(clauses.select(*KEY, "text"), reference.vague_terms)
    found = found.select(*KEY, "span_start", "span_end", F.col("phrase").alias("term"), "explanation")
    if vague is not None:
        found = found.join(vague.select(*KEY).distinct(), list(KEY), "left_anti").unionByName(vague.select(*KEY, "span_start", "span_end", "term", "explanation"))
    scope = ["doc_id"] if document_scope else list(KEY)
    cited = held(extracted.select(*scope, F.col("base_number").alias("number")).distinct(), "cited")
    places = extracted.select(*KEY, "ordinal", "cit_no", "span_start", "span_end", F.col("base_number").alias("number"), "year", "part")
    return Facts(clauses, resolved, near, products, abstained, found, cited, reference, document_scope, places, extracted, keep=keep)


def _finding(x: DataFrame, rule: str, params: dict[str, Column] | None = None, conflict: Column | None = None, span: bool = True, message: Column | None = None, **evidence: Column) -> DataFrame:
    """Rows of the finding's schema; ``message`` is the rendered text where it is at hand."""
    severity = F.lit(SEVERITY[rule])
    if conflict is not None:
        severity = F.when(F.coalesce(conflict, F.lit(False)), "CANNOT_VERIFY").otherwise(severity)
    message = render(MESSAGE[rule], params or {}) if message is None else message
    start, end = (F.col("span_start"), F.col("span_end")) if span else (F.lit(None).cast("int"),) * 2
    proof = F.struct(*[evidence.get(k, F.lit(None)).cast(t).alias(k) for k, t in _EVIDENCE.items()])
    return x.select(
        finding_id(F.lit(rule), F.col("doc_id"), F.col("clause_id"), start, message, proof["row_id"]).alias("finding_id"), F.lit(rule).alias("rule_id"), severity.alias("severity"), "doc_id", "clause_id",
        start.alias("span_start"), end.alias("span_end"), message.alias("message_en"), F.lit(None).cast("string").alias("message_hi"),
        F.when(F.lit(bool(evidence)), proof).alias("evidence"), F.lit(RULE_SET_VERSION).alias("rule_set_version"),
        _params(params or {}).alias("_params"), F.coalesce(F.lit(False) if conflict is None else conflict, F.lit(False)).alias("_conflict"),
    )


def _params(params: dict[str, Column]) -> Column:
    """Values of a message's placeholders, for catalogues that word it in another way."""
    items = [x for name, c in params.items() for x in (F.lit(name), F.coalesce(c.cast("string"), F.lit("")))]
    return F.create_map(*items).cast("map<string,string>")


def _date(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _conflict() -> Column:
    return F.coalesce(F.col("std.is_conflict"), F.lit(False)) | (F.coalesce("std.status", F.lit("")) == "CONFLICT")


def _known(f: Facts) -> DataFrame:
    return f.resolved.where("std is not null")


def _std_finding(x: DataFrame, rule: str, **params: Column) -> DataFrame:
    return _finding(x, rule, {**params, "verified_on": _date("std.verified_on")}, _conflict(), url=F.col("std.catalogue_url"), verified_on=_date("std.verified_on"), row_id=F.col("std.id"))


def r01_unknown_citation(f: Facts) -> DataFrame:
    return _finding(f.resolved.where("std is null").join(f.near, "is_number", "left_anti"), "R01")


def r02_withdrawn(f: Facts) -> DataFrame:
    return _std_finding(_known(f).where("std.status in ('Withdrawn', 'Superseded') and std.verified_on is not null"), "R02", status=F.col("std.status"))


def r03_year_differs(f: Facts) -> DataFrame:
    x = _known(f).where("year <> 0 and std.publication_year <> 0 and year <> std.publication_year")
    return _std_finding(x, "R03", cited_year=F.col("year"), catalogue_year=F.col("std.publication_year"))


def r04_part_mismatch(f: Facts) -> DataFrame:
    return _std_finding(_known(f).where("std.part <> '' and coalesce(trim(part), '') <> trim(std.part)"), "R04")


def _certified(f: Facts) -> DataFrame:
    """Mapped products with their certification rules (struct cert)."""
    c = f.reference.certification_rules
    return f.products.withColumn("product_id", F.col("product.id")).join(c.select("product_id", F.struct(*c.columns).alias("cert")), "product_id")


def _r05_rows(f: Facts) -> DataFrame:
    spec = f.reference.standards.select(F.col("id").alias("spec_id"), F.col("is_number").alias("specified"))
    x = _known(f).join(_certified(f), list(KEY))
    return x.join(spec, F.col("cert.specified_standard_id") == F.col("spec_id")).where("spec_id <> std.id")


def _rows(f: Facts, rule: str) -> DataFrame:
    """The joined rows of a rule, where they are stored or made again."""
    return f.rows[rule] if rule in f.rows else JOINED[rule](f)


def r05_cert_list_differs(f: Facts) -> DataFrame:
    params = {"specified": F.col("specified"), "cited": F.col("raw"), "verified_on": _date("cert.verified_on")}
    return _finding(_rows(f, "R05"), "R05", params, _conflict() | F.coalesce("cert.is_conflict", F.lit(False)), url=F.col("cert.source_url"), verified_on=_date("cert.verified_on"), row_id=F.col("cert.id"), instrument=F.col("cert.instrument"))


def _r06_rows(f: Facts) -> DataFrame:
    return _certified(f).join(f.clauses.where("not mentions_certification").select(*KEY), list(KEY), "left_semi")


def r06_cert_not_mentioned(f: Facts) -> DataFrame:
    return _finding(_rows(f, "R06"), "R06", {"verified_on": _date("cert.verified_on")}, F.col("cert.is_conflict"), span=False, url=F.col("cert.source_url"), verified_on=_date("cert.verified_on"), row_id=F.col("cert.id"), instrument=F.col("cert.instrument"))


def uncited_products(f: Facts) -> DataFrame:
    """(doc_id, clause_id, product_id) of products in clauses that cite nothing: what R07 says of them depends on the reference tables alone."""
    return f.products.join(f.resolved.select(*KEY).distinct(), list(KEY), "left_anti").select(*KEY, F.col("product.id").alias("product_id"))


def _listed() -> dict[str, Column]:
    """Values of R07's message from a row of ``standard_texts``."""
    return {"standards": F.coalesce(F.expr("nullif(names, '')"), F.lit("standards in catalogue")), "verified_on": F.coalesce("first.verified_on", F.lit("verified date not recorded"))}


def standard_texts(reference: ReferenceData) -> DataFrame:
    """(product_id, names, first, text): what R07 says of each product that has maps.  The text names all its standards, so it is made once here."""
    m = reference.maps.join(reference.standards.select(F.col("id").alias("standard_id"), "is_number"), "standard_id", "left")
    first = F.min(F.when(F.col("verified_on").isNotNull(), F.struct("id", F.col("verified_on").cast("string").alias("verified_on"), "source_url")))
    names = F.array_sort(F.collect_list(F.when(F.col("is_number").isNotNull(), F.struct("id", "is_number"))))
    m = m.groupBy("product_id").agg(F.array_join(F.transform(names, lambda z: z["is_number"]), ", ").alias("names"), first.alias("first"))
    return m.withColumn("text", render(MESSAGE["R07"], _listed()))


def _with_texts(uncited: DataFrame, reference: ReferenceData) -> DataFrame:
    """``uncited_products`` with their rows of ``standard_texts``; a product without maps has a text too."""
    # One row a product, whose text names its standards: by a shuffle all clauses of a product would meet in one task.
    x = uncited.join(F.broadcast(standard_texts(reference)), "product_id", "left")
    none = render(MESSAGE["R07"], {"standards": F.lit("standards in catalogue"), "verified_on": F.lit("verified date not recorded")})
    return x.withColumn("text", F.coalesce("text", none))


def no_standard_findings(uncited: DataFrame, reference: ReferenceData) -> DataFrame:
    """R07's findings of ``uncited_products``."""
    x = _with_texts(uncited, reference)
    return _finding(x, "R07", _listed(), span=False, message=F.col("text"), url=F.col("first.source_url"), verified_on=F.col("first.verified_on"), row_id=F.col("first.id"))


_ROOM = "parquet.dictionary.page.size"


def room_for_texts(reference: ReferenceData, session: SparkSession | None = None) -> None:
    """Lets the session's Parquet writers keep the texts of R07 as a dictionary: one text a product and row group, not one a finding.  A stream's batches
    have a session of their own.

    Parquet's own bound of 1 MB holds the texts of some ten thousand maps; beyond it every finding's text would be written out."""
    conf = (session or reference.maps.sparkSession).conf
    need = standard_texts(reference).agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    if need > int(conf.get(_ROOM, str(1 << 20))):
        conf.set(_ROOM, str(min(need + (need >> 2), (1 << 31) - 1)))


def keyed_findings(f: Facts) -> tuple[DataFrame, DataFrame]:
    """Findings of all rules under the fixed catalogue, those of R07 with a ``text_key`` in their message's place, and the messages by key."""
    others = evaluate(f, tuple(r for r in RULES if r != "R07")).select(*KEY, "rule_id", "severity", "span_start", "message_en")
    own = uncited_products(f).select(*KEY, F.lit("R07").alias("rule_id"), F.lit(SEVERITY["R07"]).alias("severity"), F.col("product_id").alias("text_key"))
    texts = _with_texts(f.reference.products.select(F.col("id").alias("product_id")).distinct(), f.reference).select(F.col("product_id").alias("text_key"), "text")
    return others.unionByName(own, allowMissingColumns=True), texts


def r07_no_standard_cited(f: Facts) -> DataFrame:
    return no_standard_findings(uncited_products(f), f.reference)


def _r08_rows(f: Facts) -> DataFrame:
    links = f.reference.links
    target = f.reference.standards.select(F.col("id").alias("_t"), F.col("is_number").alias("allied"))
    dim = links.select(F.col("source_standard_id").alias("std_id"), F.struct(*links.columns).alias("link")).join(target, F.col("link.target_standard_id") == F.col("_t"))
    dim = dim.withColumn("allied_base", base_number(F.col("allied")))
    scope = ["doc_id"] if f.document_scope else list(KEY)
    x = _known(f).withColumn("std_id", F.col("std.id")).join(dim, "std_id").withColumn("link_id", F.col("link.id"))
    # Links whose target is cited, by either of its numbers: one anti-join over the few citations of targets.
    numbers = dim.select(F.col("link.id").alias("link_id"), F.explode(F.array("allied", "allied_base")).alias("number"))
    return x.join(f.cited.join(numbers, "number").select(*scope, "link_id").distinct(), [*scope, "link_id"], "left_anti")


def r08_allied_absent(f: Facts) -> DataFrame:
    return _finding(_rows(f, "R08"), "R08", {"allied": F.col("allied"), "verified_on": _date("link.verified_on")}, _conflict() | F.coalesce("link.is_conflict", F.lit(False)), url=F.col("link.source_url"), verified_on=_date("link.verified_on"), row_id=F.col("link.id"))


def r09_vague_wording(f: Facts) -> DataFrame:
    why = F.coalesce("explanation", F.lit(NO_EXPLANATION))
    return _finding(f.vague, "R09", {"explanation": why}, term=F.col("term"), explanation=why)


def r10_abstain(f: Facts) -> DataFrame:
    return _finding(f.abstained, "R10")


def first_two_locations(citations: DataFrame) -> DataFrame:
    """doc_id, number, a and b: the first two places of each number that a document cites more than once.  Each task keeps its own two
    places of a number before anything is shuffled."""
    order = ["ordinal", "cit_no", "clause_id", "span_start", "span_end"]
    key = ["doc_id", "number"]
    two = citations.select(*key, *order).withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("place <= 2")
    at = lambda n: F.max(F.when(F.col("place") == n, F.struct(*order)))
    return two.groupBy(*key).agg(at(1).alias("a"), at(2).alias("b")).where("b is not null")


def r11_contradiction(f: Facts) -> DataFrame:
    differ = lambda c: F.coalesce(F.min(c) != F.max(c), F.lit(False))
    odd = f.citations.groupBy("doc_id", "number").agg((differ("year") | differ("part")).alias("odd")).where("odd").select("doc_id", "number")
    x = first_two_locations(f.citations).join(odd, ["doc_id", "number"])
    x = x.select("doc_id", F.col("a.clause_id").alias("clause_id"), "a.span_start", "a.span_end", F.col("b.clause_id").alias("b_clause"))
    return _finding(x, "R11", {"location_a": F.col("clause_id"), "location_b": F.col("b_clause")}, locations=F.array("clause_id", "b_clause"))


def r12_malformed(f: Facts) -> DataFrame:
    return _finding(f.resolved.where("std is null").join(f.near, "is_number"), "R12", {"candidate": F.col("candidate")}, candidate=F.col("candidate"))


def _r13_rows(f: Facts) -> DataFrame:
    maps = f.reference.maps
    dim = maps.select(F.col("standard_id").alias("std_id"), F.struct(*maps.columns).alias("map"))
    other = f.reference.products.select(F.col("id").alias("_o"), F.col("canonical_name").alias("other_product"), F.col("family").alias("other_family"))
    dim = dim.join(other, F.col("map.product_id") == F.col("_o"))
    x = _known(f).join(f.products, list(KEY)).withColumn("std_id", F.col("std.id")).withColumn("product_id", F.col("product.id"))
    own = maps.select(F.col("standard_id").alias("std_id"), "product_id").distinct()
    x = x.join(own, ["std_id", "product_id"], "left_anti")
    # For each pair of standard and family the first map of another family, found among the few reference rows.
    families = f.reference.products.select("family").distinct()
    first = dim.join(families, F.col("other_family") != F.col("family")).groupBy("std_id", "family").agg(F.min_by(F.struct("map", "other_product"), F.col("map.id")).alias("hit"))
    return x.withColumn("family", F.col("product.family")).join(first, ["std_id", "family"]).select(*x.columns, "hit.map", "hit.other_product")


def r13_wrong_family(f: Facts) -> DataFrame:
    params = {"other_product": F.col("other_product"), "verified_on": _date("map.verified_on")}
    return _finding(_rows(f, "R13"), "R13", params, _conflict() | F.coalesce("map.is_conflict", F.lit(False)), url=F.col("map.source_url"), verified_on=_date("map.verified_on"), row_id=F.col("map.id"), other_product=F.col("other_product"))


#: Rules whose joined rows R14 reads too.
JOINED: dict[str, Callable[[Facts], DataFrame]] = {"R05": _r05_rows, "R06": _r06_rows, "R08": _r08_rows, "R13": _r13_rows}


def used_rows(f: Facts) -> DataFrame:
    """Reference rows that a clause's findings rest on, once for each (clause, table, row)."""
    take = lambda x, table, s: x.select(*KEY, F.lit(table).alias("table_name"), F.col(f"{s}.id").alias("row_id"), F.col(f"{s}.verified_on").alias("verified_on"))
    x = take(_known(f), "standards", "std").unionByName(take(_rows(f, "R06"), "certification_rules", "cert")).unionByName(take(_rows(f, "R05"), "certification_rules", "cert"))
    return x.unionByName(take(_rows(f, "R13"), "product_standard_map", "map")).unionByName(take(_rows(f, "R08"), "allied_links", "link")).distinct()


def r14_stale_row(f: Facts) -> DataFrame:
    x = used_rows(f).where(is_stale(F.lit(f.reference.as_of), F.col("verified_on"), f.reference.stale_days))
    return _finding(x, "R14", {"verified_on": _date("verified_on")}, span=False, row_id=F.col("row_id"), verified_on=_date("verified_on"))


RULES: dict[str, Callable[[Facts], DataFrame]] = {
    "R01": r01_unknown_citation, "R02": r02_withdrawn, "R03": r03_year_differs, "R04": r04_part_mismatch, "R05": r05_cert_list_differs, "R06": r06_cert_not_mentioned,
    "R07": r07_no_standard_cited, "R08": r08_allied_absent, "R09": r09_vague_wording, "R10": r10_abstain, "R11": r11_contradiction, "R12": r12_malformed, "R13": r13_wrong_family, "R14": r14_stale_row,
}


FACTS = ("clauses", "extracted", "resolved", "near", "products", "cited")


def shared(f: Facts) -> Facts:
    """The frames that several rules read, kept for the session (``spark.catalog.clearCache`` frees them; lost blocks are computed again).

    The source comes first and is kept in the clauses' place, then the citations: what derives from them reads them where they are kept, so clauses are made once
    and the pattern runs over each once."""
    return dataclasses.replace(f, **{n: getattr(f, n).persist(StorageLevel.MEMORY_AND_DISK) for n in _kept(f)})


def _kept(f: Facts) -> tuple[str, ...]:
    return FACTS if f.source is None else ("source", *FACTS[1:])


def release(f: Facts) -> None:
    """Frees what ``shared`` keeps."""
    for n in _kept(f):
        getattr(f, n).unpersist()


def evaluate(f: Facts, rules: tuple[str, ...], share: bool = True) -> DataFrame:
    """Findings of ``rules``; with ``share`` off the caller keeps (and frees) the shared frames itself."""
    if f.keep is not None and "R14" in rules:
        f = dataclasses.replace(f, rows={r: f.keep(rows(f), f"rows_{r}") for r, rows in JOINED.items()})
    if not share or f.keep is not None:
        pass
    elif len(rules) > 1 or rules[0] in ("R08", "R14"):  # these read the citations more than once
        f = shared(f)
    elif rules[0] == "R11":
        f = dataclasses.replace(f, citations=f.citations.persist(StorageLevel.MEMORY_AND_DISK))
    out = RULES[rules[0]](f)
    for r in rules[1:]:
        out = out.unionByName(RULES[r](f))
    return out.drop("_params", "_conflict") if f.catalogue is None else apply_catalogue(out, f.catalogue, f.reference.as_of, f.audit_dates)


def evaluate_documents(f: Facts) -> DataFrame:
    """All rules; R08 and R11 look at whole documents."""
    return evaluate(f, tuple(RULES))


def evaluate_clauses(f: Facts) -> DataFrame:
    """All rules but R11, each clause alone."""
    return evaluate(f, tuple(r for r in RULES if r != "R11"))

"""Audits that are kept up to date: after edits of clauses and of reference rows only what depends on them is extracted and evaluated again.

The state of an audit is six tables: clauses, citations, mentions, findings of all rules but R07, the products that R07 finds uncited, and an index of what
each clause depends on, as (kind, key):

* ``number``: the cited numbers, whole and base, by which standards are found; ``near``: these numbers with one character
  deleted, of citations that resolve to nothing, by which near matches are found;
* ``standard``, ``product``: the catalogue rows that a clause resolved to; ``term``: the texts by which products are found.

A finding of R07 names all standards of a product.  Such texts are neither stored nor shuffled: the findings are made of the uncited products and the
reference tables when they are read, so a change of the maps touches no clause for them.

A change of a reference row touches the keys that its old and its new version have (``touched_keys``), and those of the rows
that name it.  One semi-join of the index with them gives the clauses to evaluate, before anything is evaluated.  Edited documents add
all their clauses, since R08 and R11 look at whole documents; those come from the stored citations.  Only edited clauses are extracted.  A changed
vague term adds the clauses that hold its text.  Too many clauses cost time; none may be missing.

Changes of ``as_of`` or of the limit of days touch every row and need ``audit``.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseaudit.functions.text import base_number
from clauseaudit.operators import rules
from clauseaudit.operators.extract import match_vague_terms
from clauseaudit.operators.mapping import _variants
from clauseaudit.sources.reference import ReferenceData, product_terms
from clauseaudit.sources.scratch import put

KEY = ["doc_id", "clause_id"]
OTHERS = tuple(r for r in rules.RULES if r != "R07")
Extract = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


@dataclasses.dataclass
class State:
    """Tables of an audit."""

    clauses: DataFrame  # doc_id, clause_id, ordinal, text, others
    citations: DataFrame
    mentions: DataFrame
    findings: DataFrame
    index: DataFrame  # doc_id, clause_id, kind, key
    others: DataFrame  # findings of all rules but R07
    uncited: DataFrame  # doc_id, clause_id, product_id


def _keys(*numbers: Column) -> Column:
    return F.array_distinct(F.array(*numbers))


def depends(f: rules.Facts, mentions: DataFrame) -> DataFrame:
    """(doc_id, clause_id, kind, key) of the clauses of ``f``."""
    key = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.cast("string").alias("key"))
    whole, base = F.col("is_number"), F.col("base_number")
    number = F.transform(_keys(whole, base), lambda n: key("number", n))
    near = F.when(F.col("std").isNull(), F.transform(F.array_distinct(F.concat(_variants(whole), _variants(base))), lambda v: key("near", v)))
    standard = F.when(F.col("std").isNotNull(), F.array(key("standard", F.col("std.id"))))
    nothing = F.array().cast("array<struct<kind:string,key:string>>")
    cited = f.resolved.select(*KEY, F.explode(F.concat(number, *[F.coalesce(x, nothing) for x in (near, standard)])).alias("k"))
    named = mentions.select(*KEY, F.explode(F.array(*[key("term", F.lower(c)) for c in ("text", "canonical_product_id")])).alias("k"))
    made = f.products.select(*KEY, key("product", F.col("product.id")).alias("k"))
    return cited.unionByName(named).unionByName(made).select(*KEY, "k.kind", "k.key").where("key is not null").distinct()


def _findings(others: DataFrame, uncited: DataFrame, reference: ReferenceData) -> DataFrame:
    return others.unionByName(rules.no_standard_findings(uncited, reference).select(*others.columns))


def audit(clauses: DataFrame, reference: ReferenceData, extract: Extract, folder: str) -> State:
    """A whole audit, its tables in ``folder``; ``extract`` gives citations and mentions of clauses."""
    clauses = put(clauses, folder, "clauses")
    citations, mentions = (put(x, folder, n) for x, n in zip(extract(clauses), ("citations", "mentions")))
    f = rules.build_facts(clauses, citations, mentions, reference)
    others, uncited = put(rules.evaluate(f, OTHERS), folder, "findings"), put(rules.uncited_products(f), folder, "uncited")
    return State(clauses, citations, mentions, _findings(others, uncited, reference), put(depends(f, mentions), folder, "index"), others, uncited)


def changed_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that only one of two versions of a reference table has."""
    new = new.select(*old.columns)
    return old.exceptAll(new).unionByName(new.exceptAll(old))


def touched_keys(old: ReferenceData, new: ReferenceData) -> DataFrame:
    """(kind, key) of the index that changes from ``old`` to ``new`` touch, by old and new versions of rows."""
    diff = {n: changed_rows(getattr(old, n), getattr(new, n)) for n in ("standards", "products", "maps", "certification_rules", "links")}

    def both(name: str) -> DataFrame:
        return getattr(old, name).unionByName(getattr(new, name))

    def rows(x: DataFrame, kind: str, c: Column) -> DataFrame:
        return x.select(F.lit(kind).alias("kind"), c.alias("key")).select("kind", F.col("key").cast("string").alias("key"))

    n, b = F.col("is_number"), base_number(F.col("is_number"))
    standard_ids = diff["standards"].select(F.col("id").alias("_s"))
    product_ids = diff["products"].select(F.col("id").alias("_p"))
    # Rows that name a changed standard or product count as changed.
    certs = diff["certification_rules"].unionByName(both("certification_rules").join(standard_ids, F.col("specified_standard_id") == F.col("_s"), "left_semi"))
    maps = diff["maps"].unionByName(both("maps").join(standard_ids, F.col("standard_id") == F.col("_s"), "left_semi")).unionByName(both("maps").join(product_ids, F.col("product_id") == F.col("_p"), "left_semi"))
    links = diff["links"].unionByName(both("links").join(standard_ids, F.col("target_standard_id") == F.col("_s"), "left_semi"))
    parts = [
        rows(diff["standards"], "number", F.explode(_keys(n, b))), rows(diff["standards"], "near", F.explode(F.array_distinct(F.concat(_variants(n), _variants(b))))),
        rows(diff["standards"], "standard", F.col("id")), rows(diff["products"], "product", F.col("id")), rows(product_terms(diff["products"]), "term", F.lower("term")),
        rows(certs, "product", F.col("product_id")), rows(maps, "standard", F.col("standard_id")), rows(links, "standard", F.col("source_standard_id")),
    ]
    return reduce(DataFrame.unionByName, parts).where("key is not null").distinct()


def edited(old: DataFrame, new: DataFrame) -> DataFrame:
    """Keys of clauses that are new, gone, or have another text or place."""
    a, b = (x.select(*KEY, F.struct("ordinal", "text").alias(n)) for x, n in ((old, "a"), (new, "b")))
    return a.join(b, KEY, "full_outer").where("not (a <=> b)").select(*KEY)


def affected(state: State, clauses: DataFrame, edits: DataFrame, old: ReferenceData, new: ReferenceData) -> DataFrame:
    """Keys of the clauses to evaluate again: those of edited documents, and those that depend on changed reference rows."""
    by_row = state.index.join(touched_keys(old, new), ["kind", "key"], "left_semi").select(*KEY)
    by_term = match_vague_terms(clauses.select(*KEY, "text"), changed_rows(old.vague_terms, new.vague_terms)).select(*KEY)
    own = clauses.select(*KEY).join(edits.select("doc_id").distinct(), "doc_id", "left_semi")
    return own.unionByName(edits.select(*KEY)).unionByName(by_row).unionByName(by_term).distinct()


def update(state: State, clauses: DataFrame, old: ReferenceData, new: ReferenceData, extract: Extract, folder: str) -> State:
    """The state after edits: ``clauses`` are the clauses as they are now, ``new`` the reference data.

    What is equal to ``audit(clauses, new, extract)``, with the work of what changed.  The keys of what changed, and the clauses, citations and
    mentions to evaluate again, are tables in ``folder``; the new state is made of these and of the old one's tables when it is read."""
    edits = put(edited(state.clauses, clauses), folder, "edits")
    fresh = [put(x, folder, n) for x, n in zip(extract(clauses.join(edits, KEY, "left_semi")), ("new_citations", "new_mentions"))]
    citations, mentions = (x.join(edits, KEY, "left_anti").unionByName(y) for x, y in zip((state.citations, state.mentions), fresh))
    again = put(affected(state, clauses, edits, old, new), folder, "again")
    own = [put(x.join(again, KEY, "left_semi"), folder, f"own_{n}") for x, n in ((clauses, "clauses"), (citations, "citations"), (mentions, "mentions"))]
    f = rules.build_facts(*own, new)
    # R08 looks at the numbers of the whole document, R11 at all places of edited documents only.
    around = citations.join(again.select("doc_id").distinct(), "doc_id", "left_semi")
    docs = edits.select("doc_id").distinct()
    f = dataclasses.replace(f, cited=around.select("doc_id", base_number(F.col("is_number")).alias("number")).distinct(), citations=f.citations.join(docs, "doc_id", "left_semi"))
    whole = F.col("rule_id") == "R11"
    kept = state.others.where(~whole).join(again, KEY, "left_anti").unionByName(state.others.where(whole).join(docs, "doc_id", "left_anti"))
    others, uncited = kept.unionByName(rules.evaluate(f, OTHERS)), state.uncited.join(again, KEY, "left_anti").unionByName(rules.uncited_products(f))
    index = state.index.join(again, KEY, "left_anti").unionByName(depends(f, own[2]))
    return State(clauses, citations, mentions, _findings(others, uncited, new), index, others, uncited)

"""Product mentions to products, and citations to standards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseaudit.functions.text import WORD, base_number, normalise_mention, token_jaccard, tokens, trigram_dice, trigrams
from clauseaudit.sources.reference import product_terms


LEAST = 0.40  # of Dice's or Jaccard's coefficient for a fuzzy candidate
_TERM = ["product_id", "position"]


def _rarest(sets: DataFrame, owner: list[str], counts: DataFrame, share: float) -> DataFrame:
    """The rarest elements of each set, as many as must hold one of those that a similar set shares: all but ``share`` of them, and one."""
    x = sets.select(*owner, F.size("elements").alias("size"), F.explode("elements").alias("element")).join(counts, "element", "left")
    x = x.withColumn("at", F.row_number().over(Window.partitionBy(*owner).orderBy(F.coalesce("n", F.lit(0)), "element")))
    return x.where(F.col("at") <= F.col("size") - F.ceil(F.col("size") * F.lit(share)) + 1).select(*owner, "element")


def _similar(q: DataFrame, terms: DataFrame, elements: Callable[[Column], Column], share: float) -> DataFrame:
    """(mention, product_id, position) of pairs that share one of both sides' rarest elements: an inverted index on those of the terms."""
    of_terms = terms.select(*_TERM, elements(F.col("term")).alias("elements"))
    counts = of_terms.select(F.explode("elements").alias("element")).groupBy("element").agg(F.count("*").alias("n"))
    own = _rarest(q.select("mention", elements(F.col("_q")).alias("elements")), ["mention"], counts, share)
    return own.join(_rarest(of_terms, _TERM, counts, share), "element").select("mention", *_TERM)


def candidate_pairs(q: DataFrame, terms: DataFrame) -> DataFrame:
    """(mention, product_id, position) of all pairs that can score: equi-joins only, by equal texts, by the longest word of a synonym, and by the rarest
    trigrams and words.

    Dice of t needs t / 2 * (a + b) shared trigrams and so b >= a * t / (2 - t), that is a share of t / (2 - t) of either set; Jaccard of t
    needs a share of t."""
    runs = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(f"{WORD}+"), F.lit(0)))
    longest = F.coalesce(F.try_element_at(F.array_sort(F.transform(runs(F.col("_norm")), lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w")))), F.lit(1))["w"], F.lit(""))
    equal = q.join(terms.select(*_TERM, F.when(F.col("position") == 0, F.col("_lname")).otherwise(F.col("_norm")).alias("_q")), "_q").select("mention", *_TERM)
    # A synonym without words has the key of the empty word, which all mentions have.
    words = q.select("mention", F.explode(F.array_append(runs(F.col("_q")), "")).alias("w")).join(terms.where("position > 0").select(*_TERM, longest.alias("w")), "w").select("mention", *_TERM)
    fuzzy = _similar(q, terms, trigrams, LEAST / (2 - LEAST) - 1e-9).unionByName(_similar(q, terms.where("position > 0"), tokens, LEAST - 1e-9))
    return equal.unionByName(words).unionByName(fuzzy).distinct()


def scored_candidates(mentions: DataFrame, products: DataFrame) -> DataFrame:
    """mention, product_id, canonical_name, score, method for candidates of 0.40 or more, of distinct mentions."""
    terms = product_terms(products).withColumn("_norm", normalise_mention(F.col("term"))).withColumn("_lname", F.lower("canonical_name"))
    q = mentions.select("mention").withColumn("_q", normalise_mention(F.col("mention")))
    return score_pairs(candidate_pairs(q, terms).join(q, "mention").join(terms, _TERM))


def score_pairs(x: DataFrame) -> DataFrame:
    """The best score of each mention and product among pairs of mentions (_q) and terms."""
    is_name = F.col("position") == 0
    norm, query = F.col("_norm"), F.col("_q")
    quoted = F.regexp_replace(norm, "([\\\\.\\[\\]{}()*+?^$|\\-])", "\\\\$1")
    bounded = F.regexp_like(query, F.concat(F.lit(f"(^|(?!{WORD})(?s:.))"), quoted, F.lit(f"($|(?!{WORD})(?s:.))")))
    hit = (
        F.when(is_name, F.lit(None).cast("double"))
        .when(query == norm, 0.98)
        .when((F.length(norm) >= 3) & bounded, 0.92)
        .when((norm != "") & (F.length(norm) < 3) & F.contains(norm, query) & (token_jaccard(query, norm) >= 0.5), 0.88)
    )
    fuzzy = F.when(is_name, trigram_dice(query, F.col("term"))).otherwise(F.greatest(trigram_dice(query, F.col("term")), token_jaccard(query, F.col("term"))))
    x = x.withColumn("_hit", hit).withColumn("_exact", is_name & (query == F.col("_lname"))).withColumn("_fuzzy", fuzzy)
    # The first synonym that hits stops the scan: the hit at the least position.
    x = x.groupBy("mention", "product_id", "canonical_name").agg(
        F.max("_exact").alias("_exact"), F.min_by("_hit", F.when(F.col("_hit").isNotNull(), F.col("position"))).alias("_hit"), F.max("_fuzzy").alias("_fuzzy")
    )
    score = F.when(F.col("_exact"), 1.0).when(F.col("_hit").isNotNull(), F.col("_hit")).when(F.col("_fuzzy") >= 0.40, F.bround("_fuzzy", 3))
    method = F.when(F.col("_exact"), "EXACT").when(F.col("_hit").isNotNull(), "SYNONYM").otherwise("FUZZY")
    return x.select("mention", "product_id", "canonical_name", score.alias("score"), method.alias("method")).where("score is not null")


def map_product(mentions: DataFrame, products: DataFrame, threshold: float = 0.75) -> DataFrame:
    """One row for each distinct mention: canonical_name, product_id, confidence, method, is_unmapped and all candidates by score."""
    distinct = mentions.select("mention").distinct()
    c = scored_candidates(distinct, products)
    packed = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("_s"), "product_id", "canonical_name", "score", "method")))
    best = c.groupBy("mention").agg(packed.alias("candidates"))
    x = distinct.join(best, "mention", "left").withColumn("_top", F.try_element_at("candidates", F.lit(1)))
    mapped = F.coalesce(F.col("_top.score") >= threshold, F.lit(False))
    keep = lambda name: F.when(mapped, F.col("_top")[name])
    cands = F.coalesce(F.transform("candidates", lambda z: F.struct(z["product_id"].alias("product_id"), z["canonical_name"].alias("canonical_name"), z["score"].alias("score"), z["method"].alias("method"))), F.array())
    return x.select(
        "mention", keep("product_id").alias("product_id"), keep("canonical_name").alias("canonical_name"), F.coalesce("_top.score", F.lit(0.0)).alias("confidence"),
        F.when(mapped, F.col("_top.method")).otherwise("UNMAPPED").alias("method"), (~mapped).alias("is_unmapped"), cands.alias("candidates"),
    )


def confirm_mapping(results: DataFrame, confirmations: DataFrame) -> DataFrame:
    """Officer's last confirmation (mention, officer, notes, ts) on each result."""
    last = _latest(confirmations, "mention", "officer", "notes").select("mention", "officer", "notes")
    return results.join(last, "mention", "left").withColumn("officer_confirmed", F.col("officer").isNotNull())


def override_mapping(results: DataFrame, overrides: DataFrame, products: DataFrame) -> DataFrame:
    """Officer's last override (mention, name, officer, ts); a known name takes its canonical spelling and its product's id, another name has no
    id.  No candidates are left."""
    last = _latest(overrides, "mention", "name", "officer").select("mention", "name", "officer")
    known = products.groupBy(F.lower("canonical_name").alias("_l")).agg(F.max_by(F.struct(F.col("canonical_name").alias("name"), "id"), F.struct("canonical_name", "id")).alias("_known"))
    x = results.join(last, "mention", "left").join(known, F.lower("name") == F.col("_l"), "left").drop("_l")
    done = F.col("name").isNotNull()
    return x.withColumns({
        "canonical_name": F.when(done, F.coalesce("_known.name", "name")).otherwise(F.col("canonical_name")), "product_id": F.when(done, F.col("_known.id")).otherwise(F.col("product_id")), "confidence": F.when(done, 1.0).otherwise(F.col("confidence")),
        "method": F.when(done, "OFFICER_OVERRIDE").otherwise(F.col("method")), "is_unmapped": F.col("is_unmapped") & ~done,
        "candidates": F.when(~done, F.col("candidates")).otherwise(F.array().cast(results.schema["candidates"].dataType)),
    }).drop("name", "_known")


def _latest(x: DataFrame, key: str, *ties: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("ts"), *[F.desc(t) for t in ties])
    return x.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def standard_keys(standards: DataFrame) -> DataFrame:
    """(key, std): exact numbers, of which the last row wins, and base numbers, of which the first wins and none displaces an exact key."""
    std = F.struct(*standards.columns).alias("std")
    exact = standards.select(F.col("is_number").alias("key"), F.lit(0).alias("kind"), (-F.col("id")).alias("rank"), std)
    base = standards.select(base_number(F.col("is_number")).alias("key"), F.lit(1).alias("kind"), F.col("id").alias("rank"), std)
    w = Window.partitionBy("key").orderBy("kind", "rank")
    return exact.unionByName(base).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("key", "std")


def resolve_standard(citations: DataFrame, standards: DataFrame, alias: bool = True) -> DataFrame:
    """``citations`` with the struct ``std`` (null if unknown): by the whole number, else by its base.

    Without ``alias`` the catalogue's base numbers are no keys.  A column ``base_number`` of the citations is taken as it is."""
    if alias:
        keys = standard_keys(standards)
    else:
        w = Window.partitionBy("is_number").orderBy(F.desc("id"))
        keys = standards.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(F.col("is_number").alias("key"), F.struct(*standards.columns).alias("std"))
    x = citations if "base_number" in citations.columns else citations.withColumn("base_number", base_number(F.col("is_number")))
    whole = keys.select(F.col("key").alias("is_number"), F.col("std").alias("_whole"))
    base = keys.select(F.col("key").alias("base_number"), F.col("std").alias("_base"))
    return x.join(whole, "is_number", "left").join(base, "base_number", "left").withColumn("std", F.coalesce("_whole", "_base")).drop("_whole", "_base")


def _variants(x: Column) -> Column:
    """The string and all strings with one character deleted."""
    return F.concat(F.array(x), F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x)))))


def suggest_near(cited: DataFrame, standards: DataFrame) -> DataFrame:
    """Distinct cited numbers (is_number) -> is_number, candidate, catalogue_id for all known numbers one edit away.

    Strings one edit apart share a string or one with a character deleted; equal variants are the join key.  A number has some twenty variants, which
    Catalyst's estimate of the catalogue's size leaves out: the hint keeps them from being broadcast."""
    pair = lambda n, base: F.explode(F.array_distinct(F.concat(_variants(F.col(n)), _variants(F.col(base)))))
    a = cited.select("is_number").distinct().withColumn("_c", base_number(F.col("is_number"))).withColumn("v", pair("is_number", "_c"))
    b = standards.select(F.col("is_number").alias("candidate"), F.col("id").alias("catalogue_id"), base_number(F.col("is_number")).alias("_k")).withColumn("v", pair("candidate", "_k"))
    one = lambda p, q: F.levenshtein(p, q) == 1
    x = a.hint("merge").join(b, "v").where(one("is_number", "candidate") | one("_c", "_k") | one("is_number", "_k"))
    return x.groupBy("is_number", "candidate").agg(F.min("catalogue_id").alias("catalogue_id"))


def first_near(cited: DataFrame, standards: DataFrame) -> DataFrame:
    """The first candidate by catalogue order of each number that has one."""
    return suggest_near(cited, standards).groupBy("is_number").agg(F.min_by("candidate", "catalogue_id").alias("candidate"))


def resolve_product(mentions: DataFrame, products: DataFrame) -> DataFrame:
    """``mentions`` (..., text, canonical_product_id) with the struct ``product``: by the canonical id, else by the text; of equal names and
    synonyms the later product wins."""
    w = Window.partitionBy("key").orderBy(F.desc("product_id"), F.desc("position"))
    keys = product_terms(products).withColumn("key", F.lower("term")).withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    keys = keys.select("key", F.struct(F.col("product_id").alias("id"), "canonical_name", "family").alias("p"))
    x = mentions.withColumn("_k1", F.lower("canonical_product_id")).withColumn("_k2", F.lower("text"))
    x = x.join(keys.select(F.col("key").alias("_k1"), F.col("p").alias("_p1")), "_k1", "left").join(keys.select(F.col("key").alias("_k2"), F.col("p").alias("_p2")), "_k2", "left")
    return x.withColumn("product", F.coalesce("_p1", "_p2")).drop("_k1", "_k2", "_p1", "_p2")

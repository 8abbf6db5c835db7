"""Citations and vague wording with spans, and checks of extractions made elsewhere."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from clauseaudit.functions.text import fold_digits
from clauseaudit.llm import sketch
from clauseaudit.llm.common import Chunk, chunks, cut, mix, quoted

# The pattern of a citation. Groups: 1 prefix, 2 body, 3 number, 4 part, 5 year.
_S = "(?U:\\s)"
CITATION = (
    f"(?<![A-Za-z])((?:I\\.?{_S}?S\\.?|आई\\.?{_S}?एस\\.?))(?:{_S}*/{_S}*(IEC|ISO))?{_S}*[:.]?{_S}*(\\d{{2,6}}(?:{_S}*-{_S}*\\d{{1,4}})*)"
    f"(?:{_S}*\\(?{_S}*(?:(?i:Part)|भाग){_S}*(\\d+){_S}*\\)?)?(?:{_S}*[:/\\-]{_S}*((?:19|20)\\d{{2}})(?!\\d))?"
)
# Vague wording, English then Hindi.
VAGUE_PATTERNS = (
    "ISI\\s+quality",
    "as\\s+per\\s+BIS",
    "आईएसआई\\s+गुणवत्ता",
    "बीआईएस\\s+मानक",
    "बीआईएस\\s+के\\s+अनुसार",
    "सरकारी\\s+मानक",
    "उत्कृष्ट\\s+गुणवत्ता",
)


def _starts(matches: str, gaps: str) -> str:
    """SQL: 0-based starts of matches, from the texts between them and their own lengths."""
    return f"""transform({matches}, (x, i) -> cast(aggregate(slice({gaps}, 1, i + 1), 0, (a, y) -> a + length(y))
             + aggregate(slice({matches}, 1, i), 0, (a, y) -> a + length(y)) as int))"""


#: A citation and the text before it, from where the last one ended. Groups: 1 the citation, then those of its pattern.
_PIECE = f"(?s:.*?)(?=[Iआ])({CITATION})"
#: What the pattern takes for white space.
_WHITE = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def with_citations(clauses: DataFrame) -> DataFrame:
    """``clauses`` with an array column ``citations``; all columns of the input stay.

    One search cuts a clause into pieces that end with a citation, and one replacement in each piece gives the citation and its groups; the running lengths of the
    pieces are the spans.  Pieces and fields are bound once, as elements of arrays, so that no copy of the pattern runs over a clause again.  ``split``
    compiles its pattern for each row, so it gets single characters only."""
    pieces = F.regexp_extract_all(fold_digits(F.col("text")), F.lit(f"\\G{_PIECE}"), F.lit(0))

    def parts(z: Column) -> Column:
        end = lambda i: F.aggregate(F.slice(z, 1, i + 1), F.lit(0), lambda a, y: a + F.length(y))
        return F.transform(z, lambda p, i: F.struct(F.split(F.regexp_replace(p, f"^{_PIECE}", "$3|$4|$5|$6|$1"), "\\|", 5).alias("g"), end(i).alias("e")))

    found = F.transform(F.array(pieces), parts)[0]
    x = clauses.withColumn("_c", F.transform(found, lambda c: F.struct(c["g"].alias("g"), (c["e"] - F.length(c["g"][4])).cast("int").alias("s"), F.split(F.translate(c["g"][1], _WHITE, ""), "-").alias("n"))))
    late = "c.g[3] = '' and size(c.n) > 1 and element_at(c.n, -1) rlike '^(19|20)[0-9]{2}$'"
    item = f"""transform(_c, c -> named_struct(
        'raw', substring(text, c.s + 1, length(c.g[4])), 'span_start', c.s, 'span_end', c.s + length(c.g[4]),
        'is_number', concat(if(c.g[0] = '', 'IS ', concat('IS/', c.g[0], ' ')), array_join(if({late}, slice(c.n, 1, size(c.n) - 1), c.n), '-')),
        'part', nullif(c.g[2], ''), 'year', try_cast(if({late}, element_at(c.n, -1), nullif(c.g[3], '')) as int)))"""
    return x.withColumn("citations", F.expr(item)).drop("_c")


def extract_citations(clauses: DataFrame) -> DataFrame:
    """One row for each citation: the clause's columns (without text), cit_no and the citation's fields."""
    keep = [c for c in clauses.columns if c not in ("text", "citations")]
    # The outer form: for the plain one Catalyst adds a filter with copies of the whole expression.
    x = with_citations(clauses).select(*keep, F.posexplode_outer("citations").alias("cit_no", "_citation")).where("cit_no is not null")
    return x.select(*keep, "cit_no", "_citation.*")


def normalize_citation(x: DataFrame, column: str) -> DataFrame:
    """``x`` with the struct ``citation``: the first citation in ``column`` with its number, part and year, or null; the other columns stay."""
    held = x.select(F.struct(*x.columns).alias("row"), F.col(column).alias("text"))
    return with_citations(held).select("row.*", F.try_element_at("citations", F.lit(1)).alias("citation"))


def extract_vague(clauses: DataFrame, patterns: tuple[str, ...] = VAGUE_PATTERNS) -> DataFrame:
    """Every occurrence of the patterns, by pattern and then position; spans are of the text as it is."""
    keep = [c for c in clauses.columns if c != "text"]
    parts = []
    for i, p in enumerate(patterns):
        java = "(?iu)" + p.replace("\\s", "(?U:\\s)")
        x = clauses.select(*keep, "text", F.regexp_extract_all("text", F.lit(java), F.lit(0)).alias("_m"), F.split("text", java, -1).alias("_gap"))
        x = x.withColumn("_s", F.expr(_starts("_m", "_gap")))
        x = x.select(*keep, F.lit(i).alias("pattern_no"), F.posexplode(F.arrays_zip("_m", "_s")).alias("hit_no", "h"))
        x = x.select(*keep, "pattern_no", "hit_no", F.col("h._m").alias("phrase"), F.col("h._s").alias("span_start"))
        parts.append(x.withColumn("span_end", F.col("span_start") + F.length("phrase")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def match_vague_terms(clauses: DataFrame, vague_terms: DataFrame) -> DataFrame:
    """First occurrence of each dictionary term (id, term, explanation) in each clause, case-insensitively.

    The dictionary is a curated list; the join is a nested loop whose small side Catalyst chooses by its size."""
    v = vague_terms.select(F.col("id").alias("term_id"), "term", "explanation")
    at = F.expr("locate(lower(term), lower(text))")
    x = clauses.crossJoin(v).withColumn("_at", at).where("_at > 0")
    x = x.withColumn("span_start", F.col("_at") - 1).withColumn("span_end", F.col("_at") - 1 + F.length("term"))
    return x.withColumn("phrase", F.expr("substring(text, _at, length(term))")).drop("_at", "text")


LONGEST_RUN = 64  # bytes; a power of two
LOOK_UP = 1 << 19  # bytes of clauses whose runs a task looks up at once
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _runs(chunk: Chunk, sizes: Sequence[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each size the row and the hash of all runs of so many bytes inside a text, by doubling."""
    length = np.diff(chunk.off)
    row = np.repeat(np.arange(len(chunk)), length)
    left = np.repeat(chunk.off[1:], length) - np.arange(len(chunk.buf))
    value, size = chunk.buf.astype(np.uint64), 1
    while sizes and len(value):
        if size in sizes:
            at = np.flatnonzero(left[: len(value)] >= size)
            yield size, row[at], mix(value[at] ^ np.uint64(size << 56))
        if size >= sizes[-1]:
            return
        a, b = value[:-size], value[size:]
        value = a | (b << np.uint64(8 * size)) if size < 8 else mix(a) * _ODD + b
        size *= 2


def _classes(terms: DataFrame) -> DataFrame:
    """(_low, _len, class_id, n_terms) of the terms that are equal but for case.  Null and empty terms are in none."""
    own = terms.where("length(term) > 0").select("id", F.lower("term").alias("_low"), F.length("term").alias("_len"))
    return own.groupBy("_low", "_len").agg(F.min("id").alias("class_id"), F.count("*").alias("n_terms"))


def term_classes(terms: DataFrame) -> DataFrame:
    """(term_id, class_id): the class of each term, which its least id names."""
    own = terms.select(F.col("id").alias("term_id"), F.lower("term").alias("_low"), F.length("term").alias("_len"))
    return own.join(_classes(terms), ["_low", "_len"]).select("term_id", "class_id")


def _anchors(classes: DataFrame) -> DataFrame:
    """``classes`` with ``_size``, the largest power of two of bytes (at most ``LONGEST_RUN``) that a class has, and ``_h``, the hash of its anchor: the run of
    so many bytes that the fewest classes have."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches, text="_low", limit=LOOK_UP):
            own = c.column("_size").to_numpy(zero_copy_only=False)
            for size, row, h in _runs(c, sorted({*own.tolist()})):
                keep = own[row] == size
                at = pa.array(row[keep])
                yield pa.RecordBatch.from_arrays([c.column("_low").take(at), c.column("_len").take(at), pa.array(h[keep].view(np.int64))], names=["_low", "_len", "_h"])

    x = classes.withColumn("_size", F.expr(f"least({LONGEST_RUN}, shiftleft(1, cast(floor(log2(octet_length(_low))) as int)))"))
    grams = x.select("_low", "_len", "_size").mapInArrow(runs, "_low string, _len int, _h bigint").distinct()
    counts = grams.groupBy("_h").agg(F.count("*").alias("_n"))
    rarest = grams.join(counts, "_h").groupBy("_low", "_len").agg(F.min(F.struct("_n", "_h")).alias("_a"))
    return x.join(rarest, ["_low", "_len"]).withColumn("_h", F.col("_a._h")).drop("_a")


def _class_hits(clauses: DataFrame, terms: DataFrame) -> DataFrame:
    """The clause's columns without text, the class's (_low, _len, class_id, n_terms), span_start, span_end and phrase."""
    classes = cut(_anchors(_classes(terms)))
    about = classes.agg(F.count("*").alias("n"), F.sort_array(F.collect_set("_size")).alias("sizes")).first()
    sizes = list(about["sizes"])
    known = sketch.build(classes.select("_h"), lambda batches: (b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) for b in batches), about["n"], 2, (0,), 32)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches, text="_low", limit=LOOK_UP):
            rows, hits = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for _, row, h in _runs(c, sizes):
                passed = np.flatnonzero(known.above(h) > 0)
                rows.append(row[passed])
                hits.append(h[passed])
            row, hit = np.concatenate(rows), np.concatenate(hits)
            order = np.lexsort((hit, row))
            row, hit = row[order], hit[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (hit[1:] != hit[:-1])
            row, hit = row[new], hit[new]
            found, first = np.unique(row, return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), pa.array(hit.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(x.take(pa.array(found)) for x in c.rows.columns[:-1]), lists], [*c.rows.schema.names[:-1], "_h"])

    schema = StructType([*clauses.schema.fields, StructField("_h", ArrayType(LongType()))])
    x = clauses.withColumn("_low", F.lower("text")).mapInArrow(look_up, schema).withColumn("_h", F.explode("_h"))
    x = x.join(classes, "_h").withColumn("_at", F.expr("locate(_low, lower(text))")).where("_at > 0")
    at = F.col("_at") - 1
    x = x.withColumns({"span_start": at, "span_end": at + F.col("_len"), "phrase": F.expr("substring(text, _at, _len)")})
    return x.drop("text", "_h", "_size", "_at")


def match_term_classes(clauses: DataFrame, terms: DataFrame) -> DataFrame:
    """``match_vague_terms`` for dictionaries of any size with any number of copies: one row for each clause and class of equal terms, with ``class_id``
    and ``n_terms``; ``term_classes`` has their ids.

    A class has one anchor, a run of 2^k bytes that few classes have.  Tasks look the runs of all clauses up in a broadcast sketch of the anchors (at most
    2^29 cells a row); what passes is joined by the run's hash and then looked for in the text.  The classes are first written to the shared folder."""
    return _class_hits(clauses, terms).drop("_low", "_len")


def match_many_terms(clauses: DataFrame, terms: DataFrame) -> DataFrame:
    """What ``match_vague_terms`` gives, through the classes: a row for each clause and term, so copies of a term multiply the rows."""
    own = terms.select(F.col("id").alias("term_id"), "term", "explanation", F.lower("term").alias("_low"), F.length("term").alias("_len"))
    x = _class_hits(clauses, terms).join(own, ["_low", "_len"])
    return x.select(*[quoted(c) for c in clauses.columns if c != "text"], "term_id", "term", "explanation", "span_start", "span_end", "phrase")


_SPAN_OK = "x.span_start is not null and x.span_end is not null and 0 <= x.span_start and x.span_start < x.span_end and x.span_end <= length(text) and substring(text, x.span_start + 1, x.span_end - x.span_start) = x.{key}"


def validate_spans(extractions: DataFrame) -> DataFrame:
    """(text, products, citations, vague_phrases, ...) with only items whose span holds their text; ``dropped`` counts the others and
    ``invented`` the citations that contradict their own text or are not in the clause."""
    digits = "forall(regexp_extract_all(x.is_number, r'\\d+', 0), g -> contains(_fold, g))"
    fold = "translate(x.raw, '०१२३४५६७८९', '0123456789')"
    consistent = f"(x.year is null or contains({fold}, cast(x.year as string))) and {digits.replace('_fold', fold)}"
    ok = {"products": _SPAN_OK.format(key="text"), "vague_phrases": _SPAN_OK.format(key="text"), "citations": f"({_SPAN_OK.format(key='raw')}) and {consistent}"}
    ok = {k: f"coalesce({v}, false)" for k, v in ok.items() if k in extractions.columns}
    span = f"coalesce({_SPAN_OK.format(key='raw')}, false)"
    x = extractions
    if "citations" in ok:
        x = x.withColumn("invented", F.expr(f"size(filter(citations, x -> ({span} and not ({consistent})) or (not {span} and not contains(text, coalesce(x.raw, '')))))"))
    x = x.withColumn("dropped", F.expr(" + ".join(f"size(filter({k}, x -> not {v}))" for k, v in ok.items())))
    return x.withColumns({k: F.expr(f"filter({k}, x -> {v})") for k, v in ok.items()})


def fallback_chain(clauses: DataFrame, primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """The first extraction there is, by key: primary, secondary, else the native one in reduced mode."""
    own = with_citations(clauses).withColumnRenamed("citations", "_regex")
    x = own.join(primary.select("key", F.col("citations").alias("_p")), "key", "left").join(secondary.select("key", F.col("citations").alias("_s")), "key", "left")
    provider = F.when(F.col("_p").isNotNull(), "primary").when(F.col("_s").isNotNull(), "secondary").otherwise("RegexFallback")
    return x.withColumn("provider", provider).withColumn("reduced_mode", F.col("_p").isNull() & F.col("_s").isNull()).withColumn("citations", F.coalesce("_p", "_s", "_regex")).drop("_p", "_s")


def with_fallback(extracted: DataFrame) -> DataFrame:
    """``fallback_chain`` for rows that have their extraction and ``error`` at hand: their own citations, or the native ones in reduced mode; no join."""
    held = extracted.select(F.struct(*extracted.columns).alias("row"), "text")
    x = with_citations(held).select("row.*", F.col("citations").alias("_regex"))
    failed = F.col("error").isNotNull()
    return x.withColumns({"provider": F.when(failed, "RegexFallback").otherwise("primary"), "reduced_mode": failed, "citations": F.when(failed, F.col("_regex")).otherwise(F.col("citations"))})


def cross_check(extractions: DataFrame) -> DataFrame:
    """``extraction_uncertain`` where the sets of numbers of ``citations`` and ``_regex`` differ; never in reduced mode."""
    numbers = lambda c: F.array_sort(F.array_distinct(F.transform(c, lambda x: F.upper(F.trim(x["is_number"])))))
    return extractions.withColumn("extraction_uncertain", ~F.col("reduced_mode") & (numbers("citations") != numbers("_regex")))


def cache_misses(clauses: DataFrame, cache: DataFrame) -> DataFrame:
    """One row for each key that the cache lacks."""
    return clauses.join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"])


def cache_hits(clauses: DataFrame, cache: DataFrame) -> DataFrame:
    """Cached results under the new clause ids."""
    return clauses.join(cache.drop("clause_id"), "key").withColumn("cached", F.lit(True))

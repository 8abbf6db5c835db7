"""The extension point for extractors: Python objects that see clauses in Arrow batches and give extractions of one schema.

A row that an extractor fails on, or whose result does not fit the schema, gets an ``error`` and empty lists; the task goes on.  Each distinct clause is extracted
once and known ones come from a cache; behind both, spans are checked against the clause's own text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseaudit.functions.text import cache_key
from clauseaudit.operators.extract import cache_misses, validate_spans
from clauseaudit.sources.scratch import put

_SPAN = [("span_start", pa.int32()), ("span_end", pa.int32())]
_ITEMS = {
    "products": pa.list_(pa.struct([("text", pa.string()), *_SPAN, ("canonical_product_id", pa.string())])),
    "citations": pa.list_(pa.struct([("raw", pa.string()), *_SPAN, ("is_number", pa.string()), ("part", pa.string()), ("year", pa.int32())])),
    "vague_phrases": pa.list_(pa.struct([("text", pa.string()), *_SPAN, ("explanation", pa.string())])),
}
SCHEMA = """products array<struct<text:string,span_start:int,span_end:int,canonical_product_id:string>>,
 citations array<struct<raw:string,span_start:int,span_end:int,is_number:string,part:string,year:int>>,
 vague_phrases array<struct<text:string,span_start:int,span_end:int,explanation:string>>, mentions_certification boolean, error string"""


class Extractor(Protocol):
    """``extract`` gives one dict a clause, with any of the schema's fields; it is pickled to the tasks."""

    name: str
    model_id: str

    def extract(self, clauses: Sequence[str], language_hints: Sequence[str | None]) -> Sequence[dict]: ...


class PatternExtractor:
    """Citations by a Python pattern with the groups ``number`` and, if it has them, ``part`` and ``year``."""

    def __init__(self, pattern: str, name: str = "Pattern", model_id: str = "pattern-1", prefix: str = "IS "):
        self.pattern, self.name, self.model_id, self.prefix = re.compile(pattern), name, model_id, prefix

    def extract(self, clauses: Sequence[str], language_hints: Sequence[str | None]) -> list[dict]:
        return [{"citations": [self._item(m) for m in self.pattern.finditer(c)]} for c in clauses]

    def _item(self, m: re.Match) -> dict:
        g = m.groupdict()
        return {"raw": m[0], "span_start": m.start(), "span_end": m.end(), "is_number": self.prefix + g["number"], "part": g.get("part"), "year": int(g["year"]) if g.get("year") else None}


class CannedExtractor:
    """Known results by clause; other clauses are errors.  For tests and replays."""

    def __init__(self, results: dict[str, dict], name: str = "Canned", model_id: str = "canned-1"):
        self.results, self.name, self.model_id = results, name, model_id

    def extract(self, clauses: Sequence[str], language_hints: Sequence[str | None]) -> list[dict]:
        return [self.results[c] for c in clauses]


def _columns(results: Sequence[dict]) -> list[pa.Array]:
    lists = [pa.array([r.get(n) or [] for r in results], t) for n, t in _ITEMS.items()]
    return [*lists, pa.array([bool(r.get("mentions_certification", False)) for r in results], pa.bool_()), pa.array([r.get("error") for r in results], pa.string())]


def _one(extractor: Extractor, text: str, hint: str | None, checked: bool) -> dict:
    """A clause's result, or its error; with ``checked``, one that does not fit the schema is an error too."""
    try:
        results = list(extractor.extract([text], [hint]))
        if len(results) != 1:
            raise ValueError(f"{len(results)} results for 1 clauses")
        if checked:
            _columns(results)
        return results[0]
    except Exception as e:  # an extractor may raise anything
        return {"error": f"{type(e).__name__}: {e}"}


def _results(extractor: Extractor, texts: list[str], hints: list[str | None]) -> list[pa.Array]:
    """Columns of a batch; where the whole fails, of its rows' own results."""
    try:
        results = list(extractor.extract(texts, hints))
        if len(results) != len(texts):
            raise ValueError(f"{len(results)} results for {len(texts)} clauses")
        return _columns(results)
    except Exception:  # one by one below
        pass
    try:
        return _columns([_one(extractor, t, h, False) for t, h in zip(texts, hints)])
    except Exception:  # a result does not fit the schema
        return _columns([_one(extractor, t, h, True) for t, h in zip(texts, hints)])


def run_extractor(clauses: DataFrame, extractor: Extractor) -> DataFrame:
    """``clauses`` (text, and language if there is one) with the extraction's columns as the extractor gives them.  A null text is an empty one."""
    hinted = "language" in clauses.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            hints = b.column(b.schema.get_field_index("language")).to_pylist() if hinted else [None] * len(texts)
            made = _results(extractor, texts, hints) if texts else _columns([])
            yield pa.RecordBatch.from_arrays([*b.columns, *made], [*b.schema.names, *_ITEMS, "mentions_certification", "error"])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in clauses.schema)
    return clauses.mapInArrow(run, f"{own}, {SCHEMA}")


def extract_with(clauses: DataFrame, extractor: Extractor, cache: DataFrame | None = None, prompt_version: str = "1", folder: str | None = None) -> DataFrame:
    """``clauses`` with ``key``, checked extractions, ``error``, ``cached`` and the checks' counts (``dropped``, ``invented``).

    ``cache`` has ``key`` and the extraction's columns; what has an error should not be put there (``cacheable``).
    With ``folder``, a shared one, new extractions are written there first, so that what was shuffled to find them is freed."""
    # Keys are shuffled as 32 bytes and named in hex at the ends.
    x = clauses.withColumn("key", F.unhex(cache_key(F.col("text"), F.lit(prompt_version), F.lit(extractor.model_id))))
    fields = [*_ITEMS, "mentions_certification", "error"]
    todo = x.select("key", "text", *(["language"] if "language" in x.columns else []))
    known = None if cache is None else cache.select(F.unhex("key").alias("key"), *fields).dropDuplicates(["key"])
    todo = todo.dropDuplicates(["key"]) if known is None else cache_misses(todo, known)
    made = run_extractor(todo, extractor).select("key", *fields, F.lit(False).alias("cached"))
    if folder is not None:
        made = put(made, folder, "made")
    if known is not None:
        made = made.unionByName(known.withColumn("cached", F.lit(True)))
    return validate_spans(x.join(made, "key").withColumn("key", F.lower(F.hex("key"))))


def extract_keys(clauses: DataFrame, extractor: Extractor, prompt_version: str = "1") -> DataFrame:
    """Rows for the cache, straight from the clauses: each distinct one extracted and checked once, without a join back to the clauses."""
    x = clauses.withColumn("key", F.unhex(cache_key(F.col("text"), F.lit(prompt_version), F.lit(extractor.model_id))))
    todo = x.select("key", "text", *(["language"] if "language" in x.columns else [])).dropDuplicates(["key"])
    return validate_spans(run_extractor(todo, extractor)).where("error is null").select(F.lower(F.hex("key")).alias("key"), *_ITEMS, "mentions_certification", "error")


def cacheable(extracted: DataFrame) -> DataFrame:
    """Rows for the cache: one a key, without errors."""
    return extracted.where("error is null and not cached").select("key", *_ITEMS, "mentions_certification", "error").dropDuplicates(["key"])

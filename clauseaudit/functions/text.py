"""Text and date expressions: pure functions from Column to Column, evaluated in the JVM.

Offsets count code points.  Nulls give nulls unless a function says otherwise.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

DEVANAGARI_DIGITS = "०१२३४५६७८९"
SPACE = "(?U:\\s)"
WORD = "[\\p{L}\\p{N}_]"

# Terms that say that certification is mentioned (plain substrings of the lower-cased text).
CERTIFICATION_TERMS = (
    "crs",
    "compulsory registration scheme",
    "bis registration",
    "isi mark",
    "registration under",
    "अनिवार्य पंजीकरण",
    "सीआरएस",
    "बीआईएस पंजीकरण",
)

# Words that end a product mention.
MENTION_STOPS = ("rated for", "square metres", "sqm", "sq m", "conforming to", "units", "pieces", "nos")


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str]:
    """Characters whose compatibility form is one other character, and Devanagari digits, with their replacements."""
    pairs = {}
    for i in range(1, sys.maxunicode + 1):
        if 0xD800 <= i <= 0xDFFF:
            continue
        c = chr(i)
        n = unicodedata.normalize("NFKC", c)
        if len(n) == 1 and n != c:
            pairs[c] = n
    for i, c in enumerate(DEVANAGARI_DIGITS):
        pairs[c] = str(i)
    pairs = {c: str(DEVANAGARI_DIGITS.index(n)) if n in DEVANAGARI_DIGITS else n for c, n in pairs.items()}
    return "".join(pairs), "".join(pairs.values())


def fold_digits(text: Column) -> Column:
    """Compatibility characters and Devanagari digits to plain ones, without changing the length.  Plain ASCII has none and stays as it is."""
    source, target = _fold_table()
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(F.translate(text, source, target))


def ascii_digits(text: Column) -> Column:
    return F.translate(text, DEVANAGARI_DIGITS, "0123456789")


def detect_language(text: Column) -> Column:
    """mixed, hi or en. The two letters beyond A-Z lower-case into it."""
    devanagari, latin = text.rlike("[\\u0900-\\u097F]"), text.rlike("[A-Za-z\\u0130\\u212A]")
    return F.when(devanagari & latin, "mixed").when(devanagari, "hi").otherwise("en")


def normalise_citation(raw: Column) -> Column:
    """Digits, the transliterated prefix and the word for part in their standard form, trimmed."""
    x = F.regexp_replace(ascii_digits(raw), "आई\\.?(?U:\\s)?एस\\.?|आईएस", "IS")
    return _strip(F.regexp_replace(x, "भाग(?U:\\s)*(\\d+)", "Part $1"))


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")


def base_number(is_number: Column) -> Column:
    """The number without any part.  One in the plain form that extraction gives has none and stays as it is."""
    whole = _strip(F.regexp_replace(normalise_citation(is_number), "(?U:\\s)*\\(?(?U:\\s)*(?:(?i:Part)|भाग)(?U:\\s)*\\d+(?U:\\s)*\\)?", ""))
    return F.when(is_number.rlike("\\AIS(?:/(?:IEC|ISO))? [0-9-]+\\z"), is_number).otherwise(whole)


def edit1(a: Column, b: Column) -> Column:
    """Whether the Levenshtein distance is exactly 1."""
    return F.levenshtein(a, b) == 1


def normalise_mention(text: Column) -> Column:
    """Lower-cased and trimmed, without a leading quantity and from the first stop phrase to the line's end."""
    stops = "|".join(MENTION_STOPS)
    x = _strip(F.lower(fold_digits(text)))
    x = F.regexp_replace(x, f"^\\p{{Nd}}+{SPACE}+", "")
    return _strip(F.regexp_replace(x, f"(?<!{WORD})(?:{stops})(?!{WORD}).*$", ""))


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"{WORD}+"), F.lit(0)))


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared share of word tokens; 0 where a side has none."""
    x, y = tokens(a), tokens(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def trigrams(text: Column) -> Column:
    s = F.concat(F.lit("  "), F.lower(text), F.lit("  "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - 2), lambda i: F.substring(s, i, F.lit(3))))


def trigram_dice(a: Column, b: Column) -> Column:
    """Dice coefficient of padded character trigrams."""
    x, y = trigrams(a), trigrams(b)
    return F.lit(2.0) * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))


def mentions_certification(text: Column, flag: Column | None = None) -> Column:
    found = F.lit(False)
    for term in CERTIFICATION_TERMS:
        found = found | F.contains(F.lower(text), F.lit(term))
    return found if flag is None else F.coalesce(flag, F.lit(False)) | found


def cache_key(clause: Column, prompt_version: Column, model: Column) -> Column:
    return F.sha2(F.concat_ws("||", _strip(clause), prompt_version, model), 256)


def render(template: str, params: dict[str, Column]) -> Column:
    """A message template with its placeholders filled; with a placeholder missing it stays raw."""
    import re

    names = re.findall(r"\{(\w+)\}", template)
    if any(n not in params for n in names):
        return F.lit(template)
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.coalesce(params[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts) if p or i % 2])


def is_stale(as_of: Column, verified_on: Column, days: int) -> Column:
    return F.datediff(as_of, verified_on) > days


def snippet(text: Column, most: int = 80) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def count_line(x: Column, y: Column) -> Column:
    """``x of y (p%)`` with one decimal."""
    share = F.format_string("%.1f", F.lit(100.0) * x / F.nullif(y, F.lit(0)))
    return F.when(y == 0, "0 of 0 (no applicable test cases)").otherwise(F.concat(x.cast("string"), F.lit(" of "), y.cast("string"), F.lit(" ("), share, F.lit("%)")))


def parse_synonyms(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def finding_id(*parts: Column) -> Column:
    """Id of 96 bits that depends on what the finding says."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit("f_"), F.substring(F.sha2(text, 256), 1, 24))


def row_to_json(*columns: str) -> Column:
    return F.to_json(F.struct(*(columns or ("*",))), {"ignoreNullFields": "false"})

"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in DataFrame functions only.

A paragraph is a line; a line of over 160 characters is cut at sentence ends, and what is over 240 into pieces of 100 to 240
characters that end where the text itself says (certain letters before a space), so that texts of one line have several.  The
fingerprint of a text has three tables of ``BASE`` cells; each distinct paragraph's 64-bit digest is put into one cell of each: a
count, the xor of digests and the xor of check hashes.  Fingerprints of two versions subtract cell by cell, and peeling cells
that hold one digest recovers the digests on either side only.  Where peeling fails, both versions are sketched again, larger: in as many
sketches as the paragraphs need, each for the digests of one residue, so that each stays small however long the text; one that
fails is made again with twice the cells until it peels (at most five times; then its few digests are compared themselves).
Likeness is common / all distinct paragraphs, from the recovered digests and the counts.

Null and empty texts have no paragraphs: two such texts are
alike (1), one against another text is not (0).  Ties of doc_id are ordered by text hash, null ids come last;
repeated rows stand next to each other.  Only doc_id and text are read, so other columns cannot clash.  An empty
table gives no rows.  In a table of one row the next document is the row itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BASE = 4  # cells of each of a fingerprint's three tables
EACH, LEAST = 6, 4  # of larger sketches: digests of both sides for each, and cells of its tables at first
GROWTH = 5
_SIDES = "struct<left:int,right:int>"


def _let(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with a name for a value that it uses more than once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def paragraphs(text: str) -> str:
    """SQL: distinct digests of a text's paragraphs."""
    pieces = "regexp_extract_all(s, '(?s).{100,240}?[,;:)eanst](?=[ \\t])|.{1,240}', 0)"
    sentences = f"flatten(transform(split(l, '(?<=[.!?]) '), s -> if(length(s) > 240, {pieces}, array(s))))"
    lines = f"flatten(transform(split({text}, '\\n'), l -> if(length(l) > 160, {sentences}, array(l))))"
    return f"array_distinct(transform(filter({lines}, l -> l <> ''), l -> xxhash64(l)))"


def _at(key: str, m: str) -> str:
    """SQL: the digest's cells, one in each table of m (a power of two) cells; each table has bits of its own."""
    return "array(" + ", ".join(f"{j} * {m} + cast(shiftright({key}, {24 + 13 * j}) & ({m} - 1) as int)" for j in range(3)) + ")"


def _items(keys: str, sign: int, m: str) -> str:
    """SQL: digests with their sign, check hash and cells."""
    return f"transform({keys}, k -> named_struct('c', {sign}, 'k', k, 'x', xxhash64(k, 99), 'at', {_at('k', m)}))"


def sketch(items: str, m: str) -> str:
    """SQL: the three tables of m cells of digests (``_items``) with their signs."""
    add = "named_struct('c', t.c + e.c, 'k', t.k ^ e.k, 'x', t.x ^ e.x)"
    return f"transform(sequence(0, 3 * {m} - 1), p -> aggregate({items}, named_struct('c', 0, 'k', 0L, 'x', 0L), (t, e) -> if(array_contains(e.at, p), {add}, t)))"


def fingerprint(keys: str) -> str:
    """SQL: the three tables of BASE cells."""
    return _let(_items(keys, 1, str(BASE)), "items", sketch("items", str(BASE)))


def subtract(a: str, b: str) -> str:
    """SQL: the fingerprint a minus the fingerprint b."""
    return f"zip_with({a}, {b}, (y, z) -> named_struct('c', y.c - z.c, 'k', y.k ^ z.k, 'x', y.x ^ z.x))"


def peel(cells: str, m: str) -> str:
    """SQL: how many digests only the left and only the right side have, recovered from a difference; null where peeling fails.

    A step takes the digests that are alone in a cell of one table out of all three; it ends when no table has any more."""
    pure = f"filter(slice(s.cells, (i % 3) * {m} + 1, {m}), z -> abs(z.c) = 1 and z.x = xxhash64(z.k, 99))"
    pure = f"transform({pure}, z -> named_struct('c', z.c, 'k', z.k, 'x', z.x, 'at', {_at('z.k', m)}))"
    without = f"transform(s.cells, (z, p) -> aggregate(pure, z, (t, q) -> if(array_contains(q.at, p), named_struct('c', t.c - q.c, 'k', t.k ^ q.k, 'x', t.x ^ q.x), t)))"
    step = _let(pure, "pure", f"""if(size(pure) = 0, named_struct('cells', s.cells, 'left', s.left, 'right', s.right, 'idle', s.idle + 1), named_struct(
      'cells', {without}, 'left', s.left + size(filter(pure, q -> q.c = 1)), 'right', s.right + size(filter(pure, q -> q.c = -1)), 'idle', 0))""")
    return f"""aggregate(sequence(0, 8), named_struct('cells', {cells}, 'left', 0, 'right', 0, 'idle', 0), (s, i) -> if(s.idle >= 3, s, {step}),
      s -> if(exists(s.cells, z -> z.c <> 0 or z.k <> 0 or z.x <> 0), cast(null as {_SIDES}), named_struct('left', s.left, 'right', s.right)))"""


def _larger(a: str, b: str) -> str:
    """SQL: the same from larger sketches of the digests a and b, one for each pair of residues."""
    # As long as nothing is found, twice the cells; the sums are those of two sketches and their difference.
    items = f"concat({_items('a2', 1, 'm')}, {_items('b2', -1, 'm')})"
    attempt = _let(f"shiftleft({LEAST}, i)", "m", peel(_let(items, "items", sketch("items", "m")), "m"))
    again = f"aggregate(sequence(0, {GROWTH - 1}), cast(null as {_SIDES}), (found, i) -> if(found is not null, found, {attempt}))"
    one = f"if(size(a2) + size(b2) = 0, named_struct('left', 0, 'right', 0), coalesce({again}, named_struct('left', size(array_except(a2, b2)), 'right', size(array_except(b2, a2)))))"
    part = lambda keys, residue, i: f"filter({keys}, k -> pmod({residue}, g) = {i})"
    inner = _let(part("a1", "shiftright(k, 12)", "j"), "a2", _let(part("b1", "shiftright(k, 12)", "j"), "b2", one))
    outer = _let(part(a, "k", "i"), "a1", _let(part(b, "k", "i"), "b1", f"transform(sequence(0, g - 1), j -> {inner})"))
    sums = f"aggregate(flatten(transform(sequence(0, g - 1), i -> {outer})), named_struct('left', 0, 'right', 0), (s, z) -> named_struct('left', s.left + z.left, 'right', s.right + z.right))"
    return _let(f"greatest(1, cast(ceil(sqrt((size({a}) + size({b})) / {EACH})) as int))", "g", sums)


def likeness(a_keys: str, a_sketch: str, b_keys: str, b_sketch: str) -> Column:
    """From the two fingerprints, else from larger sketches."""
    found = f"coalesce({peel(subtract(a_sketch, b_sketch), str(BASE))}, {_larger(a_keys, b_keys)})"
    n = f"size({a_keys})"
    return F.expr(_let(found, "d", f"if({n} + d.right = 0, 1.0D, cast({n} - d.left as double) / ({n} + d.right))"))


def as_text(cells: str) -> str:
    """SQL: a fingerprint's cells in use, with their places."""
    return f"array_join(filter(transform({cells}, (z, p) -> if(z.c > 0, concat(hex(p), ':', z.c, ':', hex(z.k)), '')), z -> z <> ''), ',')"


def with_next(docs: DataFrame, ranges: int = 256, rows: int = 4000) -> DataFrame:
    """doc_id, text and keys of each document, next_text and next_keys of the next by descending doc_id (after the last: the first).

    Rows are dealt into ranges of doc_id: quantiles, and inside each equal widths so that a range has about ``rows`` rows.  An id that is a
    quantile twice has a quantile of its own; its rows and those without an id are dealt by the hash of their text, which orders
    ties.  Inside a range a window gives the next row; the first row of the next range follows a range's last row.
    """
    n, bounds = docs.agg(F.count(F.lit(1)), F.percentile_approx(F.col("doc_id").cast("long"), [i / ranges for i in range(ranges)])).first()
    bounds = bounds or [0]
    many = {a for a, b in zip(bounds, bounds[1:]) if a == b}
    bounds = sorted({*bounds, *many, *(b + 1 for b in many)})
    parts = -(-n // (ranges * rows)) or 1
    ties = max(1, -(-n // rows))
    above = F.array(*[F.lit(b).cast("long") for b in bounds[1:] + [bounds[-1] + 1]])
    low = F.array(*[F.lit(b).cast("long") for b in bounds])
    q = F.when(F.col("doc_id").isNull(), 0).otherwise(F.greatest(F.lit(1), F.size(F.filter(low, lambda b: b <= F.col("doc_id")))))
    width = F.greatest(F.lit(1), F.element_at(above, F.col("_q")) - F.element_at(low, F.col("_q")))
    inner = F.least(F.lit(parts - 1), F.greatest(F.lit(0), F.floor((F.col("doc_id") - F.element_at(low, F.col("_q"))) * parts / width)))
    by_tie = ties - 1 - F.least(F.lit(ties - 1), F.floor((F.shiftright("_tie", 32) + F.lit(1 << 31)) * ties / F.lit(float(1 << 32))))
    own = F.when(F.col("doc_id").isNull() | F.col("doc_id").isin(sorted(many)), by_tie).otherwise(inner).cast("long")
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    x = x.withColumn("keys", F.expr(paragraphs("text"))).withColumn("_tie", F.xxhash64("text")).withColumn("_q", q).withColumn("_range", own)
    w = Window.partitionBy("_q", "_range").orderBy(F.col("doc_id").desc(), "_tie")
    row = F.struct(F.col("text").alias("next_text"), F.col("keys").alias("next_keys"))
    x = x.select("doc_id", "text", "keys", "_q", "_range", F.lead(row).over(w).alias("_lead"), F.row_number().over(w).alias("_n"))
    # Heads of the ranges, one small row each; and of the quantiles, whose number is fixed, the next one's first range.
    heads = x.where("_n = 1").select("_q", "_range", "text")
    tops = heads.groupBy("_q").agg(F.max("_range").alias("_top"))
    down = Window.orderBy(F.desc("_q"))
    tops = tops.select("_q", F.coalesce(F.lead(F.struct("_q", "_top")).over(down), F.first(F.struct("_q", "_top")).over(down)).alias("_then"))
    following = F.lead(F.struct("_q", F.col("_range").alias("_top"))).over(Window.partitionBy("_q").orderBy(F.desc("_range")))
    after = heads.select("_q", "_range", following.alias("_following")).join(tops, "_q").select("_q", "_range", F.coalesce("_following", "_then").alias("_then"))
    after = after.select("_q", "_range", F.col("_then._q").alias("_tq"), F.col("_then._top").alias("_tr")).join(heads.select(F.col("_q").alias("_tq"), F.col("_range").alias("_tr"), "text"), ["_tq", "_tr"])
    after = after.select("_q", "_range", F.struct(F.col("text").alias("next_text"), F.expr(paragraphs("text")).alias("next_keys")).alias("_head"))
    return x.join(after, ["_q", "_range"]).withColumn("_lead", F.coalesce("_lead", "_head")).select("doc_id", "text", "keys", "_lead.*")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and its edited text (see the module), and likenesses from their sketches."""
    x = with_next(docs)
    x = x.withColumn("n_chars", F.length("text"))
    x = x.withColumn("edited", F.expr("concat(substr(text, 1, n_chars - n_chars div 2), substr(next_text, 1, cast(n_chars div 2 as int)))"))
    x = x.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.col("keys").alias("a_keys"), F.expr(paragraphs("edited")).alias("e_keys"), F.col("next_keys").alias("n_keys"))
    for name in "aen":
        x = x.withColumn(f"{name}_cells", F.expr(fingerprint(f"{name}_keys")))
    return x.select(
        "doc_id", "n_chars", "edited_sha256", F.expr(as_text("a_cells")).alias("fingerprint"), F.expr(as_text("e_cells")).alias("edited_fingerprint"),
        likeness("a_keys", "a_cells", "e_keys", "e_cells").alias("near_edited"), likeness("a_keys", "a_cells", "n_keys", "n_cells").alias("near_next"),
    )

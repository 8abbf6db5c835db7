"""N-gram Jaccard join with token-combination prefixes.

A document is the set of its k-word shingles (hashed tokens).  Equal sets are one entity, named by a 64-bit hash of the whole set.
All entities order their tokens alike: rare classes first, then by hash.  A prefix is taken from the rare end until
it is covered: a rare token counts 1 and is indexed by itself; of the tokens of a frequent class the first
k - 1 (for each subclass) count nothing and the others 1, and all their k-combinations are indexed.  As at most
n - ceil(t n) tokens of a set can be missing from a partner, coverage above that leaves an indexed token or
combination whole in both; so no link is lost, whichever tokens are called frequent.  Those are the tokens that a count-min sketch of all
tokens finds above its own noise.  A second sketch, of the signatures, keeps those that occur once out of the shuffles, and whole sets
of rare tokens of which too few occur twice: such a set also gives as many tokens again behind its prefix, and of all these a partner
must have about half.  Slices of this sketch are counted one after another, so it lets through the same share at every size of input.

Candidates are not all pairs of a posting list.  Each member of a list is verified against the list's pivot, the
member with the fewest rare tokens (the text that the others are edits of), so work is linear in the postings; links become
components.  Lists whose members are in several components get a second pivot outside of the first one's component.  What then is
left are pairs of different components, at least one of them outside of the pivot's: a pair leaves the join only
if sizes and the bits in which the sets' parities differ (never more than the tokens in which the sets do) allow a link, and is
verified.  Long lists with one pivot are looked at together, so that a pair comes out once, not once a signature.  Joins are by
signature, pivot or entity, which AQE may split.

Null and empty texts have no set and link with nothing; a text of fewer than k words is one token.  A very long
text is one set.  Repeated rows and texts are one entity.  A null doc_id is never the smallest of a group with
another id.  An empty table gives no rows.  Other columns are ignored by ``join`` and kept by ``keep_one``, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseaudit.llm import sketch
from clauseaudit.llm.common import Scratch, chunks, connected_components, mix, shingle_sets

_U = np.uint64
NULL_ID = (1 << 63) - 1
LONG = 64  # postings from which lists are looked at by pivot
PARITY = 8  # longs
BITS = [f"p{i}" for i in range(PARITY)]


def _needed(n: int, percent: int) -> int:
    """Coverage that a set of n tokens needs."""
    return n + (-percent * n) // 100 + 1


def least_size(percent: int) -> int:
    """The smallest set that can link with a different one."""
    return -(-percent // (100 - percent)) if percent < 100 else 1 << 62


def subclasses(level: int, percent: int, k: int) -> int:
    """Into how many subclasses k-combinations are dealt for sets of 2^level to 2^(level+1) tokens: a function of the
    level only, so that partners agree; about 8 tokens of a prefix fall into one (6 for triples)."""
    return max(1, (2 << level) * (100 - percent) // 100 // (8 if k == 2 else 6))


def signatures(tokens: np.ndarray, above: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of one set, and rare tokens behind them that are only counted.  ``above``: 0 rare, 1 frequent (pairs), 2 very
    frequent (triples)."""
    n = len(tokens)
    if n < least_size(percent):
        return np.zeros(0, _U), np.zeros(0, _U)
    order = np.lexsort((tokens, above))
    tokens, above = tokens[order], above[order]
    need = _needed(n, percent)
    rare = int((above == 0).sum())
    if rare >= need:
        return tokens[:need], tokens[need : min(rare, 2 * need - 1)]
    level = n.bit_length() - 1
    out = [tokens[:rare]]
    # A partner may be of the level below: then signatures of that level are given too.
    for at in [level, level - 1] if percent * n < 100 << level else [level]:
        covered, held = rare, {}
        parts = {k: subclasses(at, percent, k) for k in (2, 3)}
        for t, k in zip(tokens[rare:].tolist(), (above[rare:] + 1).tolist()):
            group = held.setdefault((k, t % parts[k]), [])
            group.append(t)
            covered += len(group) >= k
            if covered >= need:
                break
        else:  # too few tokens a subclass: all of them by themselves
            out.append(tokens[rare:])
        for (k, _), group in held.items():
            if len(group) >= k:
                combos = np.array(list(itertools.combinations(group, k)), _U)
                h = np.full(len(combos), at * 4 + k, _U)
                for j in range(k):
                    h = mix(h ^ combos[:, j])
                out.append(h)
    return np.unique(np.concatenate(out)), np.zeros(0, _U)


def least_repeated(n: int, rare: int, percent: int) -> int:
    """How many of the tokens that ``signatures`` gives others must have too if a set links.

    Of 2 * need - 1 tokens in a common order at least ``need`` are in a partner, and among its own if its prefix ends later; if it
    ends earlier, at least as many as the smallest partner needs.  A set with fewer rare tokens has no such bound."""
    return _needed(-(-percent * n // 100), percent) if rare >= 2 * _needed(n, percent) - 1 else 1


def set_key(tokens: np.ndarray) -> int:
    """A 64-bit hash of a set."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def parity(tokens: np.ndarray) -> np.ndarray:
    """512 bits, of which each token flips one: two sets differ in at least as many tokens as their parities in bits."""
    bits = np.bincount((mix(tokens) & _U(PARITY * 64 - 1)).astype(np.int64), minlength=PARITY * 64) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def long_parity(tokens: np.ndarray) -> bytes | None:
    """The same in about as many bits as a large set has tokens; half of it by half of it, it folds to the next smaller one."""
    if len(tokens) <= 2 * PARITY * 64:
        return None
    size = 1 << len(tokens).bit_length() - 1
    bits = np.bincount((mix(tokens) & _U(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def bits_apart(a: bytes | None, b: bytes | None) -> int:
    """In how many bits two long parities differ; 0 if there are none."""
    if a is None or b is None:
        return 0
    x, y = sorted((np.frombuffer(v, np.uint8) for v in (a, b)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, key (stands for the set; null where it is empty) and parities (p0, p1, ... and long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            found = shingle_sets(chunk.buf, chunk.off, k)
            keys = [set_key(x) if len(x) else None for x in found]
            bits = np.array([parity(x) for x in found]).reshape(len(found), PARITY)
            yield pa.RecordBatch.from_pydict({"doc_id": chunk.column("doc_id").cast(pa.int64()), "n_shingles": pa.array([len(x) for x in found], pa.int64()), "key": pa.array(keys, pa.int64()), **{p: pa.array(bits[:, i]) for i, p in enumerate(BITS)}, "long": pa.array(map(long_parity, found), pa.binary())})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, key bigint" + "".join(f", {p} bigint" for p in BITS) + ", long binary")


def postings(docs: DataFrame, frequent: sketch.Sketch, k: int, percent: int) -> DataFrame:
    """(key, n, rare, sigs, more) of the documents' sets, each set once a task; rare: how many tokens are of no frequent class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for chunk in chunks(batches):
            rows = []
            for tokens in shingle_sets(chunk.buf, chunk.off, k):
                name = set_key(tokens)
                if name in seen or not len(tokens):
                    continue
                seen.add(name)
                above = frequent.above(tokens)
                sigs, more = signatures(tokens, above, percent)
                if len(sigs):
                    rows.append((name, len(tokens), int((above == 0).sum()), sigs.view(np.int64), more.view(np.int64)))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["key", "n", "rare", "sigs", "more"])

    return docs.select("text").mapInArrow(run, "key bigint, n int, rare int, sigs array<bigint>, more array<bigint>")


def _longs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for b in batches:
        yield mix(b.column(0).to_numpy(zero_copy_only=False).view(_U))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and where each row's begin (and the last end)."""
    off = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]].view(_U), off - off[0]


def repeated(posted: DataFrame, scratch: Scratch, percent: int, cells_per_item: float = 8.0, most: int = sketch.MOST) -> DataFrame:
    """(sig, key, n, rare) of signatures that occur twice, of sets that can link; and a share of the others that depends on ``cells_per_item`` only."""
    total = posted.agg(F.coalesce(F.sum(F.size("sigs") + F.size("more")), F.lit(0)).alias("n")).first()["n"]
    n = sketch.slices(total, cells_per_item, most)
    for s in range(n):
        def own(batches: Iterator[pa.RecordBatch], s: int = s) -> Iterator[np.ndarray]:
            for b in batches:
                for c in b.columns:
                    sigs = mix(_flat(c)[0])
                    yield sigs[sketch.slice_of(sigs, n) == s]

        counted = sketch.build(posted.select("sigs", "more"), own, total / n, 1, (1,), cells_per_item, most=most)

        def keep(batches: Iterator[pa.RecordBatch], s: int = s, counted: sketch.Sketch = counted) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lists = []
                for c in b.columns[3:]:
                    values, off = _flat(c)
                    sigs = mix(values)
                    ok = sketch.slice_of(sigs, n) != s
                    ok[~ok] = counted.above(sigs[~ok]) > 0
                    lists.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(ok))[off].astype(np.int32)), pa.array(values[ok].view(np.int64))))
                if s == n - 1:  # all slices have been looked at
                    left = np.diff(lists[0].offsets.to_numpy()) + np.diff(lists[1].offsets.to_numpy())
                    least = [least_repeated(size, rare, percent) for size, rare in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
                    b = b.filter(pa.array(left >= least))
                    lists = [x.filter(pa.array(left >= least)) for x in lists]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], *lists], names=b.schema.names)

        before, posted = posted, scratch.cut(posted.mapInArrow(keep, posted.schema))
        counted.free()
        scratch.free(before)
    return posted.select(F.explode("sigs").alias("sig"), "key", "n", "rare")


def picked_sets(docs: DataFrame, wanted: DataFrame, scratch: Scratch, k: int, most: int = sketch.MOST) -> DataFrame:
    """(key, tokens) of the documents with the ids ``wanted`` (doc_id) and a few others: a bit sketch of the ids picks them in the scan,
    so no text is shuffled."""
    held = sketch.build(wanted, _longs, wanted.count(), 1, (0,), 16.0, most=most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids = mix(batch.column(0).to_numpy(zero_copy_only=False).view(_U))
            for chunk in chunks([batch.filter(pa.array(held.above(ids) > 0))]):
                found = {set_key(x): x for x in shingle_sets(chunk.buf, chunk.off, k) if len(x)}
                found = {name: x for name, x in found.items() if name not in seen}
                seen.update(found)
                yield pa.RecordBatch.from_pydict({"key": pa.array(list(found), pa.int64()), "tokens": pa.array([x.view(np.int64) for x in found.values()], pa.list_(pa.int64()))})

    found = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), "text").mapInArrow(run, "key bigint, tokens array<bigint>")
    out = scratch.cut(found.dropDuplicates(["key"]))
    held.free()
    return out


def _near(percent: int) -> Column:
    """Whether sizes (an, bn) and parities (ap0, bp0, ...) allow a link."""
    bits = " + ".join(f"bit_count(a{p} ^ b{p})" for p in BITS)
    return F.expr(f"100 * least(an, bn) >= {percent} * greatest(an, bn) AND ({bits}) * {100 + percent} <= {100 - percent} * (an + bn)")


def _side(ents: DataFrame, side: str) -> DataFrame:
    return ents.select(F.col("key").alias(side), *[F.col(c).alias(f"{side}{c}") for c in ("n", *BITS, "long")])


def verified(pairs: DataFrame, docs: DataFrame, ents: DataFrame, scratch: Scratch, k: int, percent: int) -> DataFrame:
    """Of the pairs of keys (a, b) those whose sets link.  Sizes and parities are looked at first, so that only sets that nearly link are fetched."""

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            an, bn, along, blong = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("an", "bn", "along", "blong"))
            yield b.select(["a", "b"]).filter(pa.array([bits_apart(x, y) * (100 + percent) <= (100 - percent) * (n + m) for x, y, n, m in zip(along, blong, an, bn)], pa.bool_()))

    pairs = pairs.select("a", "b").distinct().join(_side(ents, "a"), "a").join(_side(ents, "b"), "b").where(_near(percent))
    pairs = pairs.select("a", "b", "an", "bn", "along", "blong").mapInArrow(close, "a bigint, b bigint")
    pairs = scratch.cut(pairs)
    ends = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
    wanted = scratch.cut(ends.join(ents.select("key", "doc_id"), "key").select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id")))
    if wanted.isEmpty():
        return pairs
    tokens = picked_sets(docs, wanted, scratch, k)
    x = pairs.join(tokens.select(F.col("key").alias("a"), F.col("tokens").alias("ta")), "a").join(tokens.select(F.col("key").alias("b"), F.col("tokens").alias("tb")), "b")
    x = x.select("a", "b", F.size("ta").alias("na"), F.size("tb").alias("nb"), F.size(F.array_intersect("ta", "tb")).alias("both"))
    out = scratch.cut(x.where(F.expr(f"100 * both >= {percent} * (na + nb - both)")).select("a", "b"))
    scratch.free(pairs, wanted, tokens)
    return out


def _cells(listed: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """(cell, key, n, rare, pivot) of lists with members of several components and more than the pairs that are verified."""
    x = scratch.cut(listed.join(found, "key", "left").withColumn("component", F.coalesce("component", "key")))
    mixed = x.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("third").alias("third"), F.count("*").alias("m")).where("lo <> hi AND third").select("sig", "m")
    cell = F.when(F.col("m") > LONG, F.xxhash64("pivot", F.lit(1))).otherwise(F.col("sig"))
    return scratch.cut(x.join(mixed, "sig").select(cell.alias("cell"), "key", "n", "rare", "pivot").distinct())


def _placed(cells: DataFrame, found: DataFrame) -> DataFrame:
    """``cells`` with the component of each member and that of the pivot (main)."""
    main = found.select(F.col("key").alias("pivot"), F.col("component").alias("main"))
    x = cells.join(found, "key", "left").join(main, "pivot", "left")
    return x.withColumn("component", F.coalesce("component", "key")).withColumn("main", F.coalesce("main", "pivot"))


def links(docs: DataFrame, ents: DataFrame, scratch: Scratch, k: int, percent: int) -> DataFrame:
    """(key, component) of all keys that link with another.  ``ents``: key, doc_id, n, parity and copies of each set."""
    total = ents.agg(F.coalesce(F.sum(F.col("n") * F.col("copies")), F.lit(0)).alias("n")).first()["n"]
    load = max(8.0, total / sketch.MOST)
    noise = int(load + 6 * load**0.5)
    frequent = sketch.build(docs.select("text"), sketch.of_chunks(lambda c: np.concatenate([np.zeros(0, _U), *shingle_sets(c.buf, c.off, k)])), total, 1, (noise + 8, noise + 128), 1 / load)
    posted = scratch.cut(postings(docs, frequent, k, percent))
    frequent.free()
    often = repeated(posted, scratch, percent)
    top = often.groupBy("sig").agg(F.min(F.struct("rare", "key", "n")).alias("p"), F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi")
    top = top.select("sig", F.col("p.key").alias("pivot"), F.col("p.n").alias("pn"), "lo", "hi")
    third = (F.col("key") != F.col("lo")) & (F.col("key") != F.col("hi"))
    listed = scratch.cut(often.join(top, "sig").select("sig", "key", "n", "rare", "pivot", "pn", third.alias("third")))
    sized = F.expr(f"100 * least(n, pn) >= {percent} * greatest(n, pn)")
    edges = verified(listed.where((F.col("key") != F.col("pivot")) & sized).select(F.col("key").alias("a"), F.col("pivot").alias("b")), docs, ents, scratch, k, percent)
    found = scratch.cut(connected_components(edges).withColumnRenamed("node", "key"))
    cells = _cells(listed, found, scratch)
    scratch.free(listed)
    if cells.isEmpty():
        return found
    # A second pivot of each cell, outside of the first one's component.
    placed = _placed(cells, found).where("component <> main")
    top = placed.groupBy("cell").agg(F.min(F.struct("rare", "key", "n", "component")).alias("q"))
    second = placed.join(top, "cell").where("component <> q.component").where(F.expr(f"100 * least(n, q.n) >= {percent} * greatest(n, q.n)"))
    edges = edges.unionByName(verified(second.select(F.col("key").alias("a"), F.col("q.key").alias("b")), docs, ents, scratch, k, percent))
    found = scratch.cut(connected_components(edges).withColumnRenamed("node", "key"))
    placed = scratch.cut(_placed(cells.select("cell", "key", "pivot"), found))
    rest = placed.groupBy("cell").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("cell")
    placed = scratch.cut(placed.join(rest, "cell", "left_semi").join(ents.select("key", "n", *BITS), "key"))
    a = placed.where("component <> main").select(F.col("cell").alias("acell"), "main", F.col("key").alias("a"), *[F.col(c).alias(f"a{c}") for c in ("component", "n", *BITS)])
    b = placed.select(F.col("cell").alias("bcell"), F.col("key").alias("b"), *[F.col(c).alias(f"b{c}") for c in ("component", "n", *BITS)])
    pairs = a.join(b, (F.col("acell") == F.col("bcell")) & (F.col("acomponent") != F.col("bcomponent")) & ((F.col("bcomponent") == F.col("main")) | (F.col("a") < F.col("b"))) & _near(percent))
    last = verified(pairs, docs, ents, scratch, k, percent)
    return connected_components(edges.unionByName(last)).withColumnRenamed("node", "key")


def join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included)."""
    scratch = Scratch(docs.sparkSession)
    members = scratch.cut(sets(docs, k))
    each = [F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.count("*").alias("copies"), *[F.first(p).alias(p) for p in (*BITS, "long")]]
    ents = scratch.cut(members.where("key is not null").groupBy("key").agg(*each))
    found = scratch.cut(links(docs, ents, scratch, k, percent))
    # The smallest id of each component of several sets; any other component is one set.
    low = found.join(ents.select("key", "doc_id"), "key").groupBy("component").agg(F.min("doc_id").alias("low"))
    low = found.join(low, "component").select("key", "low")
    own = ents.select("key", "doc_id").join(low, "key", "left").select("key", F.coalesce("low", "doc_id").alias("low"))
    x = members.select("doc_id", "n_shingles", "key").join(own, "key", "left")
    out = scratch.cut(x.select("doc_id", "n_shingles", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("low")).alias("component_id")))
    scratch.held.pop()  # the result stays
    scratch.free()
    return out


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that have an earlier one in their component.  Rows that repeat an id share its fate: they go if
    every one of them is a later copy.

    Documents without words stay: they link with nothing.  So do those without an id."""
    x = join(docs, k, percent).where("doc_id is not null")
    first = F.max((F.col("n_shingles") == 0) | (F.col("doc_id") == F.col("component_id")))
    gone = x.groupBy("doc_id").agg(first.alias("first")).where("not first").select(F.col("doc_id").alias("gone"))
    return docs.join(gone, F.col("doc_id") == gone["gone"], "left_anti")

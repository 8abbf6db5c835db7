"""N-gram join, mixing, language model, language identification, toxicity, substring dedup and the pipeline."""

import hashlib
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clauseaudit.llm import language_id, language_model, mixing, ngram_join, sketch, substring_dedup, toxicity
from clauseaudit.llm.common import chunks, connected_components, mix

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def components(rows, k, percent):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    low = {g: min((r[0] for r, h in zip(rows, group) if h == g and r[0] is not None), default=None) for g in group}
    return Counter((r[0], len(s), low[g] if s else r[0]) for r, s, g in zip(rows, sets, group))


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_join(spark, odd, small, none, k, percent):
    rng = random.Random(k)
    rows = [(r.doc_id, r.text) for docs in (odd, small) for r in docs.select("doc_id", "text").collect()]
    for b in range(6):  # groups of near copies around a base, with few and many edits
        base = [f"g{b}w{rng.randrange(400)}" for _ in range(rng.choice([12, 60, 300]))]
        for c in range(25):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 9])):
                w[rng.randrange(len(w))] = rng.choice(["edit", "same", f"new{rng.randrange(50)}"])
            rows.append((100_000 + 100 * b + c, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert Counter(map(tuple, ngram_join.join(docs, k, percent).collect())) == components(rows, k, percent)
    assert ngram_join.join(none, k, percent).count() == 0
    kept = ngram_join.keep_one(odd, k, percent)
    assert kept.columns == odd.columns and 2 not in [r.doc_id for r in kept.collect()]


def test_signatures_lose_no_link():
    """Any two linked sets share a signature, whatever the classes."""
    rng = np.random.default_rng(0)
    for trial in range(300):
        percent = int(rng.choice([80, 90]))
        n = int(rng.integers(5, 400))
        x = np.unique(rng.integers(1, 1 << 60, n).astype(np.uint64))
        y = x.copy()
        gone = int(rng.integers(0, max(1, len(x) * (100 - percent) // 100) + 1))
        y = np.unique(np.append(np.delete(y, rng.permutation(len(y))[:gone]), rng.integers(1, 1 << 60, int(rng.integers(0, gone + 1))).astype(np.uint64)))
        both = len(np.intersect1d(x, y))
        if 100 * both < percent * (len(x) + len(y) - both) or len(x) == both == len(y):
            continue
        kind = lambda t: (mix(t) % np.uint64(3) if trial % 3 else mix(t) % np.uint64(2) + np.uint64(1) if trial % 2 else t * np.uint64(0) + np.uint64(2)).astype(int)
        (a, more_a), (b, more_b) = ngram_join.signatures(x, kind(x), percent), ngram_join.signatures(y, kind(y), percent)
        assert len(np.intersect1d(a, b))
        given = len(np.intersect1d(np.append(a, more_a), np.append(b, more_b)))
        for z in (x, y):
            assert given >= ngram_join.least_repeated(len(z), int((kind(z) == 0).sum()), percent)


def test_parity_bounds_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(50):
        x, y = (rng.integers(0, 300, 100).astype(np.uint64) for _ in range(2))
        x, y = np.unique(x), np.unique(y)
        bits = sum(int(v).bit_count() for v in (ngram_join.parity(x) ^ ngram_join.parity(y)).view(np.uint64))
        assert bits <= len(np.setxor1d(x, y))
    for _ in range(50):
        x = np.unique(rng.integers(0, 1 << 60, int(rng.integers(1500, 5000))).astype(np.uint64))
        y = np.unique(np.append(x[int(rng.integers(0, 400)) :], rng.integers(0, 1 << 60, int(rng.integers(0, 900))).astype(np.uint64)))
        apart = ngram_join.bits_apart(ngram_join.long_parity(x), ngram_join.long_parity(y))
        assert apart <= len(np.setxor1d(x, y)) and (apart > 0) == (len(np.setxor1d(x, y)) > 0)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 380)] + [(5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    group = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            group[a] = group[b] = min(group[a], group[b])
    assert got == {x: g for x, g in group.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_sketch_never_underestimates(spark):
    x = spark.range(0, 5000, 1, 3).selectExpr("id % 1700 as v")
    items = lambda batches: (b.column(0).to_numpy().astype(np.uint64) for b in batches)
    s = sketch.build(x, items, 5000, 2, (1, 2, 3), 1.0)
    every = np.arange(3000, dtype=np.uint64)
    count = np.bincount((np.arange(5000) % 1700), minlength=3000)
    assert (s.above(every) >= np.clip(count - 1, 0, 3)).all()
    assert (s.above(every[count == 0]) > 0).mean() < 0.05
    cells = np.sort(np.random.default_rng(0).integers(0, 1 << 20, 1000))
    assert (sketch.unpack(sketch.pack(cells)) == cells).all()


def test_sketch_takes_few_jobs(spark, monkeypatch):
    """However many partitions merge it; and whatever the driver takes at once, the planes are whole."""
    x = spark.range(0, 200_000, 1, 3).selectExpr("id % 70000 as v")
    items = lambda batches: (mix(b.column(0).to_numpy().astype(np.uint64)) for b in batches)
    names = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    spark.sparkContext.setJobGroup("sketch", "")
    s = sketch.build(x, items, 1 << 22, 2, (1, 2), 1.0)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("sketch"))
    monkeypatch.setattr(sketch, "FETCH", 1, raising=False)
    again = sketch.build(x, items, 1 << 22, 2, (1, 2), 1.0)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for k, v in before.items():
        spark.conf.set(k, v)
    assert 0 < jobs < 12
    every = mix(np.arange(70_000, dtype=np.uint64))
    assert (s.above(every) >= 1).all() and all((p == q).all() for a, b in zip(s.planes.value, again.planes.value) for p, q in zip(a, b))


def dedup(rows, size):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        w = WORD.findall(t or "")
        cover = [False] * len(w)
        for k in range(len(w) - size + 1):
            x = tuple(w[k : k + size])
            if x in seen:
                cover[k : k + size] = [True] * size
            seen.add(x)
        out.append((i, len(w), sum(cover), hashlib.sha256(" ".join(a for a, c in zip(w, cover) if not c).encode()).hexdigest()))
    return Counter(out)


def test_substring_dedup(spark, small, odd, none):
    rows = [(r.doc_id, r.text) for r in small.select("doc_id", "text").collect()]
    passage = " ".join(f"p{i}" for i in range(55))
    rows += [(10_000 + i, f"own{i} start {passage} end{i}") for i in range(30)] + [(20_000, "again " * 70), (20_001, None), (20_002, "")]
    x = substring_dedup.remove(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5))
    got = Counter((r.doc_id, r._n_words, r._n_removed, hashlib.sha256(r._kept.encode()).hexdigest()) for r in x.collect())
    assert got == dedup(rows, 20)
    y = substring_dedup.clean(odd)
    texts = {r.doc_id: r for r in y.collect() if r.doc_id not in (3, 7, None)}
    assert y.columns == odd.columns and texts[5].text is None and texts[10].text == odd.where("doc_id = 10").first().text
    assert 2 not in texts  # an exact copy loses all its words
    assert len([r for r in y.collect() if r.doc_id == 7]) == 2
    assert substring_dedup.clean(none).count() == 0


def test_substring_dedup_slices(spark, small):
    """With more slices of the hash space, each in a small sketch, the result and the share of candidates stay."""
    docs = small.select("doc_id", "text")
    whole, sliced = (Counter(map(tuple, substring_dedup.remove(docs, most=most).select("doc_id", "_n_removed", "_kept").collect())) for most in (1 << 30, 1 << 14))
    assert whole == sliced
    rng = random.Random(2)
    texts = spark.createDataFrame([(i, " ".join(f"v{rng.randrange(10**6)}" for _ in range(2000))) for i in range(300)], "doc_id bigint, text string")
    found = [np.concatenate([substring_dedup._minimizers(c, 20) for c in chunks([pa.RecordBatch.from_pydict({"text": [r.text]})])]) for r in texts.collect()]
    least = np.unique(np.concatenate(found))
    assert len(least) < substring_dedup.SHARE * 600_000
    shares = []
    for n in (1, 4):
        let = 0
        for k in range(n):
            own = lambda batches, k=k, n=n: (m[sketch.slice_of(m, n) == k] for c in batches for m in [np.concatenate([substring_dedup._minimizers(x, 20) for x in chunks([c])])])
            counted = sketch.build(texts.select("text"), own, len(least) / n, 2, (1,), 3.0, least=1 << 10, most=(1 << 18) // n)
            let += int((counted.above(least[sketch.slice_of(least, n) == k]) > 0).sum())
        shares.append(let / len(least))
    assert max(shares) < 0.2 and abs(shares[0] - shares[1]) < 0.15


def test_substring_dedup_copies(spark):
    """Of rows with one id and one text the first stays whole; rows without an id are told apart and spread."""
    rng = random.Random(9)
    texts = [" ".join(f"n{rng.randrange(40)}" for _ in range(rng.randrange(15, 80))) for _ in range(60)]
    shared = " ".join(f"s{i}" for i in range(25))
    rows = [(1, texts[0]), (1, texts[0]), (1, texts[1]), (2, texts[0]), (3, texts[2]), (3, texts[2]), (3, texts[2]), (4, "few words"), (4, "few words")]
    rows += [(None, f"{t} {shared}") for t in texts[3:]] + [(None, texts[4])] * 2 + [(None, texts[2])]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, k int").repartition(4)
    order = sorted(docs.select("doc_id", "text", F.xxhash64("text")).collect(), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    got = substring_dedup.remove(docs)
    assert Counter((r.doc_id, r._n_words, r._n_removed, hashlib.sha256(r._kept.encode()).hexdigest()) for r in got.collect()) == dedup([r[:2] for r in order], 20)
    assert Counter(r.doc_id for r in substring_dedup.clean(docs).collect() if r.text in (texts[0], texts[2])) == Counter([1, 3])
    null = docs.where("doc_id is null").select("text")
    shards = {(substring_dedup.NULL_ID ^ r[0]) % 67 for r in null.select(F.xxhash64("text")).collect()}
    assert len(shards) > 20


def test_mixing(spark, small, odd, none):
    for docs in (small, odd, odd.where("doc_id in (4, 5)")):
        got = mixing.mix(docs).select("doc_id", "source", F.xxhash64("text").alias("h"), "size", "source_size", "target", "taken").collect()
        assert Counter((r.doc_id, r.source) for r in got) == Counter((r.doc_id, r.source) for r in docs.collect())
        sizes = Counter()
        for r in docs.collect():
            sizes[r.source] += len(WORD.findall(r.text or ""))
        names = sorted(sizes, key=lambda s: (s is None, s or ""))
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
        want, capped = {}, set()
        while True:
            free = [s for s in names if s not in capped]
            left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
            want = {s: 3 * sizes[s] if s in capped else left * weight[s] / sum(weight[z] for z in free) for s in names}
            more = {s for s in free if want[s] > 3 * sizes[s]}
            if not more:
                break
            capped |= more
        for s in names:
            own = [r for r in got if r.source == s]
            assert own[0].target == pytest.approx(want[s]) and own[0].source_size == sizes[s]
            assert sum(r.taken for r in own) == (round(want[s]) if want[s] % 1 != 0.5 else pytest.approx(want[s], abs=1))
            assert all(0 <= r.taken <= 3 * r.size for r in own)
        again = mixing.mix(docs.repartition(7)).select("doc_id", "source", F.xxhash64("text").alias("h"), "size", "source_size", "target", "taken").collect()
        assert Counter(got) == Counter(again)
    drawn = mixing.draw(odd)
    assert drawn.columns == odd.columns
    words = sum(len(WORD.findall(r.text or "")) for r in drawn.collect())
    assert words == sum(r.taken for r in mixing.mix(odd).collect())
    assert mixing.mix(none).count() == 0 and mixing.draw(none).count() == 0


def test_language_model(spark, small, odd, none):
    docs = small.select("doc_id", "text").union(odd.select("doc_id", "text").where("doc_id is null or doc_id in (4, 5, 6)"))
    rows = docs.collect()
    tokens = [WORD.findall((r.text or "").translate(LOW)) + [None] for r in rows]
    held = [r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows]
    c = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    got = language_model.score(docs).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got) == Counter((r.doc_id, h, len(t), sum(c[w] > 0 for w in t), n) for r, t, h in zip(rows, tokens, held))
    base = sorted(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in t) for t in tokens)
    assert np.allclose(sorted(r.base_score for r in got), base)
    test = [r for r in got if r.held_out]
    assert sum(r.score for r in test) > sum(r.base_score for r in test)
    assert language_model.score(none).count() == 0


def test_language_model_collects_heavy_words_only(spark, small, monkeypatch):
    """Entries that the driver unpacks are those of words above 1 / HEAVY of all tokens."""
    seen, unpack = [], language_model._columns

    def spy(data, *kinds):
        out = unpack(data, *kinds)
        seen.append(out)
        return out

    monkeypatch.setattr(language_model, "_columns", spy)
    tokens = language_model.score(small).first().train_tokens
    counts = np.concatenate([c[2] for c in seen])
    assert len(counts) and (counts * language_model.HEAVY > tokens).all()


def test_language_model_sums_to_one():
    rng = np.random.default_rng(0)
    code = np.unique((rng.integers(1, 200, 3000).astype(np.uint64) << np.uint64(8)) | rng.integers(0, 4, 3000).astype(np.uint64))
    r = language_model.Restaurants(code, rng.integers(1, 50, len(code)), 0, 1)
    assert all((t <= r.count).all() and (t >= 1).all() for t, _, _ in r.samples)
    totals = language_model.Totals(r.totals())
    for context in range(4):
        every = np.append(r.word << np.uint64(8) | np.uint64(context), np.uint64(10**9 << 8 | context))  # all words and one unknown
        logp, _ = language_model._lookup(r, totals, every)
        assert (10**logp).sum() == pytest.approx(1)


def test_language_id(spark, small, odd, none):
    got = language_id.identify(small).join(small.select("doc_id", "lang"), "doc_id").collect()
    test = [r for r in got if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in test]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    x = language_id.identify(odd).collect()
    assert len(x) == odd.count() and {r.lang_pred for r in x if r.doc_id in (4, 5, 6)} == {"und"}
    assert language_id.identify(none).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_id_letters(spark):
    """Against the class of every character; numbers that are no digits are no letters."""
    texts = ["½ ² ④ Ⅷ", "④ b", "", "__ 12 ١٢", "ñ", "😀", "क", "\u0301", "ǅ", "ªº"]
    off = np.cumsum([0] + [len(t.encode()) for t in texts])
    got = language_id.lettered(np.frombuffer("".join(texts).encode(), np.uint8), off)
    assert got.tolist() == [any(unicodedata.category(c)[0] == "L" for c in t) for t in texts] and got.sum() == 5
    rows = [(i, f"the word {i} of all", "en") for i in range(40)] + [(100 + i, f"das Wort {i} von vielen", "de") for i in range(3)] + [(200, "½ ² ④", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs).collect()}[200] == ("und", 0.0)
    few = language_id.train(docs, max_bytes=60)  # the shares of two languages: one or two short texts each
    assert few.names == ["de", "en"]


def test_language_id_long_texts(spark):
    """Two languages with very many n-grams: a text of 1 MB is told as well as a short one; 70 languages are all learnt."""
    rng = random.Random(4)
    letters = {"aa": "abcdefghijklm", "bb": "nopqrstuvwxyz"}
    text = lambda lang, n: " ".join("".join(rng.choices(letters[lang], k=6)) for _ in range(n))
    rows = [(i, text(lang, 150), lang) for i, lang in enumerate(["aa", "bb"] * 100)] + [(1000, text("aa", 150_000), None), (1001, text("bb", 150_000), None)]
    got = {r.doc_id: r.lang_pred for r in language_id.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert (got[1000], got[1001]) == ("aa", "bb")
    pairs = [(f"{chr(97 + i % 26)}{chr(97 + i // 26)}q{i} " * 5, f"l{i:02d}") for i in range(70)]
    rows = [(70 * k + i, t, lang) for k in range(4) for i, (t, lang) in enumerate(pairs)]
    assert len(language_id.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).names) == 70


def test_toxicity(spark, odd, none):
    rng = random.Random(0)
    rows, labels = [], []
    for i in range(1500):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 60))]
        if bad := i % 8 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(["vilest", "rotten"]))
        rows.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = toxicity.score(docs, marks).collect()
    test = [r for r in got if r.held_out]
    assert np.mean([r.predicted == (r.doc_id % 8 == 0) for r in test]) > 0.97 and all(r.predicted == (r.score >= 0.5) for r in got)
    kept = toxicity.keep_clean(docs.withColumn("extra", F.lit(1)), marks)
    assert kept.columns == ["doc_id", "text", "extra"] and 1280 < kept.count() < 1340
    null = spark.createDataFrame([(None, 1), (1, None), (3, 1), (3, 0), (3, 1)], "doc_id bigint, toxic int")
    assert toxicity.score(odd, null).count() == odd.count()
    assert toxicity.score(none, null.where("false")).count() == 0
    assert {r.predicted for r in toxicity.score(odd, null.where("false")).collect()} == {0}


@pytest.mark.parametrize("prior", [0.3, 0.5, 0.6, 0.8])
def test_toxicity_at_any_prior(prior):
    """With words that tell, texts are told apart; without, every score is the prior and nothing is learnt."""
    rng = random.Random(1)
    text = lambda bad: " ".join([f"w{rng.randrange(50)}" for _ in range(30)] + ["vilest"] * bad)
    unlabelled = [text(rng.random() < prior) for _ in range(3000)]
    model = toxicity.fit([text(True) for _ in range(800)], unlabelled, prior)

    def scores(m, texts):
        row, col = toxicity.features(np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)]))
        return m.margins(row, col, len(texts))

    assert model.learnt and np.array_equal(scores(model, unlabelled) > 0, ["vilest" in t for t in unlabelled])
    blind = toxicity.fit([text(False) for _ in range(800)], unlabelled, prior)
    assert not blind.learnt and np.allclose(1 / (1 + np.exp(-scores(blind, unlabelled))), prior)


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "substring_dedup", "mixing", "byte_bpe"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = spark.createDataFrame(out.collect(), docs.schema)
    want = Counter(tuple(r) for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect())
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, sf).collect()) == want


INTERNAL = "_score score row _kept kept n_words _n_words _n_removed n_removed shard tie size source_size target taken _text _row _key _tie _range _src gone key component low first sig cell pivot a b data kind a.b a`b".split()


def test_clashing_names(spark, odd):
    """Columns of the input that are named like internal ones come out as they were."""
    docs = odd.select("doc_id", "text", "source", "n_chars", *[F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in INTERNAL])
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 12)], "doc_id bigint, toxic int")
    for got in (toxicity.keep_clean(docs, labels), ngram_join.keep_one(docs), substring_dedup.clean(docs), mixing.draw(docs)):
        assert got.columns == docs.columns
        rows = got.collect()
        assert rows and all(r[c] == f"{c} {'-' if r.doc_id is None else r.doc_id}" for r in rows for c in INTERNAL)

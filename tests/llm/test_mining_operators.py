"""Collocations, centroid clustering and main text of pages."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from clauseaudit.llm import centroids, collocations, html_text

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def phrases(rows, least, longest=5, top=2000):
    """Brute force over (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(ws)
            for size in range(1, longest + 1):
                f.update((lang or "und", *ws[i : i + size]) for i in range(len(ws) - size + 1))
    cand = {k: a for k, a in f.items() if len(k) > 2 and a >= least}
    inside = Counter()
    for k, a in cand.items():
        for size in range(2, len(k) - 1):
            for i in range(1, len(k) - size + 1):
                key = (k[0], *k[i : i + size])
                inside[key] = max(inside[key], a)
    out = {}
    for k, a in cand.items():
        if inside[k] < a:
            cuts = [(1000 * a * n[k[0]] // (f[k[: c + 1]] * f[(k[0], *k[c + 1 :])]), c) for c in range(1, len(k) - 1)]
            score, c = min(cuts)
            out.setdefault(k[0], []).append((-score, -a, " ".join(k[1:]).encode(), f[k[: c + 1]], f[(k[0], *k[c + 1 :])]))
    return {(lang, i, p.decode(), -a, le, r, n[lang], -s) for lang, x in out.items() for i, (s, a, p, le, r) in enumerate(sorted(x)[:top], 1)}



def test_collocations(spark, odd, none, small):
    rng = random.Random(3)
    texts = [(i, rng.choice(["en", "en", "de", None]), " ".join(rng.choices(["Über", "to", "be", "or", "NOT", "x", "y."], [1, 5, 4, 3, 2, 9, 1], k=rng.randrange(60))) + rng.choice(["", " a b c d e f g", "\tred \x0bTape", " red tape! red tape"])) for i in range(300)]
    texts += [(None, None, None), (1, "en", ""), (2, "en", " \t.,"), (3, "en", "long word " * 30_000)]
    docs = spark.createDataFrame(texts, "doc_id bigint, lang string, text string").repartition(3)
    for least, top in ((2, 2000), (25, 7)):
        got = {tuple(r)[:8] for r in collocations.mine(docs, least=least, top=top).collect()}
        assert got == phrases([t[1:] for t in texts], least, top=top) and got
    assert {tuple(r)[:8] for r in collocations.mine(odd, least=3).collect()} == phrases([(r.lang, r.text) for r in odd.collect()], 3)
    assert {tuple(r)[:8] for r in collocations.mine(small).collect()} == phrases([(r.lang, r.text) for r in small.collect()], 100)
    assert collocations.mine(none).collect() == [] and collocations.mine(docs.where("doc_id = 1")).collect() == []


def test_collocations_point_to_an_occurrence(spark, small):
    words = {r.doc_id: re.findall(r"[^\x20\x09-\x0D.,;:!?]+", r.text.translate(LOWER)) for r in small.collect()}
    for r in collocations.mine(small, least=20).collect():
        size = r.phrase.count(" ") + 1
        assert " ".join(words[r.doc_id][r.word : r.word + size]) == r.phrase


def test_collocations_with_equal_fingerprints(spark, monkeypatch):
    """All runs of a length share one of a few fingerprints, all words one of a few hashes: the texts tell them apart."""
    rows = [(i, "en", " ".join(f"w{(i * j) % 7}" for j in range(1, 15))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string").coalesce(1)

    class Few(collocations.Runs):
        def __init__(self, chunk):
            super().__init__(chunk)
            self.hashes = self.hashes % np.uint64(3)

        def fingerprints(self, at, size):
            return (np.arange(len(at)) * 0 + size).astype(np.uint64)

    want = phrases([r[1:] for r in rows], 10)
    monkeypatch.setattr(collocations, "Runs", Few)
    assert {tuple(r)[:8] for r in collocations.mine(docs, least=10).collect()} == want and want


def clusters(rows, k=8, rounds=10, seed=3):
    """Brute force over (vec_id, components) in Python integers."""
    kept = [(i, [int(np.floor(float(np.float32(x)) * 1024)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    cs = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(cs))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        cs = [[sum(col) // len(col) for col in zip(*m)] if (m := [v for (_, v), o in zip(kept, own) if o == i]) else c for i, c in enumerate(cs)]
    got = [(i, *near(v)) for i, v in kept]
    inertia = Counter()
    for _, d, c in got:
        inertia[c] += d
    return Counter((i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, cs[c])).encode()).hexdigest()) for i, d, c in got)


VECTORS = "vec_id bigint, embedding array<float>, label int, v string, cluster string, key string"


def test_centroids(spark):
    rng = np.random.default_rng(0)
    base = [(int(i), [float(x) for x in rng.normal(size=64) * 0.2 + (i % 3)]) for i in range(90)]
    rows = base + base[:5] + [(91, None), (92, []), (93, [1.0] * 63), (94, [None] + [0.0] * 63), (95, [float("nan")] + [0.0] * 63), (96, [float("-inf")] + [0.0] * 63), (97, [-0.0001] * 64), (None, [0.5] * 64), (None, [0.25] * 64), (3, [9.0] * 64)]
    frame = lambda r: spark.createDataFrame([(i, v, None, "clash", "clash", "clash") for i, v in r], VECTORS)
    got = lambda r: Counter(tuple(x)[:6] for x in centroids.cluster(frame(r)).collect())
    assert got(rows) == clusters(rows)
    assert got(base[:3]) == clusters(base[:3])  # fewer vectors than centroids
    assert got([(i, [1.0] * 64) for i in range(20)]) == clusters([(i, [1.0] * 64) for i in range(20)])  # ties: the first centroid takes all, the others stay
    assert got([(91, None)]) == got([]) == Counter()
    far = centroids.cluster(frame([(1, [3e38] * 64), (2, [-3e38] * 64)])).collect()
    assert [r.distance for r in far] == [0, 0] and far[0].centroid == [centroids.BOUND] * 64 or far[0].centroid == [-centroids.BOUND] * 64


def test_centroids_stay_in_the_jvm(spark):
    df = spark.createDataFrame([(1, [0.0] * 64)], "vec_id bigint, embedding array<float>")
    plan = centroids.integers(df).select(centroids.nearest([[0] * 64]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


PROSE = ["The first paragraph says something at length about the matter, and goes on for a while.", "Short one.", "A third, with a link in it & more words than a menu has, so that it counts as text."]
BODY = f"<p>{PROSE[0]}</p>\n<p>{PROSE[1]}<p>A third, with a <a href='/x'>link</a>\n in it &amp; more <b>words</b> than a menu<br>has, so that it counts as text."
MENU = "<ul>" + "".join(f"<li><a href='/{i}'>Menu entry {i}</a>" for i in range(8)) + "</ul>"
JUNK = "Much text that is longer than the article's and would win by its length alone, were it not set aside by what it is. " * 5
PAGES = {
    "article": f"<html><head><title>T</title></head><body><nav>{MENU}</nav><article><h1>Head</h1>{BODY}</article><footer>&copy; x</footer></body></html>",
    "no hints": f"<body><div>{MENU}</div><div><h1>Head</h1>{BODY}</div><div><a href=a>Imprint</a> <a href=b>Terms</a></div></body>",
    "main and aside": f"<main><h1>Head</h1><div class='entry-content'>{BODY}</div><aside>{JUNK}</aside></main>",
    "comments": f"<div id='wrap'><article><header><h1>Head</h1></header>{BODY}<footer>By someone</footer></article><section id='comments'><article><p>{JUNK}</p></article></section></div>",
    "page header": f"<header><h1>Site</h1><p>{JUNK}</p></header><div class='content-with-sidebar'><h1>Head</h1><div class='post'>{BODY}</div></div><div class='left-sidebar'><p>{JUNK}</p></div>",
    "form around": f"<form><div class='cookie-notice'><p>{JUNK}</p></div><article><h1>Head</h1>{BODY}<div class='ad-slot'>{JUNK}</div></article><input value=x><button>Send</button></form>",
    "hidden, scripts": f"<body><article><h1>Head</h1><script>var t='</p>{JUNK}';</script><div style='display: none'>{JUNK}</div><template><p>{JUNK}</p></template>{BODY}<!-- <p>{JUNK}</p> --></article><dialog>{JUNK}</dialog></body>",
    "open head": f"<head><title>T</title><meta charset=utf-8><style>p{{}}</style><article class=post><h1>He<!-- x -->ad</h1>{BODY}",
    "share in a line": f"<article><h1>Head</h1><p>{PROSE[0]}<span class='share-buttons'>Share</span></p>{BODY.partition('</p>')[2]}<div role=navigation>{MENU}</div></article>",
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    assert html_text.main_lines(PAGES[name]) == ["Head", *PROSE]


def test_main_text_of_other_blocks():
    page = "<article><h2>Caf&eacute; &#x4f60;</h2>loose <i>te</i>xt<ul><li>one<li>two <ul><li>in</ul></ul><table><tr><td>a<td>b<tr><td>c</table><pre>x\n  y</pre><blockquote>q</blockquote><dl><dt>t<dd>d</dl></article>"
    assert html_text.main_lines(page) == ["Café 你", "loose text", "one", "two", "in", "a", "b", "c", "x y", "q", "t", "d"]


def test_pages_of_all_kinds(spark):
    deep = "<div>" * 20_000 + "deep" + "</p></b>" * 2000
    rows = [(1, "u", PAGES["article"]), (1, "u", PAGES["article"]), (None, None, None), (2, "u", ""), (3, "u", " \n "), (4, "u", "<nav>only a menu</nav>"), (5, None, "plain &lt;text"), (6, "u", deep), (7, "u", "<article>" + "<p>word</p>" * 50_000), (8, "u", "<<>><p <a </ &#xZ; &bogus; <!-- open")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id bigint, url string, html string, text string, n_chars int")
    got = html_text.extract(df).collect()
    want = "\n\n".join(["Head", *PROSE])
    assert [r.text for r in got][:8] == [want, want, "", "", "", "", "plain <text", "deep"] and got[8].n_chars == 50_000 * 6 - 2
    assert all(r.n_chars == len(r.text) for r in got) and got[2].page_id is None
    assert html_text.extract(df.where("false")).collect() == []


def test_smoothing_and_threshold():
    x = np.array([0.0, 0, 0, 60, 80, 3, 70, 0, 0, 0])
    s = html_text.smooth(x)
    assert s[5] > html_text.threshold(s) > s[0] and np.allclose(html_text.smooth(np.full(4, 2.0)), 2)
    assert html_text.threshold(np.full(3, 5.0)) == 5


def test_memory_of_a_chunk_and_of_sums():
    """What a task of op11 holds beside Spark: a chunk's arrays, and the counts between two sums."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from clauseaudit.llm import collocations
    from clauseaudit.llm.common import Chunk

    text = np.frombuffer((b"some words that stand here " * (1 + collocations.CHUNK // 27))[: collocations.CHUNK], np.uint8)
    chunk = Chunk(pa.RecordBatch.from_pydict({"lang_key": pa.array([7], pa.int64())}), text, np.array([0, len(text)], np.int64))
    tracemalloc.start()
    try:
        runs = collocations.Runs(chunk)
        collocations._told_apart(runs), collocations._spaced(runs)
        of_chunk = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        keys = np.arange(collocations.FLUSH, dtype=np.uint64)
        collocations._sums(keys, np.ones(len(keys), np.int64))
        of_sums = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert of_chunk < 100e6 and of_sums < 150e6, (of_chunk, of_sums)

"""Byte BPE, Ogg, chat formatting and fingerprints."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from clauseaudit.llm import byte_bpe, chat, fingerprint, ogg, queries

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
sha = lambda b: hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_boundaries_of_random_texts(reference):
    rng = random.Random(1)
    alphabet = ["a", "Z", "é", "1", "²", " ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "'S", ".", "—", "你", "😀", "\x1c", "\x85", "　", "_", "̀"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(3000)] + ["", "'", "a" * 3000, " " * 500 + "x"]
    raw = [t.encode() for t in texts]
    off = np.cumsum([0, *map(len, raw)])
    data = b"".join(raw)
    begin = byte_bpe.slices(np.frombuffer(data, np.uint8), off)
    stop, cut = np.append(begin[1:], len(data)), np.searchsorted(begin, off)
    v = byte_bpe.Vocabulary(PATH)
    for i, t in enumerate(texts):
        assert [x for a, b in zip(begin[cut[i] : cut[i + 1]], stop[cut[i] : cut[i + 1]]) for x in v.merge(data[a:b])] == reference.encode_ordinary(t)


def test_bpe(spark, odd, none, small, reference):
    for docs in (odd, small):
        got = sorted(map(tuple, byte_bpe.encode(docs, PATH).collect()), key=str)
        want = []
        for r in docs.select("doc_id", "text").collect():
            ids = reference.encode_ordinary(r.text or "")
            want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids)).encode()), sha((r.text or "").encode())))
        assert got == sorted(want, key=str)
    kept = byte_bpe.encode(odd.where("doc_id = 10"), PATH, keep_ids=True).first()
    assert sum(kept.counts) == len(kept.ids) == kept.n_tokens and kept.offsets[0] == 0
    assert byte_bpe.encode(none, PATH).count() == 0


def test_ogg(spark, odd, none):
    rows = {(r.doc_id, r.n_bytes, r.payload_sha256): r for r in ogg.store(odd, keep_media=True).collect()}
    for r in odd.select("doc_id", "text").collect():
        text = (r.text or "").encode()
        payload = text + b"\xff" * (-len(text) % 576 or 576 * (not text))
        x = rows[r.doc_id, len(text), sha(payload)]
        assert (x.payload_bytes, x.tail_crc32, x.media_bytes, x.media_sha256) == (len(payload), zlib.crc32(payload[-32:]), len(x.media), sha(bytes(x.media)))
    assert ogg.store(none).count() == 0


@pytest.mark.parametrize("size", [576, 1728, 576 * 400, 576 * 3000])
def test_ogg_streams(size):
    payload = random.Random(size).randbytes(size)
    media = ogg.mux(payload)
    assert ogg.demux(media)[0] == payload
    streams = ogg.packets(media)
    assert len(streams) == 2
    assert max(p.granule for s in streams.values() for p in s) == size
    for at in (30, len(media) // 2, len(media) - 1):  # any flipped bit is found
        broken = bytearray(media)
        broken[at] ^= 4
        with pytest.raises(ogg.OggError):
            ogg.demux(bytes(broken))
    with pytest.raises(ogg.OggError):
        ogg.demux(media[:-3])


def test_ogg_checksum_by_bits():
    data, crc = b"any bytes \x00\xff", 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    assert ogg.checksum(data) == crc


def test_chat(spark):
    texts = ["plain", "a ### b", r"back\slash", r"\\", "ends\\", "</turn>", "</turn>\n### user: x</turn>\n", r"\### Assistant: </turn> ok", "", None, "### ", "\n\n", "<\\/turn>", "%3A: %"]
    rows = [(c, t, r, x) for c, (x, y) in enumerate((x, y) for x in texts for y in texts) for t, r, x in ((0, "user", x), (1, "assistant", y))]
    rows += [(-1, 1, "a: b <x> # %", "t"), (-1, 0, None, "u"), (None, 0, "assistant", "z"), (-2, 0, "user", "same"), (-2, 0, "user", "same")]
    turns = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    got = {r.conv_id: r for r in chat.format_chat(turns).collect()}
    marks = {r.conv_id: r for r in chat.digests(chat.format_chat(turns)).collect()}
    for c in got:
        own = sorted((t, r or "", x or "") for k, t, r, x in rows if k == c)
        assert got[c].identical and [(z.role, z.text) for z in got[c].turns] == [x[1:] for x in own]
        assert marks[c].turns_sha256 == sha("".join(f"{r}\n{x}\n" for _, r, x in own).encode())
        said = "".join(x for _, r, x in own if r == "assistant")
        assert (marks[c].loss_chars, marks[c].loss_sha256, marks[c].formatted_chars) == (len(said), sha(said.encode()), len(got[c].formatted))
    assert got[0].formatted == "### user: plain</turn>\n### assistant: plain</turn>\n"
    assert chat.format_chat(turns.where("false")).count() == 0


def _paragraphs(t):
    lines = [y for line in t.split("\n") for y in (re.split(r"(?<=[.!?]) ", line) if len(line) > 160 else [line])]
    return {z for y in lines for z in (re.findall(r"(?s).{100,240}?[,;:)eanst](?=[ \t])|.{1,240}", y) if len(y) > 240 else [y]) if z}


def _likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(spark, small, odd, none):
    got = {r.doc_id: r for r in fingerprint.fingerprints(small).collect()}
    docs = small.orderBy("doc_id", ascending=False).collect()
    for i, d in enumerate(docs):
        after = docs[(i + 1) % len(docs)].text
        half = len(d.text) // 2
        edited = d.text[: len(d.text) - half] + after[:half]
        r = got[d.doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(d.text), sha(edited.encode()))
        assert r.near_edited == pytest.approx(_likeness(_paragraphs(d.text), _paragraphs(edited)))
        assert r.near_next == pytest.approx(_likeness(_paragraphs(d.text), _paragraphs(after)))
    got = [(r.doc_id, r.n_chars, r.fingerprint) for r in fingerprint.fingerprints(odd).collect()]
    assert len(got) == odd.count() and all(r.near_edited is not None and r.near_next is not None for r in fingerprint.fingerprints(odd).collect())
    assert len({f for i, _, f in got if i in (1, 2)}) == len({f for i, _, f in got if i == 3}) == 1  # equal texts
    assert {f for i, _, f in got if i in (4, 5)} == {""} and len({f for i, _, f in got if i == 7}) == 2
    assert fingerprint.fingerprints(none).count() == 0
    one = fingerprint.fingerprints(odd.where("doc_id = 11")).first()
    assert one.near_next == 1.0


def test_fingerprints_follow_on(spark):
    """The order holds across ranges, repeated ids and missing ids."""
    rng = random.Random(4)
    ids = [rng.choice([7, 7, None, rng.randrange(10**6), rng.randrange(10**6)]) for _ in range(400)]
    docs = spark.createDataFrame([(i, f"text {k % 300} of it") for k, i in enumerate(ids)], "doc_id bigint, text string").selectExpr("*", "xxhash64(text) AS tie")
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.tie))
    want = sorted((str(r.doc_id), r.text, rows[(k + 1) % len(rows)].text) for k, r in enumerate(rows))
    assert sorted((str(r.doc_id), r.text, r.next_text) for r in fingerprint.with_next(docs, 8, 20).collect()) == want


@pytest.mark.parametrize("n", [0, 1, 3, 12, 80, 1500])
def test_fingerprints_peel(spark, n):
    """Differences of any size are recovered; a table that is too small gives null, and the next larger one is tried."""
    left, right = [f"a{i}" for i in range(n)] + [f"c{i}" for i in range(7)], [f"c{i}" for i in range(5)] + [f"b{i}" for i in range(n // 3)]
    x = spark.createDataFrame([(left, right)], "a array<string>, b array<string>").selectExpr("transform(a, x -> xxhash64(x)) AS a", "transform(b, x -> xxhash64(x)) AS b").selectExpr("a", "b", f"{fingerprint.fingerprint('a')} AS ca", f"{fingerprint.fingerprint('b')} AS cb")
    first = x.selectExpr(f"{fingerprint.peel(fingerprint.subtract('ca', 'cb'), str(fingerprint.BASE))} AS d").first().d
    assert (first is None and n > 1) or first == (n + 2, n // 3)
    assert x.selectExpr(f"{fingerprint._larger('a', 'b')} AS d").first().d == (n + 2, n // 3)
    assert x.select(fingerprint.likeness("a", "ca", "b", "cb")).first()[0] == pytest.approx(5 / (n + 7 + n // 3))


def test_registered():
    assert sorted(queries.QUERIES, key=lambda q: int(q[2:].split("_")[0])) == [q for n in range(1, 14) for q in queries.QUERIES if q.startswith(f"op{n}_")]


def test_arrow_batches_are_bounded_by_bytes(spark):
    """A task gets its rows in batches of about BATCH_BYTES, not its split at once, through the operators that set it."""
    from clauseaudit.llm import byte_bpe, common

    docs = spark.range(0, 1500, 1, 1).selectExpr("id as doc_id", "repeat('some words ', 1000) as text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"size": pa.array([b.nbytes], pa.int64())})

    byte_bpe.encode(docs, PATH)
    got = [r["size"] for r in docs.mapInArrow(sizes, "size bigint").collect()]
    assert len(got) > 2 and max(got) < 2 * common.BATCH_BYTES
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")
    common.small_batches(docs)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1m"
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(common.BATCH_BYTES))

"""Operators that work on one text at a time, and packing, against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import zstandard
from tokenizers import Tokenizer

from maskloom.llm import bpe, packing, queries, warc, winnowing

ROWS = [(3, "héllo wörld, it's 12 o'clock"), (1, None), (2, ""), (4, "a" * 700), (5, "word one two\n  three " * 90), (5, "word one two\n  three " * 90), (None, "null id <|endoftext|>"), (7, "你好世界" * 300)]


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in ROWS], "doc_id long, text string, n_tokens int, ids string")


@pytest.mark.parametrize("chunk, overlap", [(100, 40), (64, 64), (1000, 100)])
def test_bpe_round_trip(docs, chunk, overlap):
    enc = bpe.encoding(queries.RANKS, P.PATTERN)
    got = bpe.decode(bpe.encode(docs, queries.RANKS, P.PATTERN, chunk=chunk, overlap=overlap), queries.RANKS).collect()
    want = [(i, np.array(enc.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in ROWS]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, bytes(r.ids), bytes(r.decoded))) for r in got)


def test_bpe_chunks_of_random_texts():
    rng, enc = random.Random(1), bpe.encoding(queries.RANKS, P.PATTERN)
    for _ in range(200):
        text = "".join(rng.choice(["a", "bc", " ", "  ", "\n", "'ll", "'r", "1", "!!", "é", "\t", "世"]) for _ in range(400))
        by_seam = {}
        for i in range(0, len(text), 50):
            for seam, at, sure in bpe.seams(text[i : i + 80], i // 50, i + 50 >= len(text), P.PATTERN, 50, 30):
                by_seam.setdefault(seam, []).append((set(at), set(sure)))
        least = lambda x: min(x, default=None)
        found = bpe.cuts([(least(a[0] & b[0] & (a[1] | b[1])), least(a[0] & b[0])) for a, b in (by_seam[k] for k in sorted(by_seam))])
        cuts = [0, *(c for c in found if c is not None), len(text)]
        assert len(cuts) > 3 and sum((enc.encode_ordinary(text[a:b]) for a, b in zip(cuts, cuts[1:])), []) == enc.encode_ordinary(text)


def test_bpe_of_long_texts(spark):
    """Far more than a chunk; a run without a boundary over several chunks; and no texts at all."""
    rng = random.Random(4)
    words = lambda n: "".join(rng.choice(["word", " ", "\n\n", "é", "'ll ", "世界", "12", "! "]) for _ in range(n))
    texts = [words(60_000), words(9_000) + "a" * 90_000 + words(9_000), "\n" * 70_000, words(60_000), None, ""]
    docs = spark.createDataFrame([(i % 5, t, 0, 0, "x") for i, t in enumerate(texts)], "doc_id long, text string, row int, i int, at string")
    enc = bpe.encoding(queries.RANKS, P.PATTERN)
    got = bpe.encode(docs, queries.RANKS, P.PATTERN).collect()
    assert sorted((r.doc_id, bytes(r.ids)) for r in got) == sorted((i % 5, np.array(enc.encode_ordinary(t or ""), "<u4").tobytes()) for i, t in enumerate(texts))
    assert bpe.encode(docs.limit(0), queries.RANKS, P.PATTERN).count() == 0


def test_packing(spark, docs):
    t = Tokenizer.from_file(queries.PACKED)
    pieces = sorted(packing.pack(docs.repartition(3), queries.PACKED, P.PATTERN, length=64).collect(), key=lambda r: (r.sequence_id, r.offset))
    lengths = {}
    for r in pieces:
        assert r.offset == lengths.get(r.sequence_id, 0) and r.length > 0
        lengths[r.sequence_id] = r.offset + r.length
    assert set(list(lengths.values())[:-1]) == {64} and sorted(lengths) == list(range(len(lengths)))
    by_doc = {}
    for r in sorted(pieces, key=lambda r: r.sequence_id):
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, text in ROWS:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        own = sorted(by_doc[i], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in sorted(by_doc[i], key=lambda r: r.sequence_id))[: 4 * len(ids)] == np.array(ids, "<u4").tobytes()
        assert all(r.doc_tokens == len(ids) for r in own)
    assert packing.pack(docs.limit(0), queries.PACKED, P.PATTERN).count() == 0


def test_added_tokens(spark, monkeypatch):
    t, enc = Tokenizer.from_file(queries.PACKED), packing.encoder(queries.PACKED, P.PATTERN)
    texts = ["<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>\n y", "<|endoftext", "<|endoftext|", "it's 12  o'clock <|END|>", " <|endoftext|>\n\n  <|endoftext|>  z"]
    for x in texts:
        assert enc.encode_to_numpy(x, allowed_special="all").tolist() == t.encode(x, add_special_tokens=False).ids
    monkeypatch.setattr(queries, "documents", lambda *_: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r.doc_id: r.doc_tokens for r in queries.op7_packing(spark, "").collect()}
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in enumerate(texts)}


def plain_hash(gram):
    """The 40 bits of a gram by the definition: a polynomial of mixed code points, mixed again."""
    total = 0
    for c in gram:
        total = (total * int(winnowing.M) + plain_mixed(ord(c) + 1)) % (1 << 64)
    return plain_mixed(total) >> 24


def plain_mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % (1 << 64)
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % (1 << 64)
    return x ^ (x >> 31)


def plain_fingerprint(text, k, w):
    """Positions and hashes by the definition, window after window."""
    h = [plain_hash(text[i : i + k]) for i in range(max(1, len(text) - k + 1))] if text else []
    w, out = min(w, len(h)), {}
    for s in range(len(h) - w + 1 if h else 0):
        best = max(range(s, s + w), key=lambda p: (-h[p], p))
        out[best] = h[best]
    return out


def test_next_document_against_definition(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcd é漢") for _ in range(n)) for n in (0, 1, 7, 8, 9, 23, 24, 60, 200, 333)] + [None, "same text " * 9, "same text " * 9]
    got = {r.doc_id: r for r in winnowing.with_next(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    plain = [t or "" for t in texts]
    like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
    show = lambda fp: " ".join(f"{h:010x}@{p:x}" for p, h in sorted(fp.items()))
    for i, t in enumerate(plain):
        following = plain[(i + 1) % len(plain)]
        new = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        a, b, c = (plain_fingerprint(x, winnowing.K, winnowing.W) for x in (t, new, following))
        want = (len(t), hashlib.sha256(new.encode()).hexdigest(), show(a), show(b), like({*a.values()}, {*b.values()}), like({*a.values()}, {*c.values()}))
        assert tuple(got[i])[1:] == want, i
    assert got[11].fingerprint == got[12].fingerprint and got[11].near_next == 1.0


def plain_winnow(text, k, w):
    h = [winnowing.gram_hashes(text[i : i + k], k)[0] for i in range(max(1, len(text) - k + 1))] if text else []
    w = min(w, len(h))
    return sorted({max(range(s, s + w), key=lambda p: (-int(h[p]), p)) for s in range(len(h) - w + 1)}) if h else []


def test_winnowing_against_plain():
    rng = random.Random(2)
    for n in (0, 1, 3, 7, 8, 20, 100, 300):
        text = "".join(rng.choice("ab") for _ in range(n)) + "c" * (n // 3)
        for k, w in ((1, 4), (5, 7), (8, 16), (3, 1)):
            assert winnowing.fingerprint(text, k, w)[1].tolist() == plain_winnow(text, k, w)


def test_winnowing_guarantee():
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    for _ in range(50):
        shared = text(winnowing.K + winnowing.W - 1)
        a, b = text(200) + shared + text(90), text(31) + shared + text(300)
        assert set(winnowing.fingerprint(a)[0]) & set(winnowing.fingerprint(b)[0])


def test_winnowing_of_short_texts():
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    for n in [*range(46, 254)] * 3:
        a = text(n)
        assert winnowing.likeness(winnowing.fingerprint(a), winnowing.fingerprint(winnowing.edited(a, text(n)))) > 0, n


def test_next_document_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(winnowing, "BLOCK", 50)
    texts = {i: f"text {i} " * (i % 13) for i in range(90)}
    got = winnowing.with_next(spark.createDataFrame(list(texts.items()), "doc_id int, text string").repartition(7)).collect()
    assert {r.doc_id: r.edited_sha256 for r in got} == {i: hashlib.sha256(winnowing.edited(t, texts[(i + 1) % 90]).encode()).hexdigest() for i, t in texts.items()}
    assert all(r.fingerprint == winnowing.as_text(winnowing.fingerprint(texts[r.doc_id])) for r in got) and len(got) == 90


def test_next_document(spark, docs):
    got = sorted(map(tuple, winnowing.with_next(docs.repartition(5)).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "near_next").collect()), key=repr)
    rows = sorted(((i, t or "") for i, t in ROWS), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for (i, t), (_, following) in zip(rows, rows[1:] + rows[:1]):
        fp = winnowing.fingerprint(t)
        new = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), winnowing.as_text(fp), winnowing.likeness(fp, winnowing.fingerprint(following))))
    assert got == sorted(want, key=repr)
    assert winnowing.with_next(docs.limit(0)).count() == 0
    assert winnowing.with_next(docs.where("doc_id = 3")).first().near_next == 1.0


PAGES = [(1, "http://a/", "x" * 1000), (9, "http://b/", "x" * 1000), (4, None, "x" * 999), (5, "u", "x" * 999), (6, "u", None), (None, "u\r\n", "é" * 600), (8, "u", "é" * 600), (-2, "u", "x" * 1000), (9, "http://b/", "x" * 1000)]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id long, url string, html string, payload string")
    want = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        best = max((j for j, _, h in PAGES if h == html and j is not None), default=None) if len(data) >= 1000 else None
        revisit = best is not None and best != i
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", best if revisit else None))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in warc.round_trip(pages).collect())
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_rejects_damage():
    raw = warc.record("response", 1, "u", b"hello", None)
    assert warc.parsed(raw)[:2] == (1, 5)
    revisit = warc.record("revisit", 1, "u", b"hello", 2)
    bad = [raw[:-1], raw.replace(b"hello", b"jello"), raw.replace(b"WARC-Type", b"X"), b"nothing", raw.replace(b"Content-Length: 5", b"Content-Length: x"), raw.replace(b"sha1:", b"md5:")]
    bad += [raw.replace(b"urn:uuid:", b"urn:what:"), raw.replace(b"HTTP/1.1", b"XXXX/1.1"), raw.replace(b"WARC-Date: ", b"WARC-Date "), revisit.replace(b"WARC-Refers-To", b"WARC-Refers"), revisit.replace(b"WARC-Payload-Digest", b"X")]
    for damaged in bad:
        with pytest.raises(ValueError):
            warc.parsed(damaged)
    frame = zstandard.ZstdCompressor().compress(raw * 9000)
    assert warc.frame_end(memoryview(frame), 0) == len(frame)
    assert list(warc.records(frame + frame)) == [raw * 9000] * 2
    for cut in (frame[:-5], frame[:3], frame[:20] + b"\0" * 9 + frame[29:]):
        with pytest.raises(ValueError):
            list(warc.records(cut))


def test_warc_of_others(spark, tmp_path):
    """Names in any case, records of other kinds, none of the digests, hexadecimal ones; errors tell archive and record."""
    lower = warc.record("response", 1, "u", b"hello", None).replace(b"WARC-Type", b"warc-type").replace(b"Content-Length: ", b"content-length:", 1)
    bare = b"\r\n".join(x for x in warc.record("response", 2, "u", b"more", None).split(b"\r\n") if b"Digest" not in x)
    other = [b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:uuid:%032x>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Length: 4\r\n\r\na: b\r\n\r\n" % (k, i) for i, k in enumerate((b"warcinfo", b"request", b"metadata"))]
    digest = hashlib.sha1(b"hello").hexdigest().encode()
    hexed = b"\r\n".join(b"WARC-Payload-Digest: sha1:" + digest if x.startswith(b"WARC-Payload") else x for x in warc.record("revisit", 3, "u", b"hello", 1).split(b"\r\n"))
    coder = zstandard.ZstdCompressor()
    archive = lambda rs: b"".join(map(coder.compress, rs))
    (tmp_path / "a.warc.zst").write_bytes(archive([other[0], lower, other[1], bare, other[2], hexed]))
    got = warc.read(spark, f"file://{tmp_path}")
    assert sorted(map(tuple, got.collect())) == [(1, 5, digest.decode(), "response", None), (2, 4, hashlib.sha1(b"more").hexdigest(), "response", None), (3, 5, digest.decode(), "revisit", 1)]
    assert warc.dangling(got).count() == 0 and warc.dangling(got.where("page_id <> 1")).count() == 1
    (tmp_path / "b.warc.zst").write_bytes(archive([lower, bare.replace(b"more", b"less!")]))
    with pytest.raises(Exception, match="b.warc.zst: record 2: Content-Length"):
        warc.read(spark, f"file://{tmp_path}").collect()


def test_crc_of_pieces(docs):
    from pyspark.sql import functions as F

    for r in packing.pack(docs, queries.PACKED, P.PATTERN).select("ids", F.crc32("ids").alias("c")).collect():
        assert zlib.crc32(bytes(r.ids)) == r.c

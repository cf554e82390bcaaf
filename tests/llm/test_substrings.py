"""Substring dedup against a dictionary of all windows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from maskloom.llm import substrings


def plain(texts, width):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = {}
    for d, w in enumerate(words):
        for i in range(len(w) - width + 1):
            seen.setdefault(tuple(w[i : i + width]), []).append((d, i))
    gone = [set() for _ in texts]
    for at in seen.values():
        if len(at) > 1:
            for d, i in at:
                gone[d].update(range(i, i + width))
    return [(len(w), len(g), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in g).encode()).hexdigest()) for w, g in zip(words, gone)]


def corpus(rng, width):
    pool = [rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(200)]
    free = lambda n: [rng.choice(pool) for _ in range(n)]
    shared = [free(width + rng.randrange(-2, 30)) for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(5)):
            kind = rng.random()
            if kind < 0.4:
                parts += rng.choice(shared)
            elif kind < 0.5:
                parts += [rng.choice("xy")] * rng.randrange(3 * width)
            elif kind < 0.6:
                parts += ["x", "y", "z"][: rng.randrange(1, 4)] * rng.randrange(width)
            else:
                parts += free(rng.randrange(50))
        texts.append("".join(w + rng.choice([" ", "  ", "\n", "\t"]) for w in parts))
    near = free(150)
    for _ in range(12):
        copy = list(near)
        copy[rng.randrange(150)] = "é漢"
        texts.append(" ".join(copy))
    return texts + ["", None, " \n ", "one", " ".join(near), " ".join(near), "a" * 5000, " ".join(near)]


@pytest.mark.parametrize("width, rounds, seed", [(35, 3, 1), (8, 3, 2), (5, 1, 3), (12, 5, 4)])
def test_against_plain(spark, width, rounds, seed):
    texts = corpus(random.Random(seed), width)
    docs = spark.createDataFrame([(i // 2 if i > 60 else i, t, 1, "k") for i, t in enumerate(texts)], "doc_id long, text string, anchor int, row string").repartition(4)
    got = substrings.dedup(docs, width=width, rounds=rounds).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    want = [(i // 2 if i > 60 else i, *x) for i, x in enumerate(plain(texts, width))]
    assert sum(x[2] for x in want) > 100
    assert sorted(want) == sorted(map(tuple, got))


def test_empty(spark):
    assert substrings.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_windows_share_their_anchor():
    rng = random.Random(5)
    for width, rounds in ((35, 3), (10, 2), (60, 6)):
        for _ in range(40):
            word = lambda: rng.choice("abc")
            shared = [word() for _ in range(width)]
            texts = pa.array([" ".join([word() for _ in range(rng.randrange(40))] + shared + [word() for _ in range(rng.randrange(40))]) for _ in range(2)])
            t = substrings.Texts(texts)
            parse = substrings.Parse(t.words, t.barrier, rounds)
            at = [x.split(" ") for x in texts.to_pylist()]
            starts = np.array([next(i for i in range(len(w)) if w[i : i + width] == shared) + t.base[j] for j, w in enumerate(at)])
            has, best = substrings.anchors(parse, starts, width)
            assert has[0] == has[1]
            if has[0]:
                assert parse.name[best[0]] == parse.name[best[1]] and len(set(parse.first[best] - starts)) == 1


def test_long_texts_in_pieces(monkeypatch):
    """A text cut into pieces has the windows and anchors of the whole one, each window once."""
    rng = random.Random(11)
    text = " ".join(rng.choice(["a", "b", "c", "dd" * 40]) for _ in range(3000)) + "  " + "e" * 900 + " tail"
    rows = pa.array([text])
    windows = lambda out: [(int(p), int(a)) for row, anchor, _, first, last, inside in out for f, z, a, i in zip(first, last, anchor, inside) for p in range(f, z + 1)]
    whole = windows(substrings.all_blocks(rows, 12, 3))
    assert len(whole) == len(text.split()) - 11
    for most in (200, 700, 5000):
        assert sorted(windows(substrings.all_blocks(rows, 12, 3, most))) == sorted(whole)


def test_word_hashes_by_stretches(monkeypatch):
    words = ["x" * 50, "y", "é" * 33, "z" * 17, "x" * 50]
    whole = substrings.word_table(pa.array([" ".join(words)]))[0]
    monkeypatch.setattr(substrings, "STRETCH", 16)
    substrings.stretch_powers.cache_clear()
    assert substrings.word_table(pa.array([" ".join(words)]))[0].tolist() == whole.tolist() and whole[0] == whole[4] != whole[1]
    substrings.stretch_powers.cache_clear()


def test_very_long_text(spark):
    """More than two parts in one text, its second half a copy of the first but for a word."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**9)}" for _ in range(500_000)]
    text = " ".join(words + ["between"] + words)
    r = substrings.dedup(spark.createDataFrame([(1, text), (2, "short one")], "doc_id long, text string")).where("doc_id = 1").first()
    assert (r.n_words, r.n_removed, r.text) == (1_000_001, 1_000_000, "between")

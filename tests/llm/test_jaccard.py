"""The Jaccard join against all pairs, and components against a union-find."""

import random
import re

import pytest

from maskloom.llm import graph, jaccard


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def shingles(text, k):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def plain(data, k, num, den):
    found = [shingles(t, k) for _, t in data]
    parent = list(range(len(data)))
    for i, a in enumerate(found):
        for j in range(i):
            both = len(a & found[j])
            if both and den * both >= num * (len(a) + len(found[j]) - both):
                parent[find(parent, i)] = find(parent, j)
    least = {}
    for i, (d, _) in enumerate(data):
        if d is not None:
            r = find(parent, i)
            least[r] = min(least.get(r, d), d)
    return [(d, len(s), d if not s else least.get(find(parent, i))) for i, ((d, _), s) in enumerate(zip(data, found))]


def corpus(rng, n):
    pool = [f"w{i}" for i in range(30)] + ["Éa", "éa", "THE", "the"]
    free = lambda m: [rng.choice(pool) for _ in range(m)]
    common = free(30)
    texts = []
    for _ in range(n):
        texts.append(free(rng.randrange(1, 60)) + (common if rng.random() < 0.3 else []))
    for _ in range(6):  # chains of edits: members far from each other, linked through others
        now = free(rng.randrange(25, 90))
        for _ in range(12):
            texts.append(now)
            now = list(now)
            now[rng.randrange(len(now))] = rng.choice(pool)
    hub = free(100)
    for _ in range(40):
        copy = list(hub)
        for _ in range(rng.randrange(3)):
            copy[rng.randrange(100)] = rng.choice(pool)
        texts.append(copy)
    out = [" ".join(t) for t in texts]
    return out + ["", None, " \t", "one", "one", "ONE", "one two", "two one", out[3], out[3].upper()]


@pytest.mark.parametrize("k, num, den, seed, frequent", [(3, 90, 100, 1, 256), (2, 75, 100, 4, 3), (3, 100, 100, 5, 0)])
def test_against_all_pairs(spark, monkeypatch, k, num, den, seed, frequent):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    rng = random.Random(seed)
    texts = corpus(rng, 60)
    rng.shuffle(texts)
    data = [(i if i % 13 else None, t) for i, t in enumerate(texts)] + [(5, texts[5]), (7, texts[9])]
    docs = spark.createDataFrame([(*d, 1, "x") for d in data], "doc_id long, text string, n long, token string").repartition(3)
    got = jaccard.join(docs, k=k, num=num, den=den).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(repr, plain(data, k, num, den))) == sorted(repr(tuple(r)) for r in got)


def test_one_of_each_and_empty(spark):
    data = [(4, "a b c d e f g"), (2, "A b c d e f g"), (2, "a b c d e f g"), (9, None), (8, ""), (1, "x y z")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = jaccard.one_of_each(docs)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [1, 2, 8, 9]
    assert jaccard.join(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(7, 7), (100, 100)]
    parent = {x: x for e in edges for x in e}
    for a, b in edges:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(parent, x) for a, b in edges for x in (a, b) if a != b}
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == want

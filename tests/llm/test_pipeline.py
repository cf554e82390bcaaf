"""The pipeline's stages against plain versions of their operators, one after the other."""

import random
import re

import numpy as np
import public_tokenizers as P
from test_jaccard import plain as components
from test_native import own_spans, plain_hosts, plain_live, plain_quality, plain_spans
from tokenizers import Tokenizer

import corpus_pipeline
from maskloom.llm import queries
from maskloom.llm.shared import cut

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def corpus():
    rng = random.Random(8)
    free = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(60)) for _ in range(n))
    header = "\n".join(free(4) for _ in range(4))
    texts = [free(rng.randrange(12, 60)) + "\n" + free(14) for _ in range(25)]
    texts += [header + "\n" + free(30) for _ in range(6)]
    texts += [re.sub(r"\S+$", "end", texts[0]), texts[1], texts[1], texts[2] + " token='hunter2hunter2'", free(40) + " AKIA" + "Q7" * 9 + " " + free(5)]
    texts += ["short", None, "### " * 30, "again and again in here " * 9, header, free(20) + " api_key=" + "aB3" * 9]
    return [(i, t, "en", f"s{i % 3}", 0) for i, t in enumerate(texts)]


def test_stages(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long")
    state = {r[0]: (r[1], r[3]) for r in corpus()}
    got = []
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, ""), name)
        got.append(docs)
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    rows = [{r.doc_id: r.text for r in d.collect()} for d in got[:4]]

    judged, hosts = {}, {}
    for i, (text, host) in state.items():
        n, chars, symbols, dup, rep, n_lines = plain_quality(text)
        failed, others = n < 10 or 100 * rep > 20 * n, (chars < 2 * n or chars > 16 * n) + (10 * symbols > n) + (100 * dup > 30 * n_lines)
        judged[i] = failed, others
        hosts.setdefault(host, []).append(failed or others > 0)
    allowed = plain_hosts(hosts)
    state = {i: x for i, x in state.items() if not (judged[i][0] or judged[i][1] > allowed[x[1]])}
    assert rows[0] == {i: x[0] for i, x in state.items()} and len(rows[0]) < len(corpus())

    first, texts = set(), {}
    for i in sorted(state):
        ls, gone = state[i][0].split("\n"), set()
        for j in range(len(ls) - 2):
            key = tuple(ls[j : j + 3])
            if SPACE.sub("", "".join(key)):
                gone |= {j, j + 1, j + 2} if key in first else set()
                first.add(key)
        texts[i] = "\n".join(x for j, x in enumerate(ls) if j not in gone)
    assert rows[1] == texts and any(texts[i] != state[i][0] for i in texts)

    data = sorted(texts.items())
    texts = {i: texts[i] for i, _, c in components(data, 5, 80, 100) if i == c}
    assert rows[2] == texts and len(texts) < len(data)

    alive = plain_live([(i, t, state[i][1]) for i, t in texts.items()])
    for i, t in texts.items():
        spans, merged = sorted((s[0], s[2]) for s in plain_spans(t) + own_spans(t) if s[1] < 3 or s[3:] in alive), []
        for a, b in spans:
            if merged and merged[-1][1] >= a:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        for a, b in reversed(merged):
            t = t[:a] + "[SECRET]" + t[b:]
        texts[i] = t
    assert rows[3] == texts and any("[SECRET]" in t for t in texts.values())

    t, whole = Tokenizer.from_file(queries.PACKED), {}
    for r in sorted(got[4].collect(), key=lambda r: r.start):
        whole.setdefault(r.doc_id, []).extend(np.frombuffer(bytes(r.ids), "<u4").tolist())
    assert whole == {i: [*t.encode(x, add_special_tokens=False).ids, 1] for i, x in texts.items()}


EXTRA = "doc_id long, text string, lang string, source string, n_chars long, `row` string, place int, `whole` string, host int, `text.x` int, id string"


def test_stages_with_other_columns_nulls_and_repeats(spark):
    extra = ("r", 1, "w", 2, 3, "i")
    data = [(i if i % 9 else None, t, "en", s if i % 7 else None, 0, *extra) for i, t, _, s, _ in corpus()]
    docs = spark.createDataFrame(data + data[:3], EXTRA)
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = docs.count()
        docs = cut(stage(spark, docs, "other"), name)
        assert docs.columns == spark.createDataFrame([], EXTRA).columns and 0 < docs.count() <= before
        assert docs.select("row", "place", "whole", "host", "`text.x`", "id").distinct().collect() == [extra]
    pieces = corpus_pipeline.STAGES[4][1](spark, docs, "other")
    assert sum(r.doc_tokens for r in pieces.where("start = 0").select("doc_tokens").collect()) == sum(r.length for r in pieces.select("length").collect())


def test_stages_of_an_empty_table(spark):
    docs = spark.createDataFrame([], EXTRA)
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, "empty"), name)
        assert docs.count() == 0


def test_leftovers_go(spark, tmp_path):
    """After a run nothing is left in the shared folder but the result; a stage's lazy result keeps the tables that it reads."""
    import os

    from maskloom.llm import shared

    spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    folder = shared.new_path(spark, "x").rsplit("/", 1)[0].removeprefix("file://")
    before = set(os.listdir(folder))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert [x.split("-")[1] for x in set(os.listdir(folder)) - before] == ["packing"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:2]:  # not written in between
        docs = stage(spark, docs, "lazy")
    assert docs.count() > 0

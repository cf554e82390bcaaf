"""Files, the audit bundle, and the plan over a stream."""

import json

import pytest
from pyspark.sql import functions as F

from maskloom.__main__ import main
from maskloom.operators import evaluate
from maskloom.plans import timing
from maskloom.plans.redaction import coverage, redact
from maskloom.schema import Config
from maskloom.sources import files, fixtures
from maskloom.streaming import redaction

TEXT = "Call (650) 253-0000\r\nor mail jo@acme.com\n"


def test_files_and_bundle(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.TXT").write_bytes(b"\xef\xbb\xbf" + TEXT.encode())
    df = files.read_file(spark, str(tmp_path / "in" / "a.TXT"))
    assert df.first().text == TEXT
    done = redact(df, Config(secret="k3y")).cache()
    files.write_file(done, str(tmp_path / "out"), ".txt")
    assert (tmp_path / "out" / "a.TXT").read_bytes().decode() == done.first().redacted
    files.write_bundle(done, str(tmp_path / "report"), "k3y")
    assert spark.read.json(str(tmp_path / "report" / "audit")).count() == 2
    with pytest.raises(ValueError):
        files.write_bundle(done, str(tmp_path / "again"), "PHONE")
    with pytest.raises(files.UnsupportedFormat):
        files.read_file(spark, "x.pdf")
    done.unpersist()


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, TEXT.replace("jo@", f"jo{i % 2}@")) for i in range(4)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    cfg = Config(ner=False)
    stream = redaction.stream_redact(spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in")), cfg)
    redaction.write(stream.select("doc_id", "redacted"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.doc_id: r.redacted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = redact(spark.read.parquet(str(tmp_path / "in")), cfg.but(cross_doc_consistency=True))
    assert got == {r.doc_id: r.redacted for r in batch.select("doc_id", "redacted").collect()}
    assert got[0] == got[2] != got[1] and "jo0@acme" not in got[0]


def test_one_name_in_two_folders(spark, tmp_path):
    df = spark.createDataFrame([("a/x.txt", "1"), ("b/x.txt", "2")], "doc_id string, redacted string")
    with pytest.raises(ValueError, match="x.txt"):
        files.write_texts(df, str(tmp_path / "out"))
    files.write_texts(df.limit(1).selectExpr("doc_id", "'a\r\nb\n' as redacted"), str(tmp_path / "out"), newline="\r\n", encoding="utf-16-le")
    assert (tmp_path / "out" / "x.txt").read_bytes().decode("utf-16-le") == "a\r\nb\r\n"


def test_fixtures(spark, tmp_path):
    good = {"doc": "a.txt", "schema_version": 1, "spans": [{"start": 5, "end": 16, "label": "EMAIL", "text": "jo@acme.com"}]}
    bad = {"doc": "b.txt", "schema_version": 1, "spans": [{"start": 0, "end": 99, "label": "EMAIL", "text": "x"}, {"start": 0, "end": 4, "label": "NOPE", "text": "mail"}, {"start": 0, "end": 4, "label": "EMAIL", "text": "post"}, {"end": 4, "label": "EMAIL"}]}
    for name, note in (("a", good), ("b", bad), ("c", dict(good, doc="other.txt"))):
        (tmp_path / f"{name}.txt").write_text("mail jo@acme.com now")
        (tmp_path / f"{name}.spans.json").write_text(json.dumps(note))
    (tmp_path / "alone.txt").write_text("no annotation")
    got = {r.doc_id: r for r in fixtures.read_fixtures(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["a", "b", "c"] and got["a"].errors == [] and got["a"].gold[0].text == "jo@acme.com"
    assert got["b"].errors == ["0: out of bounds", "1: unknown label", "2: another text", "3: no offsets"] and got["c"].errors == ["annotation of other.txt"]
    assert {r.label: r.tp for r in evaluate.prf(evaluate.evaluated(fixtures.read_fixtures(spark, str(tmp_path)).where("doc_id = 'a'"), Config(detectors=("email",)))).collect()} == {"EMAIL": 1, None: 1}


def test_timings(spark):
    steps = timing.profile(spark.createDataFrame([(1, TEXT)], "doc_id long, text string"), Config(secret="k", detectors=("email",)))
    assert [n for n, _ in steps] == [*timing.STAGES, "total"] and all(s >= 0 for _, s in steps)
    assert sum(s for _, s in steps[:-1]) <= steps[-1][1] + 0.005


def test_coverage(spark):
    done = redact(spark.createDataFrame([(1, TEXT), (2, "nothing")], "doc_id long, text string"), Config(secret="k"))
    rows = {r.doc_id: tuple(r)[1:] for r in coverage(done, Config(secret="k")).collect()}
    assert rows == {1: (2, 0, 2, 2, True), 2: (0, 0, 0, 0, False)}


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    """Exit codes: 0 done, 3 can't read, 4 wrong configuration, 5 the run failed, 6 residuals remain."""
    source, conf = tmp_path / "in.txt", tmp_path / "c.yml"
    source.write_text(TEXT)
    conf.write_text("ner: false\ndetectors: [email, phone]\n")
    run = lambda *more, to="out", path=source: main([str(path), str(tmp_path / to / "x.txt") if to is None else str(tmp_path / to), "--config", str(conf), *more])
    monkeypatch.setenv("MASKLOOM_SECRET", "k3y")
    assert run("--strict", "--require-secret", "--report", str(tmp_path / "report"), "--verbose", "--newline", "lf") == 0
    new = (tmp_path / "out" / "in.txt").read_text()
    assert "jo@acme" not in new and "253-0000" not in new and "\r" not in new and "total:" in capsys.readouterr().err
    assert spark.read.json(str(tmp_path / "report" / "documents")).first().seed_present
    assert run(path=tmp_path / "absent.txt") == 3 and run(path=tmp_path / "x.pdf") == 3
    monkeypatch.delenv("MASKLOOM_SECRET")
    assert run("--require-secret") == 4 and main([str(source), "x", "--config", str(tmp_path / "absent.yml")]) == 4
    monkeypatch.setattr("maskloom.sources.files.write_file", lambda *a, **k: (_ for _ in ()).throw(OSError("disk full")))
    assert run() == 5
    monkeypatch.undo()
    leaky = tmp_path / "leak.yml"
    leaky.write_text("ner: false\ndetectors: [email]\n")
    monkeypatch.setattr("maskloom.operators.plan.candidate", lambda s, seed, cfg: s["text"].substr(1, 1))
    monkeypatch.setattr("maskloom.operators.plan.p.unsafe", lambda s, x: F.lit(None).cast("string"))
    monkeypatch.setattr("maskloom.operators.plan.applied", lambda text, plan: text)
    monkeypatch.setattr("maskloom.plans.redaction.applied", lambda text, plan: text)
    assert main([str(source), str(tmp_path / "out6"), "--config", str(leaky), "--strict"]) == 6
    assert main([str(source), str(tmp_path / "out7"), "--config", str(leaky), "--no-strict"]) == 0


def test_leakage_over_time(spark):
    rows = [("2024-01-01 00:01:00", (1, 3.0)), ("2024-01-01 00:09:00", (0, 0.0)), ("2024-01-01 00:11:00", (2, 5.0))]
    df = spark.createDataFrame(rows, "at string, report struct<residual_count:int,score:double>").withColumn("at", F.to_timestamp("at"))
    got = redaction.leakage_over_time(df, "at").orderBy("window").collect()
    assert [(str(r.window.start), r.documents, r.residuals, r.score) for r in got] == [("2024-01-01 00:00:00", 2, 1, 3.0), ("2024-01-01 00:10:00", 1, 2, 5.0)]

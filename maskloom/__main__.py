"""python -m maskloom IN OUT [options]: redacts a file or folder.

Exit codes: 0 done, 3 can't read, 4 wrong configuration, 5 the run failed, 6 residuals remain (with --strict).
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans.redaction import redact
from .plans.timing import profile
from .schema import load
from .sources import files


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="maskloom", description=__doc__)
    p.add_argument("source")
    p.add_argument("target")
    p.add_argument("--config")
    p.add_argument("--report", help="folder for the audit bundle")
    p.add_argument("--strict", action=argparse.BooleanOptionalAction, default=None)
    p.add_argument("--keep-roles", action="store_true")
    p.add_argument("--ner", action=argparse.BooleanOptionalAction, default=None)
    p.add_argument("--coref", action=argparse.BooleanOptionalAction, default=None)
    p.add_argument("--require-secret", action="store_true")
    p.add_argument("--encoding", default="UTF-8", help="of the texts read")
    p.add_argument("--encoding-out", default="UTF-8", help="of the texts written")
    p.add_argument("--newline", choices=("keep", "lf", "crlf"), default="keep", help="line ends of the texts written")
    p.add_argument("--coref-backend", choices=("auto", "regex"), default="auto", help="auto is regex here: a model is given to redact() as a function")
    p.add_argument("--verbose", action="store_true", help="the time of each step, to the standard error")
    a = p.parse_args(argv)
    try:
        over = {k: v for k, v in (("alias_labels", "keep_roles" if a.keep_roles else None), ("ner", a.ner), ("coref", a.coref), ("fail_on_residual", a.strict)) if v is not None}
        cfg = load(a.config, overrides=over)
        if a.require_secret and not cfg.secret:
            raise ValueError(f"no secret in {cfg.secret_env}")
    except (OSError, ValueError, TypeError) as e:
        print(f"configuration: {e}", file=sys.stderr)
        return 4
    spark = SparkSession.builder.appName("maskloom").getOrCreate()
    try:
        docs = files.read_file(spark, a.source, **({"encoding": a.encoding} if files.extension(a.source) == ".txt" else {}))
        docs.head(1)
    except Exception as e:
        print(f"reading: {e}", file=sys.stderr)
        return 3
    try:
        done = redact(docs, cfg).persist()
        kind = files.extension(a.source)
        texts = {"encoding": a.encoding_out, "newline": {"lf": "\n", "crlf": "\r\n"}.get(a.newline)} if kind == ".txt" else {}
        files.write_file(done if kind == ".txt" else done.select("doc_id", F.col("redacted").alias("text")), a.target, kind, **texts)
        if a.report:
            files.write_bundle(done, a.report, cfg.secret)
        left = done.agg(F.coalesce(F.sum("report.residual_count"), F.lit(0))).first()[0]
    except Exception as e:
        print(f"run: {e}", file=sys.stderr)
        return 5
    if a.verbose:
        for name, seconds in profile(docs, cfg):
            print(f"{name}: {seconds:.2f} s", file=sys.stderr)
    return 6 if cfg.fail_on_residual and left else 0


if __name__ == "__main__":
    sys.exit(main())

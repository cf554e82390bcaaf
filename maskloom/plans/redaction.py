"""The whole run as one chain of projections: it works on batches and streams alike, and exchanges nothing between tasks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import Scope
from ..functions.text import normalized, quick_building, step
from ..operators import link, verify
from ..operators.compose import composed
from ..operators.detect import detect
from ..operators.plan import applied, planned
from ..schema import Config


#: From the normalised text to a model's clusters of mentions: array<array<struct<start:int,end:int>>>, a pandas UDF for instance.
Coref = Callable[[Column], Column]


def spans_of(df: DataFrame, cfg: Config, text_col: str = "norm", coref: Coref | None = None) -> DataFrame:
    """Adds scope and spans: found, blocked, guarded, linked and merged. coref: a model in place of the rule for last names."""
    text, found, scope = F.col(text_col), F.col("found"), F.col("scope")
    out = step(df, "scope", Scope(cfg.secret, cfg.cross_doc_consistency).of(F.coalesce(text, F.lit(""))))
    steps = [detect(text_col, cfg), link.address_blocks(text, found), link.guarded(text, found, cfg), link.identified(found, scope, cfg.secret), link.aliases_resolved(text, found, scope, cfg)]
    if coref:
        out = step(out, "maskloom_groups", coref(text))
        steps.append(link.model_joined(text, found, F.col("maskloom_groups"), scope, cfg.secret))
    elif cfg.coref:
        steps.append(link.surnames_joined(found))
    for value in steps:
        out = step(out, "found", value)
    out = out.drop("maskloom_groups")
    return step(out, "spans", link.merged(found, cfg)).drop("found")


def redact(df: DataFrame, cfg: Config | None = None, text_col: str = "text", check: bool = True, coref: Coref | None = None) -> DataFrame:
    """Adds norm, spans, plan and redacted and, with check, findings and report, to the columns of df.

    A null text counts as empty. Columns of these names in df are replaced. A filter on df's own columns, before or after, reaches
    the scan. What is added is made for every row that is left, whether it is selected or not: without need for findings and
    report, leave the check out.
    """
    cfg = cfg or Config()
    with quick_building():
        return redacted(df, cfg, text_col, check, coref)


def redacted(df: DataFrame, cfg: Config, text_col: str, check: bool, coref: Coref | None = None) -> DataFrame:
    out = step(df, "norm", normalized(composed(F.coalesce(F.col(text_col), F.lit("")))))
    out = spans_of(out, cfg, coref=coref)
    out = step(out, "plan", planned(F.col("spans"), F.col("scope"), cfg)).drop("scope")
    out = step(out, "redacted", applied(F.col("norm"), F.col("plan")))
    return verify.scan(out, "redacted", "plan", cfg) if check else out


def coverage(df: DataFrame, cfg: Config | None = None, id_col: str = "doc_id") -> DataFrame:
    """Of what redact() gives, with check: found_before, residual_count, covered, plan_size and changed, a row per document."""
    cfg = cfg or Config()
    out = step(df, "maskloom_before", F.size(F.filter(detect("norm", cfg), lambda s: s["confidence"] >= cfg.min_confidence)))
    before, left = F.col("maskloom_before"), F.col("report.residual_count")
    covered, changed = F.greatest(before - left, F.lit(0)), F.col("norm") != F.col("redacted")
    return out.select(id_col, before.alias("found_before"), left.alias("residual_count"), covered.alias("covered"), F.size("plan").alias("plan_size"), changed.alias("changed"))

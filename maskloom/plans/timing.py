"""How long each step of a run takes: the plan is run up to each step in turn, and a step's time is the difference to the one before."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import Scope
from ..functions.text import normalized, quick_building, step
from ..operators import link, verify
from ..operators.compose import composed
from ..operators.detect import detect
from ..operators.plan import applied, planned
from ..schema import Config

STAGES = ("normalize", "detect", "address_merge", "alias_resolve", "coref", "merge_spans", "plan_build", "apply", "verify")


def prefixes(df: DataFrame, cfg: Config, text_col: str = "text") -> dict[str, DataFrame]:
    """The run up to and with each step."""
    text, found, scope = F.col("norm"), F.col("found"), F.col("scope")
    out = {"normalize": step(df, "norm", normalized(composed(F.coalesce(F.col(text_col), F.lit("")))))}
    out["detect"] = step(out["normalize"], "found", detect("norm", cfg))
    out["address_merge"] = step(step(out["detect"], "found", link.address_blocks(text, found)), "found", link.guarded(text, found, cfg))
    scoped = step(out["address_merge"], "scope", Scope(cfg.secret, cfg.cross_doc_consistency).of(text))
    out["alias_resolve"] = step(step(scoped, "found", link.identified(found, scope, cfg.secret)), "found", link.aliases_resolved(text, found, scope, cfg))
    out["coref"] = step(out["alias_resolve"], "found", link.surnames_joined(found)) if cfg.coref else out["alias_resolve"]
    out["merge_spans"] = step(out["coref"], "spans", link.merged(found, cfg))
    out["plan_build"] = step(out["merge_spans"], "plan", planned(F.col("spans"), scope, cfg))
    out["apply"] = step(out["plan_build"], "redacted", applied(text, F.col("plan")))
    out["verify"] = verify.scan(out["apply"], "redacted", "plan", cfg)
    return out


def profile(df: DataFrame, cfg: Config | None = None, text_col: str = "text", repeat: int = 1) -> list[tuple[str, float]]:
    """(step, seconds) of each of STAGES and of total, the least of some runs. Nothing is written; each prefix is one job."""
    with quick_building():
        plans = prefixes(df, cfg or Config(), text_col)
    out, before = [], 0.0
    for name in STAGES:
        runs = []
        for _ in range(max(repeat, 1)):
            began = time.perf_counter()
            plans[name].write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        out.append((name, max(min(runs) - before, 0.0)))
        before = max(min(runs), before)
    return [*out, ("total", before)]

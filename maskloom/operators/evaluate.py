"""Evaluation: spans against gold spans, and seeded variants of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import empty, let, step
from ..schema import Config
from .detect import detect


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two spans."""
    both = F.greatest(F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]), F.lit(0))
    return both / (a["end"] - a["start"] + b["end"] - b["start"] - both)


def greedy_matches(gold: Column, found: Column, threshold: float = 0.5) -> Column:
    """One-to-one matches of two arrays of spans: pairs of IoU at or above the threshold, the best first. g, p: places from 0."""
    # of equal ones the last gold span and then the last found one comes first
    pair = lambda g, i, p, j: let(iou(g, p), lambda v: F.struct((-v).alias("k"), (-i).alias("ng"), (-j).alias("np"), i.alias("g"), j.alias("p")))
    every = F.flatten(F.transform(gold, lambda g, i: F.transform(found, lambda p, j: pair(g, i, p, j))))
    ranked = F.array_sort(F.filter(every, lambda x: x["k"] <= -threshold))
    kind = "array<struct<k:double,ng:int,np:int,g:int,p:int>>"
    choose = lambda kept, c: F.when(F.exists(kept, lambda k: (k["g"] == c["g"]) | (k["p"] == c["p"])), kept).otherwise(F.array_append(kept, c))
    return F.aggregate(ranked.cast(kind), empty(kind), choose)


def outcomes(df: DataFrame, id_col: str = "doc_id", gold_col: str = "gold", found_col: str = "found", threshold: float = 0.5) -> DataFrame:
    """A row per match, missed gold span and unmatched found span: gold and found labels, null where there is none."""
    m = df.select(id_col, F.col(gold_col).alias("gold"), F.col(found_col).alias("found")).withColumn("m", greedy_matches(F.col("gold"), F.col("found"), threshold))
    label = lambda x: x["label"]
    hits = F.transform("m", lambda x: F.struct(F.get("gold", x["g"])["label"].alias("gold"), F.get("found", x["p"])["label"].alias("found")))
    missed = F.filter(F.transform("gold", lambda g, i: F.when(~F.exists("m", lambda x: x["g"] == i), F.struct(label(g).alias("gold"), F.lit(None).cast("string").alias("found")))), lambda x: x.isNotNull())
    extra = F.filter(F.transform("found", lambda p, j: F.when(~F.exists("m", lambda x: x["p"] == j), F.struct(F.lit(None).cast("string").alias("gold"), label(p).alias("found")))), lambda x: x.isNotNull())
    return m.select(id_col, F.inline(F.concat(hits, missed, extra)))


def prf(rows: DataFrame) -> DataFrame:
    """label (null: all), tp, fp, fn, precision, recall, f1. A match of other labels is a miss of one and a wrong find of the other."""
    right = F.coalesce(F.col("gold") == F.col("found"), F.lit(False))
    each = rows.select(F.explode(F.filter(F.array(
        F.when(right, F.struct(F.col("gold").alias("label"), F.lit("tp").alias("kind"))),
        F.when(~right & F.col("gold").isNotNull(), F.struct(F.col("gold").alias("label"), F.lit("fn").alias("kind"))),
        F.when(~right & F.col("found").isNotNull(), F.struct(F.col("found").alias("label"), F.lit("fp").alias("kind")))), lambda x: x.isNotNull())).alias("x")).select("x.*")
    counts = each.rollup("label").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("tp", "fp", "fn")))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn)).withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn))


def summary(prf_rows: DataFrame) -> DataFrame:
    """average (macro: the mean over labels; micro: over all spans), precision, recall, f1, of what prf() gives."""
    ratios = ["precision", "recall", "f1"]
    macro = prf_rows.where("label is not null").agg(*(F.avg(c).alias(c) for c in ratios)).select(F.lit("macro").alias("average"), *ratios)
    return macro.unionByName(prf_rows.where("label is null").select(F.lit("micro").alias("average"), *ratios))


def label_of(label: Column, subtype: Column, fine: bool = False) -> Column:
    """The label that counts: with its kind for account numbers, if labels are to be fine."""
    return F.when(F.lit(fine) & (label == "ACCOUNT_ID") & subtype.isNotNull(), F.concat_ws(":", label, subtype)).otherwise(label)


def evaluated(df: DataFrame, cfg: Config | None = None, fine: bool = False, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", gold_col: str = "gold") -> DataFrame:
    """Outcomes (see outcomes) of the detectors' spans against gold spans (start, end, label, subtype) of each text.

    What the detectors find counts as it is, unmerged; of address spans, those of single lines.
    """
    cfg = cfg or Config()
    named = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), label_of(s["label"], s["subtype"], fine).alias("label"))
    base = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.transform(gold_col, named).alias("gold"))
    found = F.filter(detect("text", cfg), lambda s: (s["label"] != "ADDRESS_BLOCK") | (s["source"] == "address_line"))
    return outcomes(step(base, "found", F.transform(found, named)), "doc_id", threshold=threshold)


def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("gold", F.lit("<none>")).alias("gold_label"), F.coalesce("found", F.lit("<none>")).alias("found_label")).agg(F.count("*").alias("n"))


#: What a variant may change, each by the toss of a coin: a pattern and what stands for its matches.
CHANGES = [
    (r"(?i)\bhereinafter(?: referred to as)?\b", ["hereinafter", "Hereafter", "hereinafter referred to as"]),
    (r"\bDOB:", ["D.O.B.:", "Date of Birth:", "Birthdate:"]),
    (r'"([^"\n]*)"', ["\u201c$1\u201d"]),
    (r"([a-z]{3}) ([a-z])", ["$1\u00a0$2", "$1\n$2"]),
    (r"([aeiou])([b-df-h])", ["$1\u200b$2"]),
    (r"([a-z]{4})([b-d][a-z]{2})", ["$1-\n$2"]),
    (r"\r?\n", ["\n", "\r\n"]),
]


def variants(df: DataFrame, n: int, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n variants of each text: doc_id, variant, text. The same seed gives the same variants wherever a row is.

    Coins and choices are drawn from a digest of seed, id and variant; a change that is made is made throughout the text.
    """
    base = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    many = base.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("variant")).where("variant is not null")
    many = many.withColumn("key", F.sha2(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "variant"), 256))
    out = F.col("text")
    for k, (rx, choices) in enumerate(CHANGES):
        word = lambda i: F.conv(F.substring("key", 4 * k + 1 + 2 * i, 2), 16, 10).cast("int")
        changed = F.coalesce(*(F.when(word(1) % len(choices) == j, F.regexp_replace(out, rx, c)) for j, c in enumerate(choices)))
        out = F.when(word(0) % 2 == 0, changed).otherwise(out)
    return many.select("doc_id", "variant", out.alias("text"))

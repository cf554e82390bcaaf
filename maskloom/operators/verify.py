"""Verification and audit: what is still found in the new text, what of it is ours, and a record of what was replaced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ANY_EOL, empty, folded, let, one_of, record, step
from ..schema import FINDINGS, PLAN, SPANS, WEIGHTS, Config
from .detect import ROLES, by_start, detect, piece, span
from .plan import new_starts
from .pseudonyms import SAFE_DOMAINS, SAFE_NUMBER

SAFE_PHONE = r"^\+?1555\d{7}$|^1?\d{3}555\d{4,}$"


def findings(found: Column, plan: Column, cfg: Config) -> Column:
    """Findings by start, each with the reason why it is ignored, or null.

    A finding equal to a replacement of its label is ignored as often as the plan has that replacement (a difference of bags). One
    that lies within a replaced place is part of our own text; one that only meets such a place is not, for what is left of a
    name that was replaced in part joins the pseudonym there. Both are scans over findings and entries sorted together.
    """
    flag = "struct<i:int,yes:boolean>"
    picked = lambda outs: F.transform(F.array_sort(F.filter(outs, lambda x: x.isNotNull())), lambda x: x["yes"])
    said = lambda f, yes: F.when(f["i"] >= 0, F.struct(f["i"].alias("i"), F.coalesce(yes, F.lit(False)).alias("yes"))).cast(flag)

    def ours(fs: Column, e: Column) -> Column:
        """For each finding whether an entry's replacement is left for it: entries of a text come before its findings."""
        entry = F.transform(e, lambda x: F.struct(x["label"].alias("label"), x["replacement"].alias("text"), F.lit(-1).alias("i")))
        finding = F.transform(fs, lambda f, i: F.struct(f["label"].alias("label"), f["text"].alias("text"), i.alias("i")))
        state = "struct<label:string,text:string,left:int>"

        def step(acc: Column, x: Column) -> Column:
            same = F.coalesce((acc["label"] == x["label"]) & (acc["text"] == x["text"]), F.lit(False))
            left = F.when(same, acc["left"]).otherwise(0)
            now = F.when(x["i"] < 0, left + 1).otherwise(F.greatest(left - 1, F.lit(0)))
            return F.struct(F.struct(x["label"].alias("label"), x["text"].alias("text"), now.alias("left")).cast(state).alias("state"), said(x, left > 0).alias("out"))

        return picked(folded(F.array_sort(F.concat(entry, finding)), F.lit(None).cast(state), step, flag))

    def inside(fs: Column, places: Column) -> Column:
        """For each finding whether a place holds it: places don't overlap, so only the last that begins before it can."""
        place = F.transform(places, lambda p: F.struct(p["start"].alias("start"), F.lit(-1).alias("i"), p["end"].alias("end")))
        finding = F.transform(fs, lambda f, i: F.struct(f["start"].alias("start"), i.alias("i"), f["end"].alias("end")))
        step = lambda end, x: F.struct(F.when(x["i"] < 0, x["end"]).otherwise(end).alias("state"), said(x, x["end"] <= end).alias("out"))
        return picked(folded(F.array_sort(F.concat(place, finding)), F.lit(0), step, flag))

    def of(fs: Column, e: Column, same: Column, within: Column) -> Column:
        lines = F.flatten(F.transform(F.filter(e, lambda x: x["label"] == "ADDRESS_BLOCK"), lambda x: F.filter(F.transform(F.split(x["replacement"], ANY_EOL, -1), F.rtrim), lambda t: t != "")))

        def reason(f: Column, i: Column, block_lines: Column) -> Column:
            number = F.regexp_replace(f["text"], "[^0-9+]", "")
            rules = [
                ("replacement_match", F.get(same, i)),
                ("replacement_match_block_line", (f["label"] == "ADDRESS_BLOCK") & F.array_contains(block_lines, F.rtrim(f["text"]))),
                ("in_replacement", F.get(within, i)),
                ("safe_domain", (f["label"] == "EMAIL") & F.lower(F.element_at(F.split(f["text"], "@"), -1)).isin(SAFE_DOMAINS)),
                ("safe_number", (f["label"] == "PHONE") & number.rlike(SAFE_PHONE)),
                ("token_account", (f["label"] == "ACCOUNT_ID") & f["text"].startswith("ACCT_")),
                ("policy_keep_roles", F.lit(cfg.alias_labels == "keep_roles") & (f["label"] == "ALIAS_LABEL") & one_of(f["text"], ROLES)),
                ("policy_preserve_date", F.lit(not cfg.generic_dates) & (f["label"] == "DATE_GENERIC")),
            ]
            return F.coalesce(*(F.when(c, n) for n, c in rules))

        columns = ("start", "end", "text", "label", "confidence")
        return let(lines, lambda ls: F.transform(fs, lambda f, i: F.struct(*(f[c].alias(c) for c in columns), reason(f, i, ls).alias("ignored"))))

    kept = by_start(F.filter(found, lambda s: s["confidence"] >= cfg.min_confidence))
    place = lambda at, e: F.transform(e, lambda x, i: F.struct(F.get(at, i).alias("start"), (F.get(at, i) + F.length(x["replacement"])).alias("end"), x["skip"].alias("skip")))
    places = lambda e: F.filter(let(new_starts(e), lambda at: place(at, e)), lambda p: ~p["skip"])
    entries = lambda e: F.filter(e, lambda x: ~x["skip"])
    flags = lambda fs, e, ps: let(ours(fs, e), lambda a: let(inside(fs, ps), lambda b: of(fs, e, a, b)))
    run = let(kept, lambda fs: let(F.array_sort(plan), lambda e: let(places(e), lambda ps: let(entries(e), lambda es: flags(fs, es, ps)))))
    return F.coalesce(F.when(F.size(found) > 0, run), empty(FINDINGS)).cast(FINDINGS)


def report(found: Column, cfg: Config) -> Column:
    """total_found, total_ignored, residual_count, score, counts_by_label (residuals), ignored_by_label."""
    weights = dict(WEIGHTS) | ({"DATE_GENERIC": 1} if cfg.generic_dates else {})
    weight = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))

    def counts(fs: Column) -> Column:
        labels = F.transform(fs, lambda f: f["label"])
        return let(labels, lambda ls: F.map_from_entries(F.transform(F.array_sort(F.array_distinct(ls)), lambda x: F.struct(x, F.size(F.filter(ls, lambda y: y == x))))))

    def of(left: Column, gone: Column) -> Column:
        score = F.aggregate(left, F.lit(0), lambda s, f: s + F.coalesce(F.element_at(weight, f["label"]), F.lit(0)))
        numbers = {"total_found": F.size(found), "total_ignored": F.size(gone), "residual_count": F.size(left), "score": score.cast("double")}
        return record(**numbers, counts_by_label=counts(left), ignored_by_label=counts(gone))

    return let(F.filter(found, lambda f: f["ignored"].isNull()), lambda left: let(F.filter(found, lambda f: f["ignored"].isNotNull()), lambda gone: of(left, gone)))


def numbers_found(text: Column, found: Column, plan: Column) -> Column:
    """Adds the phone numbers that stand where the plan put them and that the detector passes over: those of area 555 that no
    exchange follows (+1 (555) 062-3753), and those next to a digit of another pseudonym. One scan over phones and places."""

    def of(e: Column, at: Column) -> Column:
        phone = lambda s: F.struct(s["start"].alias("at"), F.lit(-1).alias("i"), s["end"].alias("bound"))
        ours = lambda x: (x["label"] == "PHONE") & ~x["skip"] & F.regexp_replace(x["replacement"], "[^0-9]", "").rlike(SAFE_NUMBER)
        place = lambda x, i: F.when(ours(x), F.struct((F.get(at, i) + F.length(x["replacement"]) - 1).alias("at"), i.alias("i"), F.get(at, i).alias("bound")))
        events = F.concat(F.transform(F.filter(found, lambda s: s["label"] == "PHONE"), phone), F.filter(F.transform(e, place), lambda x: x.isNotNull()))
        # a place comes after all phones that begin before its end, and is free if none of them ends beyond its start
        step = lambda end, x: F.struct(F.when(x["i"] < 0, F.greatest(end, x["bound"])).otherwise(end).alias("state"), F.when((x["i"] >= 0) & (end <= x["bound"]), x["i"]).alias("out"))
        free = F.filter(folded(F.array_sort(events), F.lit(0), step, "int"), lambda i: i.isNotNull())
        stands = lambda m: F.substr(text, m["start"] + 1, m["end"] - m["start"]) == m["text"]
        missed = F.filter(F.transform(free, lambda i: piece(F.get(at, i), F.get(e, i)["replacement"])), stands)
        return F.concat(found, F.transform(missed, lambda m: span(m, "PHONE", "phone", 0.99)).cast(SPANS))

    full = let(F.array_sort(plan), lambda e: let(new_starts(e), lambda at: of(e, at)))
    return F.when(F.exists(plan, lambda x: x["label"] == "PHONE"), full).otherwise(found)


def scan(df: DataFrame, text_col: str, plan_col: str | None, cfg: Config) -> DataFrame:
    """Adds findings and report: the detectors over a text once more, without merging. Without a plan nothing is ours."""
    plan = F.col(plan_col) if plan_col else F.array()
    out = step(df, "found", detect(text_col, cfg))
    if plan_col and (not cfg.detectors or "phone" in cfg.detectors):
        out = step(out, "found", numbers_found(F.col(text_col), F.col("found"), plan.cast(PLAN)))
    out = step(out, "findings", findings(F.col("found"), plan.cast(PLAN), cfg)).drop("found")
    return out.withColumn("report", report(F.col("findings"), cfg))


def audit_entries(df: DataFrame, id_col: str = "doc_id", plan_col: str = "plan") -> DataFrame:
    """A row per entry of each plan: id (r0001 ...), offsets before and after, texts, flags, difference in length."""
    at = df.select(id_col, F.posexplode(let(F.array_sort(plan_col), lambda e: let(new_starts(e), lambda n: F.transform(e, lambda x, i: F.struct(x.alias("e"), F.get(n, i).alias("at")))))).alias("i", "x"))
    entry = F.col("x.e")
    renamed = {"original": "original_text", "replacement": "replacement_text", "skip": "skip_replacement", "retries": "safety_retries", "reason": "unsafe_rejected"}
    return at.select(
        id_col,
        F.format_string("r%04d", F.col("i") + 1).alias("id"),
        *(entry[c].alias(c) for c in ("start", "end")),
        F.col("x.at").alias("new_start"),
        *(entry[c].alias(c) for c in ("label", "source", "subtype", "entity_id")),
        *(entry[c].alias(name) for c, name in renamed.items()),
        (F.length(entry["replacement"]) - entry["end"] + entry["start"]).alias("length_delta"),
    )


def audit_summary(entries: DataFrame, *by: str) -> DataFrame:
    """Counts by label and in all (label null): entries, differences in length, kept ones, draws that were rejected for safety and
    entries with such. by: columns to keep apart. No entries, no row."""
    groups = entries.groupingSets([[*by, "label"], [*by]], *by, "label")
    return groups.agg(
        F.count("*").alias("entries"),
        F.sum("length_delta").alias("length_delta"),
        F.count_if("skip_replacement").alias("kept"),
        F.sum("safety_retries").alias("safety_retries"),
        F.count_if(F.col("safety_retries") > 0).alias("retried"),
    )


def document_audit(df: DataFrame, secret: str | None, id_col: str = "doc_id") -> DataFrame:
    """A row per document: the hash of its normalised text, whether a secret was used, and its numbers of entries and residuals."""
    left = [F.col(f"report.{c}").alias(c) for c in ("residual_count", "score")]
    return df.select(id_col, F.sha2("norm", 256).alias("doc_hash"), F.lit(bool(secret)).alias("seed_present"), F.size("plan").alias("entries"), *left)


def leaking(df: DataFrame, secret: str | None, columns: list[str]) -> DataFrame:
    """Rows in which the secret stands; a bundle is written only if there are none."""
    return df.where(F.contains(F.to_json(F.struct(*columns)), F.lit(secret))) if secret else df.limit(0)


def html_diff(text: Column, new: Column, plan: Column) -> Column:
    """Both texts side by side, what was replaced marked with its label."""

    def escaped(s: Column) -> Column:
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
            s = F.replace(s, F.lit(a), F.lit(b))
        return s

    def marked(t: Column, spans: Column) -> Column:
        begin = lambda i: F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))
        gap = lambda s, i: escaped(F.substr(t, begin(i) + 1, s["start"] - begin(i)))
        inside = lambda s: escaped(F.substr(t, s["start"] + 1, s["end"] - s["start"]))
        parts = F.transform(spans, lambda s, i: F.concat(gap(s, i), F.lit('<mark title="'), s["label"], F.lit('">'), inside(s), F.lit("</mark>")))
        return F.concat(F.array_join(parts, ""), escaped(F.substr(t, F.coalesce(F.try_element_at(spans, F.lit(-1))["end"], F.lit(0)) + 1)))

    old = F.transform(F.array_sort(plan), lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["label"].alias("label")))
    now = let(F.array_sort(plan), lambda e: let(new_starts(e), lambda at: F.transform(e, lambda x, i: F.struct(F.get(at, i).alias("start"), (F.get(at, i) + F.length(x["replacement"])).alias("end"), x["label"].alias("label")))))
    side = lambda t, s: F.concat(F.lit("<td><pre>"), let(s, lambda v: marked(t, v)), F.lit("</pre></td>"))
    return F.concat(F.lit("<!DOCTYPE html><html><body><table><tr>"), side(text, old), side(new, now), F.lit("</tr></table></body></html>"))

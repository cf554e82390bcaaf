"""The replacement plan and its application."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.text import empty, in_blocks, let, overlaps, record, sums_before
from ..schema import PLAN, Config
from . import pseudonyms as p

#: What is added to a seed for each draw after another was rejected.
SALTS = ("", ":1", ":2")


def key_of(s: Column) -> Column:
    """What a span's pseudonym hangs on: its entity, else its normal form, else its text."""
    local = F.lower(s["attrs"]["base_local"])
    return F.when(s["label"] == "EMAIL", local).when(s["label"].isin("DOB", "DATE_GENERIC", "ACCOUNT_ID"), F.coalesce(s["attrs"]["normalized"], s["text"])).otherwise(F.coalesce(s["entity_id"], s["text"]))


def candidate(s: Column, seed: Column, cfg: Config) -> Column:
    """What a span is to be replaced with, drawn from the seed; null if it stays."""
    label, kind, text, attrs = s["label"], s["subtype"], s["text"], s["attrs"]
    numbers = {"cc": p.card(text, attrs, seed), "routing_aba": p.routing(text, seed), "iban": p.iban(text, attrs, seed), "swift_bic": p.bic(text, seed), "ssn": p.ssn(text, seed), "ein": p.ein(text, seed)}
    account = p.digits(text, seed)
    for name, value in numbers.items():
        account = F.when(kind == name, value).otherwise(account)
    role = text if cfg.alias_labels == "keep_roles" else F.concat(F.lit("Party "), F.chr(keys.draw(seed, 0, 26) + 65))
    rules = {
        "PERSON": p.person(text, seed), "ADDRESS_BLOCK": p.address(text, seed), "EMAIL": p.email(attrs, seed), "PHONE": p.phone(text, seed),
        "ACCOUNT_ID": account, "DOB": p.date(text, seed), "ALIAS_LABEL": F.when(kind == "role", role).otherwise(p.pick(p.GIVEN, seed, 0)),
    } | ({"DATE_GENERIC": p.date(text, seed)} if cfg.generic_dates else {})
    out = F.when(label.isin("ORG", "BANK_ORG"), p.organisation(text, seed))
    for name, value in rules.items():
        out = out.when(label == name, value)
    return out


def safe(s: Column, seed: Column, cfg: Config) -> Column:
    """value, retries and reason: the first of SALTS draws that no rule of safety rejects, how many were rejected, and the rule
    that rejected the last of them. If all were, a placeholder takes the span's place."""
    kind = "struct<value:string,retries:int,reason:string,done:boolean>"
    kept_role = (s["label"] == "ALIAS_LABEL") & (s["subtype"] == "role") & F.lit(cfg.alias_labels == "keep_roles")

    def step(acc: Column, salt: Column) -> Column:
        drawn = let(F.when(salt == "", seed).otherwise(keys.hmac_sha256(F.concat(seed, salt), None)), lambda x: candidate(s, x, cfg))
        tried = lambda x, r: F.struct(x.alias("value"), F.when(r.isNull(), acc["retries"]).otherwise(acc["retries"] + 1).alias("retries"), F.coalesce(r, acc["reason"]).alias("reason"), r.isNull().alias("done"))
        one = let(drawn, lambda x: let(F.when(~kept_role, p.unsafe(s, x)), lambda r: tried(x, r)))
        return F.when(acc["done"], acc).otherwise(one).cast(kind)

    begin = F.struct(F.lit(None).cast("string").alias("value"), F.lit(0).alias("retries"), F.lit(None).cast("string").alias("reason"), F.lit(False).alias("done")).cast(kind)
    last = lambda a: F.when(a["done"] | a["value"].isNull(), a["value"]).otherwise(p.placeholder(s["label"], seed))
    return let(F.aggregate(F.array(*map(F.lit, SALTS)), begin, step), lambda a: F.struct(last(a).alias("value"), a["retries"].alias("retries"), a["reason"].alias("reason")))


def planned(spans: Column, scope: Column, cfg: Config) -> Column:
    """An entry for each span that is replaced (schema.PLAN). A role word that is kept has an entry too, marked skip."""

    def of(s: Column) -> Column:
        # aliases draw from the seed of the person they stand for
        kind = F.when(s["label"] == "ALIAS_LABEL", "PERSON").otherwise(s["label"])
        keep = (s["label"] == "ALIAS_LABEL") & (s["subtype"] == "role") & F.lit(cfg.alias_labels == "keep_roles")
        own = {c: s[c] for c in ("label", "subtype", "source", "entity_id")}

        def entry(r: Column) -> Column:
            return record(start=s["start"], end=s["end"], original=s["text"], replacement=r["value"], **own, skip=F.coalesce(keep, F.lit(False)), retries=r["retries"], reason=r["reason"])

        return let(keys.digest(kind, key_of(s), scope, cfg.secret), lambda seed: let(safe(s, seed, cfg), entry))

    return F.coalesce(F.when(F.size(spans) > 0, F.filter(F.transform(spans, of), lambda e: e["replacement"].isNotNull())), empty(PLAN)).cast(PLAN)


def checked(text: Column, plan: Column) -> Column:
    """The plan in order of start; an error where entries overlap or lie outside of the text."""

    def of(e: Column, length: Column) -> Column:
        bad = F.exists(e, lambda x: (x["start"] < 0) | (x["end"] <= x["start"]) | (x["end"] > length))
        meet = F.exists(F.transform(e, lambda x, i: F.coalesce(overlaps(F.get(e, i - 1), x), F.lit(False))), lambda x: x)
        return F.when(bad, F.raise_error(F.lit("a plan entry lies outside of the text"))).when(meet, F.raise_error(F.lit("plan entries overlap"))).otherwise(e)

    return let(F.length(text), lambda length: let(F.array_sort(plan), lambda e: of(e, length)))


def new_starts(plan: Column) -> Column:
    """Where each entry's replacement begins in the new text: its start moved by the differences in length before it."""
    deltas = F.transform(plan, lambda e: F.length(e["replacement"]) - (e["end"] - e["start"]))
    return let(sums_before(deltas), lambda d: F.transform(plan, lambda e, i: e["start"] + F.get(d, i)))


def applied(text: Column, plan: Column) -> Column:
    """The text with the plan's replacements at their exact offsets; a text that has them all already is returned as it is."""

    def stretch(part: Column, pieces: Column) -> Column:
        base = F.element_at(pieces, 1)["from"]
        return F.array_join(F.transform(pieces, lambda x: F.concat(F.substr(part, x["from"] - base + 1, x["start"] - x["from"]), x["new"])), "")

    def rebuilt(e: Column) -> Column:
        # a block of entries is cut out of its own stretch of the text: to count from the front for each entry would be quadratic
        pieces = F.transform(e, lambda x, i: F.struct(F.coalesce(F.get(e, i - 1)["end"], F.lit(0)).alias("from"), x["start"].alias("start"), x["replacement"].alias("new")))
        reach = lambda b: F.substr(text, F.element_at(b, 1)["from"] + 1, F.element_at(b, -1)["start"] - F.element_at(b, 1)["from"])
        parts = let(pieces, lambda ps: F.transform(in_blocks(ps), lambda b: let(reach(b), lambda t: stretch(t, b))))
        return F.concat(F.array_join(parts, ""), F.substr(text, F.element_at(e, -1)["end"] + 1))

    def done(e: Column) -> Column:
        # up to the first entry that isn't there
        there = lambda at: F.forall(F.arrays_zip(at.alias("at"), e.alias("e")), lambda z: F.substr(text, z["at"] + 1, F.length(z["e"]["replacement"])) == z["e"]["replacement"])
        return let(new_starts(e), there)

    return F.when(F.size(plan) == 0, text).otherwise(let(F.array_sort(plan), lambda e: F.when(done(e), text).otherwise(let(checked(text, e), rebuilt))))

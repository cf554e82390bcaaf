"""Names of people: a score for how much a text looks like one, and its parts. Column expressions over the words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let, one_of, record

# Word lists that decide the score.
PARTICLES = "de del della di da van von der den dos das du la le of bin bint ibn".split()
SUFFIXES = "JR SR II III IV ESQ ESQUIRE PHD MD JD LLM CPA".split()
HONORIFICS = "mr ms mrs mx dr prof hon sir dame lord lady rev fr judge justice".split()
ROLE_WORDS = "buyer seller plaintiff defendant appellant appellee petitioner respondent".split()
UPPER_STOP = [w.upper() for w in ROLE_WORDS] + "UNITED STATES BANK SECTION OF AMERICA".split()
ORG_WORDS = "bank company co corp corporation inc llc llp ltd plc university college hospital association agency department section".split()
ROMAN = "I II III IV V VI VII VIII IX X".split()
LEAST = 0.6


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(text, "[‘’]", "'"), r"(?U)[\s,]+"), lambda t: t != "")


def bare(t: Column) -> Column:
    return F.regexp_replace(t, r"[.]", "")


def is_initial(t: Column) -> Column:
    return t.rlike(r"^\p{Lu}\.?$")


def is_particle(t: Column) -> Column:
    return one_of(F.lower(t), PARTICLES)


def is_suffix(t: Column) -> Column:
    return one_of(F.upper(bare(t)), SUFFIXES)


def is_honorific(t: Column) -> Column:
    return one_of(F.lower(bare(t)), HONORIFICS)


def is_core(t: Column) -> Column:
    shape = t.rlike(r"^\p{Lu}(?:\p{L}+(?:['-]\p{L}+)*|(?:['-]\p{L}+)+)\.?$")
    return shape & ~is_initial(t) & ~is_particle(t) & ~is_suffix(t) & ~is_honorific(t) & ~one_of(F.lower(bare(t)), ORG_WORDS + ROLE_WORDS)


def score(text: Column) -> Column:
    """From 0 to 1; LEAST and more is probably a person's name."""

    def of(ts: Column) -> Column:
        n = lambda f: F.size(F.filter(ts, f))
        core, initials = n(is_core), n(is_initial)
        points = [
            (((core >= 2) | ((core >= 1) & (initials >= 1))), F.lit(0.45)), (core >= 2, 0.15 + 0.15 * F.least(core - 2, F.lit(2))),
            (initials.between(1, 2) & (core >= 1), F.lit(0.15)), (n(is_particle) > 0, F.lit(0.10)), (n(is_suffix) > 0, F.lit(0.05)),
            (F.exists(ts, lambda t: t.rlike(r"\d")), F.lit(-0.25)),
            (F.forall(ts, lambda t: t == F.upper(t)) & (F.size(ts) > 1) & F.exists(ts, lambda t: one_of(t, UPPER_STOP)), F.lit(-0.20)),
            ((F.size(ts) == 1) & one_of(F.lower(F.get(ts, 0)), ROLE_WORDS), F.lit(-0.30)),
        ]
        total = sum((F.when(c, v).otherwise(F.lit(0.0)) for c, v in points), F.lit(0.0))
        return F.when(F.size(ts) == 0, F.lit(0.0)).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 6))

    return let(tokens(text), of)


def parsed(text: Column) -> Column:
    """honorifics, given, particles, surname, suffixes: arrays of words."""

    def of(ts: Column) -> Column:
        first = F.size(ts) - F.size(F.filter(ts, lambda t, i: F.exists(F.slice(ts, 1, i + 1), lambda x: ~is_honorific(x))))
        rest = F.slice(ts, first + 1, F.size(ts))
        tail = lambda t: is_suffix(t) | one_of(t, ROMAN)
        main = lambda r: F.filter(r, lambda t, i: F.exists(F.slice(r, i + 1, F.size(r)), lambda x: ~tail(x)))

        def split_up(r: Column, m: Column) -> Column:
            at = F.array_min(F.filter(F.transform(m, lambda t, i: F.when(is_particle(t), i)), lambda i: i.isNotNull()))
            n = F.size(m)
            two = (n >= 3) & is_core(F.get(m, n - 1)) & is_core(F.get(m, n - 2)) & ~is_initial(F.get(m, n - 2))
            cut = F.coalesce(at, F.when(F.coalesce(two, F.lit(False)), n - 2).otherwise(F.greatest(n - 1, F.lit(0))))
            after = F.slice(m, cut + 1, n)
            lead = F.filter(after, lambda t, i: F.forall(F.slice(after, 1, i + 1), is_particle))
            surname, suffixes = F.slice(after, F.size(lead) + 1, n), F.slice(r, n + 1, F.size(r))
            return record(honorifics=F.slice(ts, 1, first), given=F.slice(m, 1, cut), particles=lead, surname=surname, suffixes=suffixes)

        return let(rest, lambda r: let(main(r), lambda m: split_up(r, m)))

    return let(tokens(text), of)

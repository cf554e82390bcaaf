"""What turns detectors' spans into one set: address blocks, guards, alias and coreference links, and the merge.

Everything is within one document, so these are expressions over arrays. What looks back (as-of lookups, islands, groups of spans
that overlap) is one scan over sorted spans; interval joins with the few headings, blocks and definitions of a text are ``filter``
and ``exists``. Nothing is exchanged between tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.text import ANY_EOL, MATCH, contains, empty, folded, headings, let, lines, listed, matches, one_of, overlaps, record
from ..schema import SPANS, Config
from .detect import by_start, ordered, span

HELD = ("PERSON", "ORG", "GPE", "LOC", "ALIAS_LABEL")
SUBJECTS = ("PERSON", "ORG", "BANK_ORG")
#: A subject may end so many characters before the alias that it is linked with.
NEAR = 80
PRONOUNS = "he|she|they|him|her|them|his|hers|their|theirs"
PRONOUN = rf"(?iU)\b(?:{PRONOUNS})\b"


def address_blocks(text: Column, spans: Column) -> Column:
    """Adds a block for every town line that lines of street, box or unit stand over, one blank line between them at most.

    Within one document this is gaps and islands over line numbers: one scan carries the island that could still get its town.
    """
    island = "struct<line:int,start:int,n:int>"

    def numbered(parts: Column) -> Column:
        of = lambda s: F.struct(s["attrs"]["line"].cast("int").alias("line"), s["start"].alias("start"), s["end"].alias("end"), s["subtype"].alias("kind"))
        return F.transform(parts, of)

    def of(parts: Column, ls: Column) -> Column:
        def step(state: Column, p: Column) -> Column:
            gap = p["line"] - state["line"]
            blank = F.trim(F.get(ls, p["line"] - 1)["text"]) == ""
            on = state.isNotNull() & ((gap == 1) | ((gap == 2) & blank))
            start, n = F.when(on, state["start"]).otherwise(p["start"]), F.when(on, state["n"] + 1).otherwise(1)
            grown = F.struct(p["line"].alias("line"), start.alias("start"), n.alias("n")).cast(island)
            town = p["kind"] == "city_state_zip"
            done = F.when(town & on, F.struct(start.alias("start"), p["end"].alias("end"), n.alias("n")))
            return F.struct(F.when(~town, grown).alias("state"), done.cast("struct<start:int,end:int,n:int>").alias("out"))

        found = folded(parts, F.lit(None).cast(island), step, "struct<start:int,end:int,n:int>")
        whole = lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), F.substr(text, b["start"] + 1, b["end"] - b["start"]).alias("text"))
        return F.transform(F.filter(found, lambda b: b.isNotNull()), lambda b: span(whole(b), "ADDRESS_BLOCK", "address_block_merge", 0.99, "block", {"lines": b["n"]}))

    lined = by_start(F.filter(spans, lambda s: s["source"] == "address_line"))
    found = let(numbered(lined), lambda p: let(lines(text, ANY_EOL), lambda ls: of(p, ls)))
    return F.concat(spans, F.coalesce(F.when(F.exists(spans, lambda s: s["subtype"] == "city_state_zip"), found), empty(SPANS)).cast(SPANS))


def guarded(text: Column, spans: Column, cfg: Config) -> Column:
    """Names within headings go, and so do places outside of addresses (an anti join on containment, a semi join on overlap)."""
    kept = spans
    if cfg.protect_headings:
        held = F.when(F.exists(spans, lambda s: one_of(s["label"], HELD)), headings(text)).otherwise(empty(MATCH))
        kept = let(held, lambda hs: F.filter(spans, lambda s: ~(one_of(s["label"], HELD) & F.exists(hs, lambda h: contains(h, s)))))
    if cfg.gpe_outside_addresses:
        kept = let(kept, lambda ss: let(F.filter(ss, lambda s: s["label"] == "ADDRESS_BLOCK"), lambda blocks: F.filter(ss, lambda s: ~s["label"].isin("GPE", "LOC") | F.exists(blocks, lambda b: overlaps(b, s)))))
    return kept


def entity(key: Column, scope: Column, secret: str | None) -> Column:
    return keys.stable_id("entity", key, scope, secret)


def identified(spans: Column, scope: Column, secret: str | None) -> Column:
    """People and organisations with an entity id, the same for the same name within the scope."""
    return F.transform(spans, lambda s: F.when(one_of(s["label"], SUBJECTS) & s["entity_id"].isNull(), s.withField("entity_id", entity(s["text"], scope, secret))).otherwise(s))


def aliases_resolved(text: Column, spans: Column, scope: Column, cfg: Config) -> Column:
    """Gives each alias the entity of its subject, and adds the places after it where the alias stands as a word.

    A subject is the first name that overlaps what the definition states as one; if it states none, the nearest name of the same
    or the previous line that ends at most NEAR characters before the alias, else the first name of the line that was guessed;
    else what the definition states or guesses. An alias counts until the next definition for the same entity.
    """

    def defined(all_spans: Column) -> Column:
        subjects = by_start(F.filter(all_spans, lambda s: one_of(s["label"], SUBJECTS)))

        def linked(d: Column, who: Column, ls: Column) -> Column:
            a, b = d["attrs"]["subject_start"].cast("int"), d["attrs"]["subject_end"].cast("int")
            stated = F.get(F.filter(who, lambda s: (s["start"] < b) & (a < s["end"])), 0)["entity_id"]
            far = lambda s: F.greatest(d["start"] - s["end"], F.lit(0))
            breaks = lambda s: F.size(F.split(F.substr(text, s["start"] + 1, F.greatest(d["start"] - s["start"], F.lit(0))), ANY_EOL, -1)) - 1
            line_end = F.get(F.filter(ls, lambda x: x["end"] >= d["end"]), 0)["end"]
            close = F.filter(who, lambda s: (far(s) <= NEAR) & (s["start"] <= line_end))
            close = F.filter(close, lambda s: breaks(s) <= 1)
            near = F.get(F.array_sort(F.transform(close, lambda s, i: F.struct(far(s).alias("far"), i.alias("i"), s["entity_id"].alias("id")))), 0)["id"]
            line = F.get(ls, d["attrs"]["subject_guess_line"].cast("int"))
            guessed = F.get(F.filter(who, lambda s: (s["start"] < line["end"]) & (line["start"] < s["end"])), 0)["entity_id"]
            own = entity(F.coalesce(d["attrs"]["subject_text"], d["attrs"]["subject_guess"], d["text"]), scope, cfg.secret)
            return d.withField("entity_id", F.when(a.isNotNull(), F.coalesce(stated, own)).otherwise(F.coalesce(near, guessed, own)))

        is_alias = lambda s: s["label"] == "ALIAS_LABEL"
        return let(subjects, lambda who: let(lines(text, ANY_EOL), lambda ls: F.transform(all_spans, lambda s: F.when(is_alias(s), linked(s, who, ls)).otherwise(s))))

    def mentions(all_spans: Column) -> Column:
        defs = by_start(F.filter(all_spans, lambda s: s["label"] == "ALIAS_LABEL"))

        def of(ds: Column, d: Column, i: Column) -> Column:
            following = F.filter(F.slice(ds, i + 2, F.size(ds)), lambda x: x["entity_id"] == d["entity_id"])
            stop = F.coalesce(F.get(following, 0)["start"], F.length(text))
            word = F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), F.replace(d["text"], F.lit(r"\E"), F.lit("")), F.lit(r"\E(?![\p{L}\p{N}_])"))
            part = F.substr(text, d["end"] + 1, stop - d["end"])
            moved = F.transform(matches(part, word), lambda m: F.struct((m["start"] + d["end"]).alias("start"), (m["end"] + d["end"]).alias("end"), m["text"].alias("text")))
            free = F.filter(moved, lambda m: ~F.exists(all_spans, lambda s: overlaps(s, m)))
            return F.transform(free, lambda m: span(m, "ALIAS_LABEL", "alias_resolver", 0.96, d["subtype"], {"alias": d["text"], "trigger": F.lit("propagation")}).withField("entity_id", d["entity_id"]))

        return let(defs, lambda ds: F.flatten(F.transform(ds, lambda d, i: of(ds, d, i))))

    full = let(defined(spans), lambda ss: F.concat(ss, mentions(ss).cast(SPANS)))
    return F.when(F.exists(spans, lambda s: s["label"] == "ALIAS_LABEL"), full).otherwise(spans)


def coreferences(text: Column, spans: Column) -> Column:
    """start, end, text, entity_id: pronouns, each linked with the last person before it (a carry-forward over positions)."""
    kind = "struct<start:int,end:int,text:string,entity_id:string>"
    event = lambda at, side, x, who: F.struct(at.alias("at"), F.lit(side).alias("side"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), who.alias("who"))
    people = F.transform(F.filter(spans, lambda s: s["label"] == "PERSON"), lambda p: event(p["end"], 0, p, p["entity_id"]))
    pronouns = F.transform(matches(text, PRONOUN), lambda m: event(m["start"], 1, m, F.lit(None).cast("string")))

    def step(who: Column, e: Column) -> Column:
        linked = F.struct(e["start"].alias("start"), e["end"].alias("end"), e["text"].alias("text"), who.alias("entity_id"))
        person = e["side"] == 0
        return F.struct(F.when(person, e["who"]).otherwise(who).alias("state"), F.when(~person & who.isNotNull(), linked).cast(kind).alias("out"))

    run = F.filter(folded(F.array_sort(F.concat(people, pronouns)), F.lit(None).cast("string"), step, kind), lambda m: m.isNotNull())
    return F.when(F.exists(spans, lambda s: s["label"] == "PERSON"), run).otherwise(empty(f"array<{kind}>"))


def surnames_joined(spans: Column) -> Column:
    """Persons of whose name only the last word stands get the entity of the person before, of those with that last word the one
    that ended first. One scan over all persons in order of last words."""
    state, tail = "struct<tail:string,end:int,id:string>", lambda s: F.lower(F.element_at(F.split(s["text"], r"(?U)\s+"), -1))
    person = lambda s, i: F.when(s["label"] == "PERSON", record(tail=tail(s), start=s["start"], end=s["end"], i=i, id=s["entity_id"]))
    people = lambda ss: F.filter(F.transform(ss, person), lambda x: x.isNotNull())

    def step(first: Column, p: Column) -> Column:
        same = F.coalesce(first["tail"] == p["tail"], F.lit(False))
        new = ~same | (p["end"] < first["end"])
        out = F.when(same & (first["end"] <= p["start"]), F.struct(p["i"].alias("i"), first["id"].alias("id")))
        return F.struct(F.when(new, F.struct(p["tail"].alias("tail"), p["end"].alias("end"), p["id"].alias("id"))).otherwise(first).cast(state).alias("state"), out.cast("struct<i:int,id:string>").alias("out"))

    def of(ss: Column) -> Column:
        joined = F.filter(folded(F.array_sort(people(ss)), F.lit(None).cast(state), step, "struct<i:int,id:string>"), lambda x: x.isNotNull())
        ids = F.map_from_entries(F.transform(joined, lambda x: F.struct(x["i"], x["id"])))
        return let(ids, lambda m: F.transform(ss, lambda s, i: s.withField("entity_id", F.coalesce(F.try_element_at(m, i), s["entity_id"]))))

    return let(by_start(spans), of)


def model_joined(text: Column, spans: Column, groups: Column, scope: Column, secret: str | None) -> Column:
    """Spans with the entities of a model's clusters of mentions (array<array<struct<start,end>>>).

    A cluster has the entity of the first span that overlaps one of its mentions and has one, aliases before others; else that of
    its longest mention that is no pronoun. Every person, organisation and alias that overlaps a mention gets it.
    """
    meets = lambda s, g: F.exists(g, lambda m: overlaps(s, m))
    said = lambda m: F.substr(text, m["start"] + 1, m["end"] - m["start"])

    def entity_of(g: Column) -> Column:
        named = F.filter(spans, lambda s: s["entity_id"].isNotNull() & meets(s, g))
        first = F.coalesce(F.get(F.filter(named, lambda s: s["label"] == "ALIAS_LABEL"), 0)["entity_id"], F.get(named, 0)["entity_id"])
        words = F.filter(F.transform(g, said), lambda t: ~t.rlike(f"(?i)^(?:{PRONOUNS})$"))
        longest = F.get(F.array_sort(F.transform(words, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), 0)["t"]
        return F.struct(F.coalesce(first, entity(longest, scope, secret)).alias("id"), g.alias("mentions"))

    def joined(known: Column) -> Column:
        own = lambda s: F.get(F.filter(known, lambda k: meets(s, k["mentions"])), 0)["id"]
        return F.transform(spans, lambda s: F.when(one_of(s["label"], (*SUBJECTS, "ALIAS_LABEL")), s.withField("entity_id", F.coalesce(own(s), s["entity_id"]))).otherwise(s))

    return F.coalesce(let(F.transform(groups, entity_of), joined), spans)


def clusters(df: DataFrame, spans_col: str = "spans", id_col: str = "doc_id") -> DataFrame:
    """A row per document and entity: what it is called, as what, its aliases and role aliases, and how often it is mentioned."""
    s = df.select(id_col, F.explode(F.filter(spans_col, lambda s: s["entity_id"].isNotNull())).alias("s")).select(id_col, "s.*")
    is_alias, kind = F.col("label") == "ALIAS_LABEL", F.when(F.col("label") == "PERSON", "person").when(F.col("label").isin("ORG", "BANK_ORG"), "org")
    texts = lambda rule: F.array_sort(F.collect_set(F.when(rule, F.col("text"))))
    first = F.min(F.when(~is_alias, F.struct("start", "text", kind.alias("kind"))))
    return s.groupBy(id_col, "entity_id").agg(
        first["text"].alias("primary_surface"), F.coalesce(first["kind"], F.lit("unknown")).alias("kind"), texts(~is_alias).alias("surfaces"),
        texts(is_alias & (F.col("subtype") != "role")).alias("aliases"), texts(is_alias & (F.col("subtype") == "role")).alias("role_aliases"), F.count("*").alias("mentions"),
    )


def merged(spans: Column, cfg: Config) -> Column:
    """Spans that don't overlap: by precedence of labels, then length, confidence, start, label and source, each if it is free.

    Spans of one range and label need no step of their own: the most confident of the smallest source comes first. Spans that
    overlap, directly or through others, stand together in order of start; the choice is made within each such group.
    """
    order = listed(cfg.precedence)
    rank = lambda s: F.coalesce(F.nullif(F.array_position(order, s["label"]).cast("int"), F.lit(0)), F.lit(10_000))
    by = (rank, lambda s: s["start"] - s["end"], lambda s: -F.round(s["confidence"], 6), lambda s: s["start"], lambda s: s["label"], lambda s: s["source"])
    choose = lambda kept, c: F.when(F.exists(kept, lambda k: overlaps(k, c)), kept).otherwise(F.array_append(kept, c))
    chosen = lambda g: F.when(F.size(g) == 1, g).otherwise(by_start(F.aggregate(ordered(g, *by), empty(SPANS), choose)))

    def of(ss: Column) -> Column:
        reach = folded(F.transform(ss, lambda s: s["end"]), F.lit(0), lambda r, end: F.struct(F.greatest(r, end).alias("state"), r.alias("out")), "int")
        heads = lambda ends: F.filter(F.transform(ss, lambda s, i: F.when((i == 0) | (s["start"] >= F.get(ends, i)), i)), lambda i: i.isNotNull())
        # element by element: a slice would copy the whole array for each group
        group = lambda hs, h, j: F.transform(F.sequence(h, F.coalesce(F.get(hs, j + 1), F.size(ss)) - 1), lambda i: F.get(ss, i))
        groups = lambda hs: F.transform(hs, lambda h, j: group(hs, h, j))
        return let(reach, lambda ends: let(heads(ends), lambda hs: F.flatten(F.transform(groups(hs), lambda g: let(g, chosen)))))

    return F.coalesce(let(by_start(F.filter(spans, lambda s: s["end"] > s["start"])), of), empty(SPANS))

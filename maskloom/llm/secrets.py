"""Secret scans: candidates by pattern, judged by who owns them across the corpus.

Base kinds (assign, access, hex) always count. The method's own kinds count when their value looks live: ``url`` (a password in
an address), ``key`` (a token that says by its prefix whose it is), ``jwt`` (a signed token), ``pem`` (a private key) and
``mixed`` (a long run of letters of both cases and digits). Ownership is counted for all values over the whole corpus: distinct
repositories and owners by the value's hash, in three sums, each pre-aggregated, so that a value in a third of all rows costs
each task a row. A value that WIDE owners have is an example that people copied. With fewer owners it is one too if its
repositories outnumber what its owners would have of their own: one owner may use a credential in any number of repositories,
but two that both have it in SPREAD repositories or more in all copied it. What is left is owner-specific and live.

Offsets are in code points. A null text counts as empty; null owners count as one owner, null repositories as one repository.
Each input row gives a row; repeated rows count as the repository they are of. Of spans that begin at one place the kind that
comes first in KINDS comes first. Texts of any length are scanned whole; work grows in proportion to text and spans. An empty
table gives an empty one. Other columns are ignored, whatever their names, or carried in ``row``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, let

#: Kinds in the order that breaks ties, and their patterns; the value is the last group or the whole match.
KINDS = ("assign", "access", "hex", "url", "key", "jwt", "pem", "mixed")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
URL = r"[A-Za-z][A-Za-z0-9+.-]{0,30}://[^\x00-\x20:/@]+:[^\x00-\x20/@]{3,}@"
KEY = r"gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{16,}|npm_[A-Za-z0-9]{36}"
JWT = r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
PEM = r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]{32,}-----END [A-Z ]{0,20}PRIVATE KEY-----"
MIXED = r"[A-Za-z0-9_-]{20,}"
LEAST_VALUE, BASE_KINDS = 6, 3
#: Owners of a copied value; repositories of a copied value that two owners have.
WIDE, SPREAD = 3, 4
#: Elements that are folded or cut at a time: appending one by one, or cutting from the front of a text, takes the square of it.
BLOCK = 256


def in_blocks(a: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int")), lambda j: F.slice(a, j * BLOCK + 1, BLOCK))


def running(a: Column, join: Callable[[Column, Column], Column]) -> Column:
    """What join makes, from 0, of all elements of an array<int> before each one, block by block."""
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(0).alias("s"), none.alias("a"))
    before = lambda x: F.aggregate(x, start, lambda acc, v: F.struct(join(acc["s"], v).alias("s"), F.array_append(acc["a"], acc["s"]).alias("a")))["a"]

    def joined(blocks: Column) -> Column:
        ends = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), join))
        return let(before(ends), lambda s: F.flatten(F.transform(blocks, lambda b, j: F.transform(before(b), lambda v: join(F.get(s, j), v)))))

    return F.when(F.size(a) > 0, let(in_blocks(a), joined)).otherwise(none)


def running_sums(a: Column) -> Column:
    return running(a, lambda s, v: s + v)


def found(text: Column, pattern: str, kind: str, value: int = 0) -> Column:
    """Structs of start, rank, end, kind, value for all matches; null where the text has none."""
    rank = KINDS.index(kind)

    def span(m: Column, start: Column) -> Column:
        inner = F.regexp_extract(m, pattern, value) if value else m
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(m)).alias("end"), F.lit(kind).alias("kind"), inner.alias("value"))

    def spans(matches: Column, gaps: Column) -> Column:
        steps = F.transform(matches, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))
        start = lambda before, i: F.get(before, i) + F.length(F.get(gaps, i))
        return let(running_sums(steps), lambda before: F.transform(matches, lambda m, i: let(start(before, i), lambda s: span(m, s))))

    matched = let(F.regexp_extract_all(text, F.lit(pattern), 0), lambda m: let(F.split(text, pattern, -1), lambda g: spans(m, g)))
    return F.when(text.rlike(pattern), matched)


def candidates(text: Column) -> Column:
    """All spans of a text, base and own kinds, by start and then kind."""
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string>>")
    has = lambda s, *classes: F.lit(True) if not classes else s["value"].rlike(classes[0]) & has(s, *classes[1:])

    def of(t: Column) -> Column:
        parts = [
            F.filter(found(t, ASSIGN, "assign", 2), lambda s: F.length(s["value"]) >= LEAST_VALUE),
            found(t, ACCESS, "access"),
            found(t, HEX, "hex"),
            found(t, URL, "url"),
            found(t, KEY, "key"),
            found(t, JWT, "jwt"),
            found(t, PEM, "pem"),
            F.filter(found(t, MIXED, "mixed"), lambda s: has(s, "[0-9]", "[A-Z]", "[a-z]")),
        ]
        return F.array_sort(F.concat(*(F.coalesce(p, none) for p in parts)))

    return let(F.coalesce(text, F.lit("")), of)


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def ownership(spans: DataFrame) -> DataFrame:
    """spans: hash, repo, owner. hash, n_repos, n_owners. A repository that several owners have counts once for each."""
    pairs = spans.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    owners = pairs.groupBy("hash", "owner").agg(F.count("*").alias("n_repos"))
    return owners.groupBy("hash").agg(F.sum("n_repos").alias("n_repos"), F.count("*").alias("n_owners"))


def is_live(n_owners: Column, n_repos: Column) -> Column:
    return (n_owners < WIDE) & ((n_owners == 1) | (n_repos < SPREAD))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", carry: bool = False) -> DataFrame:
    """doc_id, base and all: arrays of spans, each with live and with n_repos and n_owners of its value; n_live, n_copied: how
    many spans are live, or not. carry adds row (a struct of all input columns).

    Candidates go to a table. Only rows with candidates meet the verdicts; all others pass by that exchange.
    """
    kind = "array<struct<start:int,rank:int,end:int,kind:string,live:boolean,n_repos:bigint,n_owners:bigint>>"
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)) if carry else F.lit(None).cast("struct<x:int>")
    own = [F.col(id_col).alias("doc_id"), F.col(repo_col).alias("repo"), F.coalesce(F.col(owner_col), F.lit("")).alias("owner")]
    base = cut(docs.select(row.alias("row"), *own, candidates(F.col(text_col)).alias("spans"), F.monotonically_increasing_id().alias("place")), "candidates")
    some = base.where(F.size("spans") > 0)
    each = some.select("place", "repo", "owner", F.inline("spans")).withColumn("hash", F.xxhash64("value", "kind"))
    owned = cut(ownership(each.select("hash", "repo", "owner")), "ownership")
    judged = each.select("place", "start", "rank", "end", "kind", "hash").join(owned, "hash")
    verdict = F.struct("start", "rank", "end", "kind", is_live(F.col("n_owners"), F.col("n_repos")).alias("live"), "n_repos", "n_owners")
    by_doc = judged.groupBy("place").agg(F.array_sort(F.collect_list(verdict)).cast(kind).alias("s"))  # at most a document's spans
    hit = some.select("place", "row", "doc_id").join(by_doc, "place").select("row", "doc_id", "s")
    clean = base.where(F.size("spans") == 0).select("row", "doc_id", F.array().cast(kind).alias("s"))
    is_base = lambda s: s["rank"] < BASE_KINDS
    live = F.size(F.filter("s", lambda s: s["live"]))
    return clean.unionByName(hit).select(
        "row", "doc_id", F.filter("s", is_base).alias("base"), F.filter("s", lambda s: is_base(s) | s["live"]).alias("all"),
        live.cast("long").alias("n_live"), (F.size("s") - live).cast("long").alias("n_copied"),
    )


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span (sorted by start) replaced; spans that overlap or touch count as one. A null text stays null.

    The ends so far (a running maximum) tell where each span begins anew. A text is cut twice, first into stretches of BLOCK
    spans, so that no cut counts characters from the front of the whole text for every span.
    """

    def block(stretch: Column, pieces: Column) -> Column:
        shown = lambda p: F.concat(stretch.substr(p["from"] + 1, p["to"] - p["from"]), F.lit(mask))
        return F.array_join(F.transform(pieces, shown), "")

    def of(pieces: Column) -> Column:
        first, last = lambda b: F.element_at(b, 1)["from"], lambda b: F.element_at(b, -1)["to"]
        moved = lambda b: F.transform(b, lambda p: F.struct((p["from"] - first(b)).alias("from"), (p["to"] - first(b)).alias("to")))
        parts = F.transform(in_blocks(pieces), lambda b: let(text.substr(first(b) + 1, last(b) - first(b)), lambda t: let(moved(b), lambda m: block(t, m))))
        return F.array_join(parts, "")

    def with_ends(ends: Column) -> Column:
        gap = lambda s, i: F.struct(F.get(ends, i).alias("from"), s["start"].alias("to"))
        new = F.filter(F.transform(spans, gap), lambda p, i: (i == 0) | (p["to"] > p["from"]))
        tail = F.greatest(F.element_at(ends, -1), F.element_at(spans, -1)["end"])
        return F.concat(let(new, of), text.substr(tail + 1, F.length(text)))

    before = running(F.transform(spans, lambda s: s["end"]), lambda s, v: F.greatest(s, v))
    return F.when(F.size(spans) == 0, text).otherwise(let(before, with_ends))

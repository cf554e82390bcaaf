"""Text functions as Column expressions: matches with offsets, lines, normalisation, sentences, case.

Offsets are in code points, half-open. Arrays reach lambdas as arguments (see ``let``), never as captured expressions: the
optimizer would inline a captured expression into the lambda and compute it again for every element.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCH = "array<struct<start:int,end:int,text:string>>"
#: Characters that end a sentence or bracket and are trimmed from the right; abbreviations that end no sentence.
RIGHT_TRIM = ")]};:,.!?»”’>"
ABBREVIATIONS = "Mr. Mrs. Ms. Dr. Prof. Sr. Jr. St. vs. etc. Inc. Ltd. Co. Corp. No. Jan. Feb. Mar. Apr. Jun. Jul. Aug. Sep. Sept. Oct. Nov. Dec. U.S.".split()
#: Dropped (zero-width characters, soft hyphen) and replaced (spaces that don't break, curly quotes) by normalisation.
DROPPED = "\u200b\u200c\u200d\ufeff\u00ad"
REPLACED = {"\u00a0": " ", "\u202f": " ", "\u2007": " ", "\u201c": '"', "\u201d": '"', "\u2018": "'", "\u2019": "'"}
#: Line ends: those of text files, and all that count in address lines and headings.
EOL, ANY_EOL = r"\r\n|\n|\r", "\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085\u2028\u2029]"
BLOCK = 256
#: A character that no text should hold.
MARK = "\x01"


@contextmanager
def quick_building() -> Iterator[None]:
    """Builds Columns without asking the JVM for the call site of each, which takes most of the time for large expressions."""
    from pyspark.errors import utils

    before = getattr(utils, "_enable_debugging_cache", None)
    utils._enable_debugging_cache = False
    try:
        yield
    finally:
        utils._enable_debugging_cache = before


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def record(**fields: Column) -> Column:
    """A struct of named values."""
    return F.struct(*(value.alias(name) for name, value in fields.items()))


def step(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column added or replaced that the optimizer leaves where it is, as a row generated from each row.

    As a plain projection a step would be copied into everything that uses it, and a filter on its result rewritten over its whole
    history. Filters on the other columns go below a generated one, down to the scan.
    """
    fields = [c for c in df.columns if c != name]
    made = df.select(*(F.col(f"`{c}`") for c in df.columns), F.explode(F.array(value)).alias("maskloom_step"))
    return made.select(*(F.col(f"`{c}`") for c in fields), F.col("maskloom_step").alias(name))


def one_of(c: Column, words: list[str] | tuple[str, ...]) -> Column:
    """Whether c is one of some plain words: one pattern, for building a literal of each takes many calls to the JVM."""
    return c.rlike(f"^(?:{'|'.join(words)})$")


def listed(words: list[str] | tuple[str, ...]) -> Column:
    """An array of words without spaces; it is folded to a literal."""
    return F.split(F.lit(" ".join(words)), " ")


def empty(kind: str) -> Column:
    return F.array().cast(kind)


def sums_before(a: Column) -> Column:
    """For each element of an array<int> the sum of those before it, block by block: appending alone would be quadratic."""

    def within(x: Column) -> Column:
        start = F.struct(F.lit(0).alias("sum"), empty("array<int>").alias("out"))
        step = lambda acc, v: F.struct((acc["sum"] + v).alias("sum"), F.array_append(acc["out"], acc["sum"]).alias("out"))
        return F.aggregate(x, start, step, lambda acc: acc["out"])

    def joined(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, v: s + v))
        return let(within(totals), lambda base: F.flatten(F.transform(blocks, lambda b, j: F.transform(within(b), lambda v: v + F.get(base, j)))))

    return let(a, lambda v: F.when(F.size(v) > 0, let(in_blocks(v), joined)).otherwise(empty("array<int>")))


def in_blocks(a: Column) -> Column:
    """An array as arrays of BLOCK elements. a must be a value (see let): an expression would be computed for every block."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int")), lambda j: F.slice(a, j * BLOCK + 1, BLOCK))


def folded(a: Column, start: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """A scan: step(state, element) gives a struct of the next state and out; all outs (of that type) in order.

    Appending to one array would copy all that is there for every element, so it is done by blocks.
    """

    def within(state: Column, block: Column) -> Column:
        begin = F.struct(state.alias("state"), empty(f"array<{kind}>").alias("out"))
        return F.aggregate(block, begin, lambda acc, x: let(step(acc["state"], x), lambda r: F.struct(r["state"].alias("state"), F.array_append(acc["out"], r["out"]).alias("out"))))

    def over(blocks: Column) -> Column:
        begin = F.struct(start.alias("state"), empty(f"array<array<{kind}>>").alias("out"))
        joined = lambda acc, r: F.struct(r["state"].alias("state"), F.array_append(acc["out"], r["out"]).alias("out"))
        return F.flatten(F.aggregate(blocks, begin, lambda acc, b: let(within(acc["state"], b), lambda r: joined(acc, r)), lambda acc: acc["out"]))

    return let(a, lambda v: F.when(F.size(v) > 0, let(in_blocks(v), over)).otherwise(empty(f"array<{kind}>")))


def matches(text: Column, pattern: Column | str) -> Column:
    """All non-overlapping matches of a Java pattern, leftmost first: array of start, end, text. The pattern must not match ''.

    A test keeps texts without any from the rest. Then one pass puts marks round the matches and a split at the marks gives what
    stands between them and the matches in turn. A text that holds the mark itself is passed over twice instead.
    """
    rx = F.lit(pattern) if isinstance(pattern, str) else pattern
    none = empty(MATCH)

    def of(parts: Column) -> Column:
        """parts: gap, match, gap, ..., gap."""
        span = lambda i, base: F.struct(F.get(base, i).alias("start"), (F.get(base, i) + F.length(F.get(parts, i))).alias("end"), F.get(parts, i).alias("text"))
        odd = F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2))
        return let(sums_before(F.transform(parts, F.length)), lambda base: F.transform(odd, lambda i: span(i, base)))

    marked = F.split(F.regexp_replace(text, rx, F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    woven = let(F.regexp_extract_all(text, rx, F.lit(0)), lambda m: F.flatten(F.transform(F.split(text, rx, F.lit(-1)), lambda g, i: F.filter(F.array(g, F.get(m, i)), lambda x: x.isNotNull()))))
    found = let(F.when(F.contains(text, F.lit(MARK)), woven).otherwise(marked), of)
    return F.coalesce(F.when(text.rlike(pattern) if isinstance(pattern, str) else F.regexp_like(text, rx), found), none)


def lines(text: Column, eol: str = EOL) -> Column:
    """start, end (without the line end) and text of each line; a line end at the end of the text opens no further line."""

    def spans(parts: Column, ends: Column) -> Column:
        steps = F.transform(parts, lambda p, i: F.length(p) + F.coalesce(F.length(F.get(ends, i)), F.lit(0)))
        spans = let(sums_before(steps), lambda base: F.transform(parts, lambda p, i: F.struct(F.get(base, i).alias("start"), (F.get(base, i) + F.length(p)).alias("end"), p.alias("text"))))
        return spans

    def trimmed(all_lines: Column) -> Column:
        return F.when(F.element_at(all_lines, -1)["text"] == "", F.slice(all_lines, 1, F.size(all_lines) - 1)).otherwise(all_lines)

    found = let(F.split(text, eol, -1), lambda p: let(F.regexp_extract_all(text, F.lit(eol), 0), lambda e: spans(p, e)))
    return let(found, trimmed)


def line_of(starts: Column, at: Column) -> Column:
    """The number (from 0) of the line whose start is the last one at or before a position."""
    return F.size(F.filter(starts, lambda s: s <= at)) - 1


def line_col(starts: Column, at: Column) -> Column:
    """line and col (both from 0) of a position; an error for a negative one."""
    place = lambda n: F.struct(n.alias("line"), (at - F.get(starts, n)).alias("col"))
    return F.when(at < 0, F.raise_error(F.lit("a position can't be negative"))).otherwise(let(line_of(starts, at), place))


def right_trimmed(s: Column) -> Column:
    return F.regexp_replace(s, r"[)\]};:,.!?»”’>]+$", "")


def normalized(text: Column) -> Column:
    """Drops what is invisible, makes spaces and quotes plain, and joins words that a hyphen splits over two lines (ASCII letters).

    Combining marks are composed by ``composed`` where a text has any; this is the part that needs no Python.
    """
    plain = F.translate(text, "".join(REPLACED) + DROPPED, "".join(REPLACED.values()))
    return F.regexp_replace(plain, "([A-Za-z])-\r?\n([A-Za-z])", "$1$2")


def sentences(text: Column) -> Column:
    """start, end, text of sentences: a terminator with closing quotes, white space and a capital begin the next one.

    A terminator after an abbreviation of the list, or after single capitals with points, ends none.
    """
    stops = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS if a != "U.S.")
    gap = rf"(?<![\s\"'(\[](?:{stops})|^(?:{stops})|\b[A-Z]\.[A-Z]\.)(?<=[.!?]|[.!?][\"')\]]|[.!?][\"')\]][\"')\]])\s+(?=[\"'(\[]?[A-Z])"

    def spans(parts: Column, gaps: Column) -> Column:
        steps = F.transform(parts, lambda p, i: F.length(p) + F.coalesce(F.length(F.get(gaps, i)), F.lit(0)))
        span = lambda p, s: F.struct(s.alias("start"), (s + F.length(p)).alias("end"), p.alias("text"))
        return F.filter(let(sums_before(steps), lambda base: F.transform(parts, lambda p, i: span(p, F.get(base, i)))), lambda x: F.trim(x["text"]) != "")

    return let(F.split(text, gap, -1), lambda p: let(F.regexp_extract_all(text, F.lit(gap), 0), lambda g: spans(p, g)))


def case_of(s: Column) -> Column:
    """UPPER, LOWER, TITLE or MIXED, as the letters of s are."""
    letters = s.rlike(r"\p{L}")
    return F.when(letters & (s == F.upper(s)), "UPPER").when(letters & (s == F.lower(s)), "LOWER").when(s.rlike(r"^[^\p{L}]*(?:\p{Lu}\p{Ll}*(?!\p{L})[^\p{L}]*)+$"), "TITLE").otherwise("MIXED")


def match_case(source: Column, replacement: Column) -> Column:
    """The replacement in the case of the source; for mixed case letter by letter, the source's letters over again."""

    def mixed(letters: Column) -> Column:
        chars = F.split(replacement, "")
        is_upper = lambda i: F.get(letters, F.pmod(i, F.size(letters))).rlike(r"\p{Lu}")
        return F.array_join(F.transform(chars, lambda c, i: F.when(is_upper(i), F.upper(c)).otherwise(F.lower(c))), "")

    case = case_of(source)
    own = let(F.regexp_extract_all(source, F.lit(r"\p{L}"), 0), lambda x: F.when(F.size(x) > 0, mixed(x)).otherwise(replacement))
    return F.when(case == "UPPER", F.upper(replacement)).when(case == "LOWER", F.lower(replacement)).when(case == "TITLE", F.initcap(F.lower(replacement))).otherwise(own)


def headings(text: Column) -> Column:
    """Lines that are headings: two to six words all in title case, or in capitals, or a Roman number and a title."""

    def is_heading(line: Column) -> Column:
        s = F.trim(line["text"])
        n = F.size(F.split(s, r"\s+"))
        few = (n >= 2) & (n <= 6)
        title = s.rlike(r"^\p{Lu}\p{Ll}*(?:\s+\p{Lu}\p{Ll}*)*$")
        capitals = s == F.upper(s)
        return (F.length(s) > 0) & ((few & (title | capitals)) | s.rlike(r"^[IVXLC]+\.\s+\p{Lu}.{0,80}$"))

    return F.filter(lines(text, ANY_EOL), is_heading)


def overlaps(a: Column, b: Column) -> Column:
    """Touching spans don't overlap."""
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def contains(outer: Column, inner: Column) -> Column:
    return (outer["start"] <= inner["start"]) & (inner["end"] <= outer["end"])

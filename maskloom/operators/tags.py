"""Token classes: a run of words becomes a string with a letter for each token, and what is looked for is a pattern over letters.

Runs are cut out of a text by one pattern. Within a run every token gets its letter from a lexicon (a plain lookup) or from its
shape. So a pattern such as ``[A-Z]+CU`` says: words, then Credit Union, and knows nothing of spaces or spelling.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let, matches

#: What tokens of a run are: a comma, or what stands between spaces and commas.
TOKEN = r"[^\s,]+|,"


@dataclass(frozen=True)
class Lexicon:
    """words: token to letter; shapes: pattern to letter, tried in order; other: the letter of all other tokens."""

    words: tuple[tuple[str, str], ...]
    shapes: tuple[tuple[str, str], ...]
    other: str

    def letter(self, token: Column) -> Column:
        table = F.create_map(*(F.lit(x) for kv in self.words for x in kv))
        by_shape = [F.when(token.rlike(rx), F.lit(letter)) for rx, letter in self.shapes]
        return F.coalesce(F.try_element_at(table, token), *by_shape, F.lit(self.other))


def tagged(runs: Column, lexicon: Lexicon) -> Column:
    """Runs (matches of a text) with their tokens and tags."""

    def of(r: Column) -> Column:
        tags = lambda ts: F.array_join(F.transform(ts, lambda t: lexicon.letter(t["text"])), "")
        return let(matches(r["text"], TOKEN), lambda ts: F.struct(r["start"].alias("start"), r["text"].alias("text"), ts.alias("tokens"), tags(ts).alias("tags")))

    return F.transform(runs, of)


def phrases(runs: Column, patterns: list[tuple[str, str]]) -> Column:
    """start, end, text and kind of all places in tagged runs whose letters a pattern (kind, pattern) matches, kind by kind."""
    table = F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(rx).alias("rx")) for kind, rx in patterns))

    def place(r: Column, m: Column, kind: Column) -> Column:
        a, b = F.get(r["tokens"], m["start"])["start"], F.get(r["tokens"], m["end"] - 1)["end"]
        text = F.substr(r["text"], a + 1, b - a)
        return F.struct((r["start"] + a).alias("start"), (r["start"] + b).alias("end"), text.alias("text"), kind.alias("kind"))

    in_run = lambda r, k: F.transform(matches(r["tags"], k["rx"]), lambda m: place(r, m, k["kind"]))
    return F.flatten(F.transform(table, lambda k: F.flatten(F.transform(runs, lambda r: in_run(r, k)))))

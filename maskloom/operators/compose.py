"""Composing marks (NFC), character maps, and shaping one string like another.

``composed`` is a Column expression; the others go through Python, by Arrow batches, and stand outside of the hot path.
"""

import functools
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.text import DROPPED, REPLACED, let


#: Where the Hangul letters of each kind and the syllables made of them begin, and how many there are.
LEAD, VOWEL, TAIL, SYLLABLE, VOWELS, TAILS = 0x1100, 0x1161, 0x11A7, 0xAC00, 21, 28


@functools.lru_cache(maxsize=1)
def pairs() -> dict[str, str]:
    """A character and a mark to the one character for both, from Unicode's own data."""
    out = {}
    for code in range(0xC0, 0x20000):
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) == 2 and not parts[0].startswith("<") and unicodedata.normalize("NFC", chr(code)) == chr(code):
            out[chr(int(parts[0], 16)) + chr(int(parts[1], 16))] = chr(code)
    return out


@functools.lru_cache(maxsize=1)
def singles() -> dict[str, str]:
    """Characters that stand for one other character."""
    every = {chr(c): unicodedata.normalize("NFC", chr(c)) for c in range(0xC0, 0x30000) if not 0xD800 <= c < 0xE000}
    return {a: b for a, b in every.items() if a != b and len(b) == 1}


@functools.lru_cache(maxsize=1)
def expanded() -> dict[str, str]:
    """Characters that are always written as several."""
    every = {chr(c): unicodedata.normalize("NFC", chr(c)) for c in range(0xC0, 0x30000) if not 0xD800 <= c < 0xE000}
    return {a: b for a, b in every.items() if len(b) > 1}


@functools.lru_cache(maxsize=1)
def single_ranges() -> str:
    """A character class of few ranges that holds all of singles() and some characters round them."""
    runs: list[list[int]] = []
    for c in sorted(map(ord, singles())):
        if runs and c - runs[-1][1] <= 64:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs) + "]"


def of_code(code: Column) -> Column:
    """The character of a number below 65,536."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def syllable(letters: Column) -> Column:
    """Two or three Hangul letters as one syllable."""
    at = lambda i, base: F.ascii(F.substr(letters, F.lit(i), F.lit(1))) - base
    tail = F.when(F.length(letters) == 3, at(3, TAIL)).otherwise(0)
    return of_code(SYLLABLE + (at(1, LEAD) * VOWELS + at(2, VOWEL)) * TAILS + tail)


def rewritten(text: Column, pattern: str, new: Callable[[Column], Column]) -> Column:
    """The text with new(match) in place of every match."""
    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.zip_with(F.split(text, pattern, -1), F.array_append(F.transform(m, new), F.lit("")), lambda a, b: F.concat(a, b)))
    return F.array_join(found, "")


def composed(text: Column) -> Column:
    """NFC: marks composed, up to three a letter, Hangul letters to syllables, and characters that stand for another replaced.

    A text without any such character costs four tests. Marks that aren't in canonical order are left in the order they have, and
    so is one that composes only past another mark; ``nfc`` covers these too.
    """
    table = F.str_to_map(F.lit(";".join(f"{k}={v}" for k, v in pairs().items() if ";" not in k and "=" not in k)), F.lit(";"), F.lit("="))
    others = {k: v for k, v in pairs().items() if ";" in k or "=" in k}
    hangul = r"[\u1100-\u1112][\u1161-\u1175][\u11A8-\u11C2]?|[\uAC00-\uD7A3][\u11A8-\u11C2]"

    def pair(p: Column) -> Column:
        return F.coalesce(F.element_at(table, p), *(F.when(p == k, v) for k, v in others.items()), p)

    def marks(t: Column) -> Column:
        return rewritten(t, r"\P{M}\p{M}", pair)

    def vowels(t: Column) -> Column:
        return rewritten(t, signs + r"\p{M}", pair)

    signs = "[" + "".join(sorted({k[0] for k in pairs() if unicodedata.category(k[0]).startswith("M")})) + "]"
    apart = f"[{''.join(sorted(expanded()))}]"
    parts = F.create_map(*(F.lit(x) for kv in expanded().items() for x in kv))

    def jamo(m: Column) -> Column:
        first = F.ascii(m)
        late = of_code(first + F.ascii(F.substr(m, F.lit(2), F.lit(1))) - TAIL)
        return F.when(first >= SYLLABLE, F.when((first - SYLLABLE) % TAILS == 0, late).otherwise(m)).otherwise(syllable(m))

    single = F.translate(text, "".join(singles()), "".join(singles().values()))
    out = F.when(text.rlike(single_ranges()), single).otherwise(text)
    out = let(out, lambda t: F.when(t.rlike(r"\p{M}"), let(let(let(let(t, vowels), marks), marks), marks)).otherwise(t))
    out = let(out, lambda t: F.when(t.rlike(apart), rewritten(t, apart, lambda c: F.element_at(parts, c))).otherwise(t))
    return let(out, lambda t: F.when(t.rlike(hangul), rewritten(t, hangul, jamo)).otherwise(t))


def nfc(text: Column) -> Column:
    """NFC for all scripts."""
    return pandas_udf(lambda s: s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore"), "string")(text)


def with_map(text: str) -> tuple[str, list[int]]:
    """The normalised text and, for each of its characters, the place in the source that it comes from."""
    chars: list[str] = []
    at: list[int] = []
    for m in re.finditer(r"(?s).[̀-ͯ]*", text):
        for c in unicodedata.normalize("NFC", m[0]):
            c = REPLACED.get(c, c)
            if c not in DROPPED:
                chars.append(c)
                at.append(m.start())
    whole = "".join(chars)
    keep = [True] * len(whole)
    for m in re.finditer("[A-Za-z](-\r?\n)(?=[A-Za-z])", whole):
        keep[m.start(1) : m.end(1)] = [False] * (m.end(1) - m.start(1))
    return "".join(c for c, k in zip(whole, keep) if k), [i for i, k in zip(at, keep) if k]


def normalized_with_map(text: Column) -> Column:
    """A struct of text, char_map (place in the source of each character) and changed."""

    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [(*with_map(t or ""), t or "") for t in texts]
        return pd.DataFrame([(a, m, a != t) for a, m, t in rows], columns=["text", "char_map", "changed"])

    return pandas_udf(run, "struct<text:string,char_map:array<int>,changed:boolean>")(text)  # type: ignore[call-overload]


def cased_like(source: str, word: str) -> str:
    letters = [c for c in source if c.isalpha()]
    if not letters:
        return word
    if all(c.isupper() for c in letters):
        return word.upper()
    if all(c.islower() for c in letters):
        return word.lower()
    if source.istitle():
        return word.title()
    return "".join(c.upper() if letters[i % len(letters)].isupper() else c.lower() for i, c in enumerate(word))


def shaped_like(source: str, word: str) -> str:
    """The replacement in the case and with the punctuation of the source.

    What stands around the source stays, and so does a possessive ending; initials give initials; punctuation between the
    source's words stands between the replacement's words, or at the same letter if it is one word.
    """
    if not any(c.isalpha() for c in source):
        return word
    head, core, own, tail = re.fullmatch(r"(?s)(\W*)(.*?)('s|’s)?(\W*)", source).groups()
    words = re.findall(r"\w+", word)
    if re.fullmatch(r"(?:[A-Za-z]\.[\s-]*)+", core + tail):
        letters = iter([w[0].upper() for w in words] + [words[-1][0].upper()] * len(core))
        return head + re.sub("[A-Za-z]", lambda m: next(letters), core + tail)
    marks = re.findall(r"[^\w\s]", core)
    if not marks:
        return head + cased_like(core, " ".join(words) if " " in core or len(words) == 1 else "".join(words)) + (own or "") + tail
    if len(words) > 1:
        new = "".join(w + (marks[i] if i < len(marks) and i < len(words) - 1 else "") for i, w in enumerate(words))
        return head + cased_like(core, new) + (own or "") + tail
    new = word
    for m in re.finditer(r"[^\w\s]", core):
        at = len(re.sub(r"[^\w]", "", core[: m.start()])) + new[: m.start()].count(m[0])
        new = new[:at] + m[0] + new[at:]
    return head + cased_like(core, new) + (own or "") + tail


def format_like(source: Column, word: Column) -> Column:
    """shaped_like over columns."""

    def run(sources: pd.Series, words: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else shaped_like(a, b) for a, b in zip(sources, words)], dtype=object)

    return pandas_udf(run, "string")(source, word)  # type: ignore[call-overload]

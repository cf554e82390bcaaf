"""Substring dedup by recompression.

A text's words become symbols. Each round first names runs of one symbol, then pairs of neighbours of which the left symbol
belongs to one half of the alphabet and the right one to the other. A name is a hash of what it stands for, so it is the same
in all texts and a round needs no exchange; equal substrings get equal names but near their ends. How near is known: every
symbol carries the range of words that its parse looked at, so a symbol whose range lies inside a window stands in every
other place of the window too.

A window of WIDTH words is revealed by one such symbol, its anchor (the smallest hash, the rightmost on ties); neighbouring
windows mostly share it. An anchor's windows in a row make a block, a row of the table of blocks: anchor, block (the hash of
its words), place. A window repeats only if its anchor stands at two places. If all its places have one block, the whole block
repeats. Otherwise the windows of each different block, not of each copy, are looked at: first GROUP windows in a row by the
words that they all hold, since a window can't repeat where those don't; then what is left by the windows' own hashes.
Windows without an anchor (periodic texts) are their own anchor. Names and hashes have 64 bits and are compared in pairs, thus by 128 bits.

All words of windows that stand in two places are removed, also at the first. Null texts have no words. Each input row gives a
row; repeated rows, and ids that stand twice or are null, are texts of their own, so all windows of copies go. An empty table
gives an empty one. Other columns are ignored, whatever their names. Texts are worked on some PART_BYTES at a time; a longer one
is parsed in overlapping pieces, and its windows are hashed from its whole sequence of words, some 60 bytes for each word.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import PART_BYTES, cut, discard, parts, small_batches
from .winnowing import mixed

WIDTH, ROUNDS, GROUP = 35, 3, 5
SPACES = b" \t\n\v\f\r"
#: Bytes whose powers are held at a time.
STRETCH = 1 << 18
P = np.uint64(0xD6E8FEB86659FD93)
INVERSE = np.uint64(pow(int(P), -1, 1 << 64))
U = np.uint64


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@functools.lru_cache(maxsize=1)
def stretch_powers() -> tuple[np.ndarray, np.ndarray]:
    return powers(P, STRETCH), powers(INVERSE, STRETCH)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words in the bytes of texts that begin at offsets; no word goes over the end of a text."""
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    begins[edge] = solid[edge]
    stops = solid.copy()
    stops[:-1] &= ~solid[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    stops[last] = solid[last]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The polynomial of each word's bytes, by stretches of words: what is held for each byte has a bound."""
    up, down = stretch_powers()
    out, i = np.zeros(len(start), U), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + STRETCH, side="right")))
        a, z = start[i], end[j - 1]
        if z - a <= STRETCH:
            sums = np.concatenate([np.zeros(1, U), np.cumsum(table[data[a:z]] * up[: z - a], dtype=np.uint64)])
            # a word's polynomial, moved to begin at power 0
            out[i:j] = (sums[end[i:j] - a] - sums[start[i:j] - a]) * down[start[i:j] - a]
        else:  # one word of several stretches
            total = 0
            for at in range(a, z, STRETCH):
                part = table[data[at : min(at + STRETCH, z)]]
                total += int((part * up[: len(part)]).sum(dtype=np.uint64)) * pow(int(P), int(at - a), 1 << 64)
            out[i] = total % (1 << 64)
        i = j
    return out


def word_table(texts: pa.Array, fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hash, start, end (in the bytes of all texts) and row of every word, without a loop over words. fold: A to Z as a to z."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    start, end = word_bounds(data, offsets)
    table = mixed(np.arange(1, 257, dtype=np.uint64) * P)
    if fold:
        table[65:91] = table[97:123]
    h = word_hashes(data, start, end, table)
    return mixed(h + (end - start).astype(np.uint64)), start, end, np.searchsorted(offsets, start, side="right") - 1


class Parse:
    """Symbols of a sequence of words after some rounds; a barrier is a word that joins nothing and no window holds."""

    def __init__(self, words: np.ndarray, barrier: np.ndarray, rounds: int = ROUNDS):
        n = len(words)
        self.name, self.barrier = words, barrier
        self.first, self.left, self.right = np.arange(n), np.arange(n), np.arange(n) + 1
        for r in range(rounds):
            self.runs()
            self.pairs(r)

    def gather(self, heads: np.ndarray, name: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        self.name, self.first, self.barrier, self.left, self.right = name, self.first[heads], self.barrier[heads], left, right

    def runs(self) -> None:
        if len(self.name) < 2:
            return
        new = np.ones(len(self.name), bool)
        new[1:] = (self.name[1:] != self.name[:-1]) | self.barrier[1:] | self.barrier[:-1]
        heads = np.flatnonzero(new)
        ends = np.append(heads[1:], len(self.name))
        length = ends - heads
        name = np.where(length > 1, mixed(self.name[heads] + length.astype(np.uint64) * P), self.name[heads])
        # where a run ends is known from its neighbours
        self.gather(heads, name, self.left[np.maximum(heads - 1, 0)], self.right[np.minimum(ends, len(self.name) - 1)])

    def pairs(self, r: int) -> None:
        if len(self.name) < 2:
            return
        side = (mixed(self.name ^ U(r + 1)) & U(1)).astype(bool)
        opens = side & ~self.barrier
        closes = ~side & ~self.barrier
        joined = np.zeros(len(self.name), bool)  # with the symbol before
        joined[1:] = opens[:-1] & closes[1:]
        heads = np.flatnonzero(~joined)
        ends = np.append(heads[1:], len(self.name))
        two = ends - heads == 2
        name = np.where(two, mixed(mixed(self.name[heads] + P) ^ self.name[ends - 1]), self.name[heads])
        # a lone symbol is known to be so from the neighbour it could have joined
        before, after = np.maximum(heads - 1, 0), np.minimum(ends, len(self.name) - 1)
        left = np.where(two | opens[heads], self.left[heads], self.left[before])
        right = np.where(two, self.right[ends - 1], np.where(opens[heads], self.right[after], self.right[heads]))
        self.gather(heads, name, left, right)


def anchors(parse: Parse, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For windows of width words at starts: whether there is a symbol known from within, and the one with the smallest hash."""
    lo, hi = np.searchsorted(parse.left, starts), np.searchsorted(parse.right, starts + width, side="right")
    has = hi > lo
    key = mixed(parse.name + U(7))
    best = np.zeros(len(starts), np.int64)
    rank = np.zeros(len(starts), np.int64)
    rank[has] = np.log2(hi[has] - lo[has]).astype(np.int64)
    level, k = np.arange(len(key)), 0
    while True:
        at = np.flatnonzero(has & (rank == k))
        if len(at):
            a, b = level[lo[at]], level[hi[at] - (1 << k)]
            best[at] = np.where(key[a] < key[b], a, b)
        if k >= (rank.max() if len(rank) else 0):
            return has, best
        a, b = level[: len(level) - (1 << k)], level[1 << k :]
        level, k = np.where(key[a] < key[b], a, b), k + 1


class Texts:
    """The words of some texts in one sequence with barriers, and hashes of any range of them."""

    def __init__(self, texts: pa.Array):
        h, self.start, self.end, row = word_table(texts)
        self.count = np.bincount(row, minlength=len(texts))
        self.base = np.concatenate([[0], np.cumsum(self.count + 1)])[:-1] + 1  # of a text's first word; barriers stand around it
        n = len(h) + len(texts) + 1
        self.words, self.barrier = np.zeros(n, U), np.ones(n, bool)
        at = np.arange(len(h)) + row + 1
        self.words[at], self.barrier[at] = h, False
        self.row = np.concatenate([[0], np.repeat(np.arange(len(texts)), self.count + 1)])
        self.sums = np.concatenate([np.zeros(1, U), np.cumsum(self.words * powers(P, n), dtype=np.uint64)])
        self.back = powers(INVERSE, n + 1)

    def hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mixed((self.sums[b] - self.sums[a]) * self.back[a])

    def windows(self, width: int) -> np.ndarray:
        left = np.repeat(self.base + self.count, self.count + 1) - np.arange(1, len(self.words))  # words from here to the text's end
        return np.flatnonzero(left >= width) + 1


def blocks(t: Texts, width: int, rounds: int) -> tuple[np.ndarray, ...]:
    """Of each block: row, anchor, block (hashes), first and last start of its windows (words from 0 in the text)."""
    starts = t.windows(width)
    parse = Parse(t.words, t.barrier, rounds)
    has, best = anchors(parse, starts, width)
    mark = np.where(has, best, -1)
    new = np.ones(len(starts), bool)
    new[1:] = (starts[1:] != starts[:-1] + 1) | (mark[1:] != mark[:-1]) | ~has[1:]
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(starts)) - 1 if len(heads) else heads
    a, b, own = starts[heads], starts[tails], has[heads]
    text = t.hashes(a, b + width)
    name = np.where(own, parse.name[best[heads]] if len(heads) else 0, U(0))
    # where the anchor stands in the block is part of what the block is
    inside = np.where(own, parse.first[best[heads]] - a if len(heads) else 0, 0)
    anchor = np.where(own, mixed(name ^ P), text)
    block = mixed(text + inside.astype(np.uint64) * P + (b - a).astype(np.uint64))
    row = t.row[a]
    return row, anchor.view(np.int64), block.view(np.int64), a - t.base[row], b - t.base[row], inside


def all_blocks(texts: pa.Array, width: int, rounds: int, most: int = PART_BYTES) -> Iterator[tuple[np.ndarray, ...]]:
    """blocks() of texts; a text of more than ``most`` bytes by itself, in pieces that overlap by a window less a word.

    What a window's symbols are is known from within it, so the piece that it is looked at in makes no difference; blocks of
    copies that are cut at different words differ, and their windows are looked at one by one.
    """
    if len(texts) != 1 or len(raw := texts[0].as_py().encode()) <= most:
        yield blocks(Texts(texts), width, rounds)
        return
    at, words, size = 0, 0, most
    while True:
        end = min(at + size, len(raw))
        while end < len(raw) and raw[end] not in SPACES:  # a word isn't cut
            end += 1
        t = Texts(pa.array([raw[at:end]], pa.binary()).cast(pa.string()))
        if end < len(raw) and len(t.start) < 2 * width:  # very long words: the next piece would begin where this one did
            size *= 2
            continue
        row, anchor, block, first, last, inside = blocks(t, width, rounds)
        yield row, anchor, block, first + words, last + words, inside
        if end == len(raw):
            return
        new = len(t.start) - width + 1
        words, at, size = words + new, at + (int(t.start[new]) if width > 1 else end - at), most


def removed(texts: pa.Array, spans: list[list[tuple[int, int]]]) -> tuple[np.ndarray, list[int], list[str]]:
    """Number of words, number removed and hash of the words that are left, of each text. spans: ranges of words to remove."""
    raw = [x.as_py().encode().split() for x in texts]
    counts, gone, kept = np.array([len(w) for w in raw]), [], []
    for words, ranges in zip(raw, spans):
        if ranges:
            mark = np.zeros(len(words) + 1, np.int64)
            np.add.at(mark, [a for a, _ in ranges], 1)
            np.add.at(mark, [b for _, b in ranges], -1)
            stay = np.cumsum(mark)[:-1] == 0
            words = [words[i] for i in np.flatnonzero(stay)]
            gone.append(int(len(stay) - len(words)))
        else:
            gone.append(0)
        kept.append(b" ".join(words).decode())
    return counts, gone, kept


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, rounds: int = ROUNDS, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, text: the words left with a space between. A row per input row.

    Rows are told apart by a number given on reading them. The table of blocks has about a tenth as many rows as there are
    words; it is counted by anchor with partial sums, and joined as a table, so that Spark splits skewed anchors. Texts are
    joined twice by row: those with blocks that differ under one anchor, to hash their windows; and all, to cut them.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = cut(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "texts")
    kind = base.schema["doc_id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 1):
            for row, anchor, block, first, last, inside in all_blocks(b.column(1), width, rounds):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), *map(pa.array, (anchor, block)), *(pa.array(x.astype(np.int32)) for x in (first, last, inside))], ["row", "anchor", "block", "first", "last", "inside"])

    group = min(GROUP, width)

    def listed(b: pa.RecordBatch) -> tuple[Texts, np.ndarray, list[np.ndarray]]:
        """Texts; of each range of windows in the list that came with a text: its row in the batch, anchor, n, first, last, at."""
        return Texts(b.column(1)), np.repeat(np.arange(len(b)), b.column(2).value_lengths().to_numpy(zero_copy_only=False)), [b.column(2).flatten().field(i).to_numpy().astype(np.int64) for i in range(5)]

    def repeated(a: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each of a's indices n times, and the numbers from 0 within them."""
        which = np.repeat(np.arange(len(a)), n)
        return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)

    def cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 1):
            t, of, (anchor, n, first, last, at) = listed(b)
            low, high = (at - last) // group, (at - first) // group
            which, k = repeated(low, high - low + 1)
            g, of, p = low[which] + k, of[which], at[which]
            a = np.maximum(first[which], p - g * group - group + 1)
            z = np.minimum(last[which], p - g * group)
            core = t.hashes(p - g * group + t.base[of], p - g * group - group + 1 + width + t.base[of])
            cols = [b.column(0).take(pa.array(of)), pa.array(anchor[which]), *(pa.array(x.astype(np.int32)) for x in (g, a, z, p)), pa.array(core.view(np.int64)), pa.array(n[which])]
            yield pa.RecordBatch.from_arrays(cols, ["row", "anchor", "g", "first", "last", "at", "core", "n"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 1):
            t, of, (anchor, n, first, last, at) = listed(b)
            which, k = repeated(first, last - first + 1)
            start, of = first[which] + k, of[which]
            key = mixed(anchor[which].view(np.uint64) + (at[which] - start).astype(np.uint64) * P)
            window = t.hashes(start + t.base[of], start + t.base[of] + width)
            for a in range(0, len(start), 100_000):
                s = slice(a, a + 100_000)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of[s])), pa.array(key[s].view(np.int64)), pa.array(window[s].view(np.int64)), pa.array(n[which[s]]), pa.array(start[s].astype(np.int32))], ["row", "key", "window", "n", "start"])

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 2):
            spans = [[(x["a"], x["b"]) for x in s or ()] for s in b.column(3).to_pylist()]
            n, gone, kept = removed(b.column(2), spans)
            cols = [b.column(1), pa.array(n.astype(np.int64)), pa.array(gone, pa.int64()), pa.array([hashlib.sha256(k.encode()).hexdigest() for k in kept]), pa.array(kept if texts else [None] * len(kept), pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_removed", "kept_sha256", "text"])

    table = cut(base.select("row", "text").mapInArrow(find, "row long, anchor long, block long, first int, last int, inside int"), "blocks")
    stats = table.groupBy("anchor").agg(F.count("*").alias("n"), (F.min("block") != F.max("block")).alias("differ")).where("n > 1")
    stats = cut(stats.select("anchor", "differ"), "anchors")
    discard(spark)
    shared = cut(table.join(stats, "anchor"), "shared")
    discard(spark, table, stats)
    span = lambda a, b: F.struct(F.col(a).alias("a"), (F.col(b) + width).alias("b")).alias("s")
    alike = shared.where("not differ").select("row", span("first", "last"))
    # each different block once, at its first place, with its number of copies
    pick = F.min(F.struct("row", "first", "last", "inside")).alias("x")
    kinds = cut(shared.where("differ").groupBy("anchor", "block").agg(F.count("*").alias("n"), pick), "kinds")
    copied = shared.where("differ").join(kinds.where("n > 1").select("anchor", "block"), ["anchor", "block"], "left_semi").select("row", span("first", "last"))
    # both steps bring ranges of windows to their texts as lists by row
    listing = F.collect_list(F.struct("anchor", "n", "first", "last", "at")).alias("k")
    with_texts = lambda ranges: base.select("row", "text").join(ranges.groupBy("row").agg(listing), "row")
    ranges = kinds.select("anchor", "n", "x.row", "x.first", "x.last", (F.col("x.first") + F.col("x.inside")).alias("at"))
    groups = cut(with_texts(ranges).mapInArrow(cores, "row long, anchor long, g int, first int, last int, at int, core long, n long"), "groups")
    discard(spark)
    twice = cut(groups.groupBy("anchor", "g", "core").agg(F.sum("n").alias("m")).where("m > 1").drop("m"), "cores")
    discard(spark)
    left = cut(groups.join(twice, ["anchor", "g", "core"], "left_semi").select("row", "anchor", "n", "first", "last", "at"), "left")
    discard(spark, groups, twice)
    rows = cut(with_texts(left).mapInArrow(hashed, "row long, key long, window long, n long, start int"), "windows")
    discard(spark, left)
    again = cut(rows.groupBy("key", "window").agg(F.sum("n").alias("n")).where("n > 1").select("key", "window"), "repeated")
    discard(spark)
    single = rows.where("n = 1").join(again, ["key", "window"], "left_semi").select("row", span("start", "start"))
    spans = cut(alike.unionByName(copied).unionByName(single).groupBy("row").agg(F.collect_list("s").alias("s")), "spans")
    discard(spark, rows, again, shared, kinds)
    done = base.join(spans, "row", "left").select("row", "doc_id", "text", "s").mapInArrow(strip, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, text string")
    return done if texts else done.drop("text")

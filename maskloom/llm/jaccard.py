"""N-gram Jaccard join with adaptive multi-match prefixes (after AdaptJoin, Wang, Li and Feng, 2012).

A document's set is its distinct shingles. Sets are ordered by how frequent a shingle's bucket is in the whole corpus (a fixed
number of buckets, summed up over all documents; any order gives right results), then by hash. If two sets overlap enough to
link, their prefixes of n - least overlap + l shingles share at least l. A set takes the l whose estimated cost is smallest:
longer prefixes mean more postings, but a candidate must then share as many of them before it is verified.

Equal sets are one node. In a group of near copies all pairs would be candidates, though a few links connect them; so nodes
that share a prefix shingle are first verified against one of them, the pivot, and linked ones become one component. The first
pivot is the most central node, whose prefix holds the most frequent shingles; those of later rounds are the most central nodes
outside the largest component. Then every pair of nodes of different components that shares enough prefix shingles is verified:
what is left out can't change the components. Per shingle these pairs are made from the nodes outside its largest component, so
a large component adds no pairs; nodes of a frequent shingle meet by class of size, so that it doesn't bring together sets too unlike
in size to link.

Before texts are fetched, candidates are held against sketches: a bit for each hash value, the parity of the set's shingles that
have it. Each shingle in one set alone changes one bit, so more unequal bits than a link allows rule the pair out for certain.

Shingles are told apart by 64-bit hashes, sets by 128 bits. Null and empty texts have no set and are linked with nothing: their
component is their own id. Each input row gives a row; of repeated rows, and of rows with one id, each is a node's copy. Null ids
count as largest where the smallest id of a component is taken. An empty table gives an empty one. Other columns are ignored or
carried in ``whole``, whatever their names. Texts are worked on some PART_BYTES at a time; of a longer one all shingles are held,
some 100 bytes for each word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import cut, discard, parts, small_batches
from .substrings import P, U, word_table
from .winnowing import mixed

BUCKETS = 1 << 16
#: Estimated cost of verifying a candidate, in postings; the longest multi-match.
VERIFY, MOST_MATCHES = 8.0, 4
#: Rounds against pivots before all candidates between components are verified.
PIVOT_ROUNDS = 2
#: Words of 64 bits of the short sketch that goes with postings, so that a join of postings already leaves most pairs out.
WORDS = 4
#: Nodes of a shingle above which they are dealt out by size in the last join.
FREQUENT = 256
#: The most bits of the filter by which texts are fetched: 2 MB. With more candidates it lets more rows through, to the join.
FILTER_BITS = 1 << 24


def sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct hashes of the k-word shingles of each text."""
    h, _, _, row = word_table(texts, fold=True)
    counts = np.bincount(row, minlength=len(texts))
    ends = np.cumsum(counts)
    gram = np.zeros(max(len(h) - k + 1, 0), U)
    for j in range(k):
        gram = mixed(gram * P + h[j : len(h) - k + 1 + j]) if len(gram) else gram
    out = []
    for a, b in zip(ends - counts, ends):
        if b - a >= k:
            out.append(np.unique(gram[a : b - k + 1]))
        elif b > a:  # too few words: all of them as one, told apart from shingles by their number
            whole = np.zeros(1, U)
            for x in h[a:b]:
                whole = mixed(whole * P + x)
            out.append(mixed(whole + U(b - a)))
        else:
            out.append(np.zeros(0, U))
    return out


def least_overlap(n: int, num: int, den: int) -> int:
    return -(-num * n // den)


def prefix(s: np.ndarray, frequency: np.ndarray, mean: float, num: int, den: int) -> tuple[np.ndarray, int]:
    """The shingles of the prefix and the number that a partner must share."""
    weight = frequency[(s % U(BUCKETS)).astype(np.int64)]
    order = np.lexsort((s, weight))
    base = len(s) - least_overlap(len(s), num, den)
    most = min(MOST_MATCHES, len(s) - base)
    extra = np.maximum(weight[order[: base + most]] - 1 - mean - 3 * np.sqrt(mean), 0)
    total = np.cumsum(1 + extra)
    cost = [total[base + l - 1] + VERIFY * (total[base + l - 1] - (base + l)) / l for l in range(1, most + 1)]
    best = int(np.argmin(cost)) + 1
    return s[order[: base + best]], best


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if min(len(a), len(b)) * den < max(len(a), len(b)) * num:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and den * both >= num * (len(a) + len(b) - both)


def sketch(s: np.ndarray) -> bytes:
    """Parities of the set's hashes by their low bits: two to four bits a shingle, and a power of two of them."""
    bits = 1 << max(6, (2 * max(len(s), 1) - 1).bit_length())
    odd = np.bincount(((s >> U(20)) & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def short_sketch(s: np.ndarray) -> list[int]:
    """Parities of the set's hashes by their high bits, as WORDS integers."""
    odd = np.bincount((s >> U(64 - (64 * WORDS - 1).bit_length())).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def may_link(a: bytes, b: bytes, na: int, nb: int, num: int, den: int) -> bool:
    """Whether the sketches of two sets leave it open that they link. The longer one is folded: bit i onto i less half."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum()) <= na + nb - 2 * -(-(na + nb) * num // (num + den))


def described(base: DataFrame, k: int) -> DataFrame:
    """row, n, k1, k2 of every text; and of every partition a row with counts: how many shingles fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for b in parts(batches, 1):
            found = sets(b.column(1), k)
            if found:
                every = np.concatenate(found)
                counts += np.bincount((every % U(BUCKETS)).astype(np.int64), minlength=BUCKETS)
            keys = [np.array([mixed(s ^ U(c)).sum(dtype=np.uint64) if len(s) else 0 for s in found], np.uint64).view(np.int64) for c in (1, 2)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in found], pa.int64()), *map(pa.array, keys), pa.nulls(len(found), pa.binary())], ["row", "n", "k1", "k2", "counts"])
        none = pa.nulls(1, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array([counts.tobytes()], pa.binary())], ["row", "n", "k1", "k2", "counts"])

    return cut(base.select("row", "text").mapInArrow(run, "row long, n long, k1 long, k2 long, counts binary"), "sets")


def summed(counts: DataFrame, size: int) -> np.ndarray:
    """The sum of arrays of size counts (long), in a tree: a task adds up some 64 of them. The result has a fixed size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for x in b.column(0):
                total += np.frombuffer(x.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    while (n := counts.count()) > 64:
        counts = cut(counts.repartition(-(-n // 64)).mapInArrow(add, "counts binary"), "counts")
    return sum((np.frombuffer(r["counts"], np.int64) for r in counts.collect()), np.zeros(size, np.int64))


def places(rows: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(rows.astype(np.int64).view(U)) & U(bits - 1)).astype(np.int64)


def row_filter(rows: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """A bit for each hash value of the column row, as bytes, and the number of bits. Rows it passes may be others."""
    bits = min(FILTER_BITS, 1 << max(16, (16 * n).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(bits, bool)
        for b in batches:
            seen[places(b.column(0).to_numpy(), bits)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(seen).tobytes()], pa.binary())], ["bits"])

    def either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(bits // 8, np.uint8)
        for b in batches:
            for x in b.column(0):
                seen |= np.frombuffer(x.as_py(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([seen.tobytes()], pa.binary())], ["bits"])

    found = cut(rows.select("row").mapInArrow(mark, "bits binary"), "filter")
    while (parts := found.count()) > 16:
        found = cut(found.repartition(-(-parts // 16)).mapInArrow(either, "bits binary"), "filter")
    out = np.zeros(bits // 8, np.uint8)
    for r in found.collect():
        out |= np.frombuffer(r["bits"], np.uint8)
    return out, bits


def verified(pairs: DataFrame, base: DataFrame, nodes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs that link, of pairs (a, b: nodes, which are rows of base) with a row for each prefix shingle they share.

    Texts are joined to the pairs that counts and sketches leave open; no more than two are held at a time.
    """

    def open_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(i).to_pylist() for i in range(2, 6)))
            keep = pa.array([may_link(x, y, na, nb, num, den) for x, y, na, nb in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (c for half in parts(batches, 2) for c in parts(iter([half]), 3)):
            first, other = sets(b.column(2), k), sets(b.column(3), k)
            keep = [i for i, (x, y) in enumerate(zip(first, other)) if linked(x, y, num, den)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int32())), b.column(1).take(pa.array(keep, pa.int32()))], ["a", "b"])

    # the joins are merges at every size: neither candidates nor their texts have a bound
    known = lambda x: nodes.select(F.col("node").alias(x), F.col("sketch").alias(f"s{x}"), F.col("n").alias(f"n{x}"), F.col("need").alias(f"m{x}")).hint("merge")
    wide = pairs.groupBy("a", "b").agg(F.count("*").alias("c")).join(known("a"), "a").join(known("b"), "b").where(enough(num, den)).select("a", "b", "sa", "sb", "na", "nb")
    pairs = cut(wide.mapInArrow(open_pairs, "a long, b long"), "pairs")
    discard(base.sparkSession)
    rows = pairs.select(F.explode(F.array("a", "b")).alias("row"))
    bits, size = row_filter(rows, 2 * pairs.count())

    @F.pandas_udf("boolean")
    def wanted(row: pd.Series) -> pd.Series:
        at = places(row.to_numpy(), size)
        return pd.Series((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1)

    text = cut(base.select("row", "text").where(wanted("row")), "candidates")
    one = pairs.join(text.withColumnsRenamed({"row": "a", "text": "text_a"}).hint("merge"), "a")
    two = one.join(text.withColumnsRenamed({"row": "b", "text": "text_b"}).hint("merge"), "b").select("a", "b", "text_a", "text_b")
    links = cut(two.mapInArrow(run, "a long, b long"), "links")
    discard(base.sparkSession, pairs, text)
    return links


def enough(num: int, den: int) -> Column:
    """Whether nodes of sizes na and nb and needs ma and mb share enough prefix shingles (c) to link.

    What two sets share stands in both prefixes or in the suffix of the one whose prefix ends first. A suffix has the least
    overlap less the need, so the overlap that linking takes, less the longer suffix, must be shared within the prefixes.
    """
    ceil = lambda x, y: F.expr(f"({x} + {y} - 1) div {y}")
    both = ceil(f"(na + nb) * {num}", num + den)
    suffix = lambda n, m: ceil(f"{n} * {num}", den) - F.col(m)
    return (F.col("c") >= F.least("ma", "mb")) & (F.col("c") >= both - F.greatest(suffix("na", "ma"), suffix("nb", "mb")))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id that links reach), row, least_row (the first row of the component's
    smallest id), one row per input row; row numbers the input's rows and goes with ``place`` of numbered(docs)."""
    return joined(numbered(docs, id_col, text_col), k, num, den)


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """row: a number; doc_id, text; and with carry whole: a struct of all input columns, which the others are read from."""
    small_batches(docs.sparkSession)
    number = F.monotonically_increasing_id().alias("row")
    if carry:
        table = cut(docs.select(number, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")), "texts")
        of = lambda c: F.col("whole").getField(c)
        return table.select("row", of(id_col).alias("doc_id"), F.coalesce(of(text_col), F.lit("")).alias("text"), "whole")
    return cut(docs.select(number, F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "texts")


def joined(base: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """As join(), over what numbered() gives."""
    found = described(base, k)
    frequency = summed(found.where("counts is not null").select("counts"), BUCKETS)
    mean = float(frequency.mean())
    own = found.where("row is not null").drop("counts")
    # equal sets are one node, named by its smallest row
    names = cut(own.where("n > 0").groupBy("k1", "k2").agg(F.min("row").alias("node")).select("node"), "names")

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 1):
            every = sets(b.column(1), k)
            keep = [i for i, s in enumerate(every) if len(s)]
            out = [prefix(every[i], frequency, mean, num, den) for i in keep]
            tokens = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(p) for p, _ in out)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, U), *(p for p, _ in out)]).view(np.int64)))
            cols = [b.column(0).take(pa.array(keep, pa.int32())), pa.array([len(every[i]) for i in keep], pa.int64()), pa.array([m for _, m in out], pa.int32()), tokens, pa.array([sketch(every[i]) for i in keep], pa.binary()), pa.array([short_sketch(every[i]) for i in keep], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["node", "n", "need", "tokens", "sketch", "short"])

    # prefixes of all texts, copies too: they are a fraction of the texts that would be dealt out otherwise
    each = base.select("row", "text").mapInArrow(prefixes, "node long, n long, need int, tokens array<long>, sketch binary, short array<long>")
    nodes = cut(each.join(names.hint("merge"), "node"), "nodes")
    discard(base.sparkSession)
    tokens = nodes.select(F.explode("tokens").alias("token"), "node")
    several = cut(tokens.groupBy("token").agg(F.count("*").alias("c")).where("c > 1"), "tokens")
    shared = cut(tokens.join(several, "token"), "shared")
    discard(base.sparkSession, several)
    # a node is central if its prefix holds frequent shingles; those that stand in one node alone count as 0
    central = shared.groupBy("node").agg(F.sum(F.log2("c")).alias("sum"))
    words = [F.col("short")[i].alias(f"w{i}") for i in range(WORDS)]
    about = cut(nodes.join(central, "node").select("node", "n", (F.col("sum") / F.size("tokens")).cast("float").alias("central"), *words), "about")
    postings = shared.select("token", "node")

    def labelled(roots: DataFrame | None, *attributes: str) -> DataFrame:
        """Postings with attributes of their nodes, and component."""
        known = about.select("node", "n", *attributes)
        known = known.withColumn("component", F.col("node")) if roots is None else known.join(roots, "node", "left").withColumn("component", F.coalesce("root", "node")).drop("root")
        return cut(postings.join(known, "node"), "labelled")

    def of_largest(now: DataFrame) -> DataFrame:
        """The postings of shingles that stand in several components; largest: the one with most of a shingle's nodes; total: of nodes."""
        sizes = now.groupBy("token", "component").agg(F.count("*").alias("c"))
        largest = sizes.groupBy("token").agg(F.max(F.struct("c", "component")).alias("x"), F.count("*").alias("k"), F.sum("c").alias("total")).where("k > 1").select("token", F.col("x.component").alias("largest"), "total")
        return cut(now.join(largest, "token"), "mixed")

    fits = lambda a, b: F.least(a, b) * den >= F.greatest(a, b) * num
    links, roots = None, None
    for r in range(PIVOT_ROUNDS):
        now = labelled(roots, "central")
        if r:
            before, now = now, of_largest(now)
            discard(base.sparkSession, before)
        mark = F.struct(-F.col("central"), F.xxhash64("node", F.lit(r)), "node", "component", "n")
        outside = now.where("component <> largest") if r else now
        pivots = cut(outside.groupBy("token").agg(F.min(mark).alias("p")).select("token", F.col("p.node").alias("a"), F.col("p.component").alias("c"), F.col("p.n").alias("na")), "pivots")
        pairs = now.join(pivots, "token").where((F.col("component") != F.col("c")) & fits(F.col("n"), F.col("na"))).select("a", F.col("node").alias("b"))
        new = verified(pairs, base, nodes, k, num, den)
        discard(base.sparkSession, pivots, now)
        links = new if links is None else links.unionByName(new)
        roots = cut(components(links), "roots")
    # all candidates between components: of each shingle, nodes outside its largest component against all of its nodes
    short = [f"w{i}" for i in range(WORDS)]
    now = of_largest(labelled(roots, *short))
    side = lambda x: [F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("component").alias(f"c{x}"), *(F.col(w).alias(f"{w}{x}") for w in short)]
    # a frequent shingle's nodes are dealt out by size: sizes that may link are of one class or of neighbours
    size_class, frequent = F.floor(F.log("n") / math.log(den / num * (1 + 1e-9))), F.col("total") > FREQUENT
    classes = F.when(frequent, F.array(size_class - 1, size_class, size_class + 1)).otherwise(F.array(F.lit(0).cast("long")))
    outside = now.where("component <> largest").select("token", F.explode(classes).alias("class"), *side("a"))
    inside = now.select("token", F.when(frequent, size_class).otherwise(0).alias("class"), *side("b"), (F.col("component") == F.col("largest")).alias("big"))
    apart = sum((F.bit_count(F.col(f"{w}a").bitwiseXOR(F.col(f"{w}b"))) for w in short), F.lit(0))
    near = apart <= F.col("na") + F.col("nb") - 2 * F.expr(f"((na + nb) * {num} + {num + den - 1}) div {num + den}")
    both = outside.join(inside, (outside["token"] == inside["token"]) & (outside["class"] == inside["class"]) & (F.col("ca") != F.col("cb")) & (F.col("big") | (F.col("a") < F.col("b"))) & fits(F.col("na"), F.col("nb")) & near)
    pairs = both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = links.unionByName(verified(pairs, base, nodes, k, num, den))
    discard(base.sparkSession, now)
    roots = cut(components(links), "roots")

    # the smallest id of each component: of equal rows, of equal sets, of linked sets
    known = own.join(base.select("row", "doc_id"), "row")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least")
    by_set = cut(known.where("n > 0").groupBy("k1", "k2").agg(F.min("row").alias("node"), least), "by-set").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    by_root = by_set.groupBy("root").agg(F.min("least").alias("least"))
    by_set = cut(by_set.drop("least").join(by_root, "root").select("k1", "k2", "least"), "components")
    alone = F.col("n") == 0
    done = known.join(by_set, ["k1", "k2"], "left")
    return done.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"), "row", F.when(alone, F.col("row")).otherwise(F.col("least.row")).alias("least_row"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs with one of each component: the first row of its smallest id. Texts without words all stay. An empty table gives an empty one."""
    base = numbered(docs, id_col, text_col, carry=True)
    stay = cut(joined(base.drop("whole"), k, num, den).where("row = least_row").select("row"), "stay")
    return base.select("row", "whole").join(stay, "row", "left_semi").select("whole.*")

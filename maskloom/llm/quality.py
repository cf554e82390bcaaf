"""Quality rules: of each text, of its host, and of the host's verdict on the text.

Measures come from one pass over a text. Rules on them fail or pass a text; failures are summed up by host. A host's rate of
failures is drawn towards that of all hosts by a beta prior fitted to them by moments, so that a host of few texts isn't
judged by chance. A host is bad if its drawn rate, less SURE standard deviations of its posterior, is above APART times the
mean of all hosts, and good if the rate, and SURE deviations more, is below the mean divided by APART.

A text is rejected when a base rule fails. How many of the other rules may fail hangs on the host: one of them rejects a text
of a bad host, two reject a text of any other, and it takes three for a good host. So a text that fails no rule is kept
whatever its host.

A null text counts as empty, and fails for having few words; a null host counts as the host ''. Each input row gives a row, and
repeated rows count as often as they stand. Texts of any length are measured whole; a text's words are held in memory at once.
An empty table gives an empty one. Other columns are carried in ``row``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, cut, let

SYMBOLS = "#*$%&|<>"
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
#: Other rules: mean word length, symbols a word, share of repeated lines (%).
SHORTEST, LONGEST, MOST_SYMBOLS, MOST_LINES = 2, 16, 10, 30
#: How far a host's rate must be from the mean to tell it apart: as a factor, and in standard deviations of its posterior.
APART, SURE = 1.5, 2.0
#: How many of the other rules a text may fail on a host that isn't told apart.
DEFAULT = 1
#: So many hosts that are told apart may be broadcast (a host name has some 50 bytes: 3 MB).
FEW = 50_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def repeated_words(words: Column, k: int = WINDOW) -> Column:
    """Words in k-word windows that stand twice or more in the array. Windows are told apart by 64-bit hashes."""

    def count(hashes: Column) -> Column:
        def covered(at: Column) -> Column:
            steps = F.transform(at, lambda p, j: F.least(F.lit(k), F.coalesce(F.get(at, j + 1) - p, F.lit(k))))
            return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

        def twice(order: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(order, j)["h"] == x["h"], F.lit(False))
            at = F.transform(order, lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"]))
            return let(F.array_sort(F.filter(at, lambda p: p.isNotNull())), covered)

        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(F.array_sort(pairs), twice))

    def windows(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - k)
        return F.when(F.size(h) < k, F.lit(0)).otherwise(let(F.transform(starts, lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(k)))), count))

    return let(F.transform(words, lambda w: F.xxhash64(w)), windows)


def measures(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words (all long)."""

    def of(t: Column) -> Column:
        bare = F.translate(t, SYMBOLS, "")
        lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))

        def counted(words: Column, lines: Column) -> Column:
            chars = F.length(F.regexp_replace(t, f"[{SPACE}]+", ""))
            parts = {"n_words": F.size(words), "word_chars": chars, "n_symbols": F.length(t) - F.length(bare), "n_lines": F.size(lines), "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)), "n_repeat_words": repeated_words(words)}
            return F.struct(*(c.cast("long").alias(n) for n, c in parts.items()))

        return let(words_of(t), lambda w: let(lines, lambda x: counted(w, x)))

    return let(F.coalesce(text, F.lit("")), of)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED * m["n_words"])


def others_failed(m: Column) -> Column:
    """How many of the other rules fail."""
    length = (m["word_chars"] < SHORTEST * m["n_words"]) | (m["word_chars"] > LONGEST * m["n_words"])
    symbols = MOST_SYMBOLS * m["n_symbols"] > m["n_words"]
    lines = 100 * m["n_dup_lines"] > MOST_LINES * m["n_lines"]
    return length.cast("int") + symbols.cast("int") + lines.cast("int")


def judged_hosts(judged: DataFrame) -> DataFrame:
    """judged: host, failed. host and allowed: how many of the other rules a text may fail; hosts other than DEFAULT alone."""
    hosts = cut(judged.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("bad")), "hosts")
    rate = F.col("bad") / F.col("n")
    moments = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v")).first()
    mean = moments["m"] or 0.0
    alpha, beta = prior(mean, moments["v"])
    drawn = hosts.select("host", ((F.col("bad") + alpha) / (F.col("n") + alpha + beta)).alias("r"), (F.col("n") + alpha + beta + 1).alias("size"))
    sd = F.sqrt(F.col("r") * (1 - F.col("r")) / F.col("size"))
    allowed = F.when(F.col("r") - SURE * sd > APART * mean, 0).when((F.col("r") + SURE * sd) * APART < mean, 2)
    return cut(drawn.select("host", allowed.alias("allowed")).where("allowed is not null"), "judged-hosts")


def prior(mean: float | None, variance: float | None) -> tuple[float, float]:
    """alpha and beta by moments, their sum between 1 and 1000; a uniform prior where all hosts are alike or there are none."""
    if not mean or mean >= 1:
        return 1.0, 1.0
    size = min(1000.0, max(1.0, mean * (1 - mean) / variance - 1)) if variance else 1000.0
    return mean * size, (1 - mean) * size


def judge(docs: DataFrame, host_col: str = "source", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """row: a struct of the columns to carry (all of the input's); m: measures; base_failed; kept. Measures are made once, into a table."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if carry is None or c in carry)).alias("row")
    base = docs.select(row, F.coalesce(F.col(host_col), F.lit("")).alias("host"), measures(F.col(text_col)).alias("m"))
    judged = cut(base.withColumn("base_failed", base_failed(F.col("m"))).withColumn("others", others_failed(F.col("m"))), "measures")
    hosts = judged_hosts(judged.select("host", (F.col("base_failed") | (F.col("others") > 0)).alias("failed")))
    few = hosts.limit(FEW + 1).count() <= FEW
    joined = judged.join(F.broadcast(hosts) if few else hosts, "host", "left")
    reject = F.col("base_failed") | (F.col("others") > F.coalesce("allowed", F.lit(DEFAULT)))
    return joined.select("row", "m", "base_failed", (~reject).alias("kept"))


def kept_documents(docs: DataFrame, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of docs that aren't rejected, all columns."""
    return judge(docs, host_col, text_col).where("kept").select("row.*")

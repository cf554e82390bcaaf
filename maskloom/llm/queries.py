"""The queries of these operators, each over its whole table, and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, jaccard, licenses, lines, packing, quality, secrets, substrings, warc, winnowing
from .shared import documents

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PACKED = public_tokenizers.path("byte_bpe_50k.json")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir)).drop("places")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(documents(spark, sf_dir), carry=["doc_id"])
    return judged.select("row.doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", "base_failed", "kept")


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda field: F.array_join(F.transform("all", lambda s: s[field].cast("string")), ",").alias(field)
    digest = F.sha2(secrets.as_text(F.col("base")), 256).alias("base_sha256")
    spans = secrets.as_text(F.col("all")).alias("spans")
    return found.select("doc_id", *map(count, secrets.KINDS[: secrets.BASE_KINDS]), digest, spans, "n_live", "n_copied", listed("n_repos"), listed("n_owners"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(documents(spark, sf_dir), texts=False)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.decode(bpe.encode(documents(spark, sf_dir), RANKS, public_tokenizers.PATTERN), RANKS)
    return done.select("doc_id", F.expr("length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.with_next(documents(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), PACKED, public_tokenizers.PATTERN)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


_ALL = (op1_licenses, op2_quality, op3_lines, op4_substrings, op8_secrets, op5_bpe, op6_winnowing, op7_packing, op9_jaccard, op10_warc)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

#: White space that ends a word, as a class of DuckDB's patterns.
_SPACE = r"[\x20\x09-\x0D]"


def _listed(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _licence_sql() -> str:
    """Every alignment of every base phrase, and every band of every passage whose words a text has enough of."""
    rows = ", ".join(f"('{label}', {_listed(words)}, {_listed(phrases)}, {str(base).lower()})" for label, words, phrases, base in licenses.templates())
    width, least = 2 * licenses.SHIFT, licenses.LEAST_SCORE
    split = "regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '" + licenses.NOT_WORD + "')"
    return rf"""
with t(label, words, phrases, base) as (values {rows}),
d as (select doc_id, list_filter({split}, lambda x: x <> '') as w from documents),
exact as (select doc_id, label, i - 1 as s, 1.0::double as score from d, t, unnest(generate_series(1, len(w) - len(words) + 1)) as u(i) where base and w[i:i + len(words) - 1] = words),
pairs as (select doc_id, w, label, words, phrases from d, t where not base and 100 * len(list_filter(words, lambda x: list_contains(w, x))) >= {least} * len(words)),
bands as (select *, s from pairs, unnest(generate_series(-4 * ((len(words) + {width}) // 4 + 1), len(w), {licenses.SHIFT})) as u(s)),
held as (select *, len(list_filter(generate_series(1, len(words)), lambda q: list_contains(w[greatest(s + q - 1, 0) + 1:greatest(s + q - 1 + {width}, 0)], words[q]))) as n,
                ' ' || array_to_string(w[greatest(s, 0) + 1:s + len(words) + {width}], ' ') || ' ' as around from bands),
near as (select doc_id, label, n / len(words) as score from held where 100 * n >= {least} * len(words) and len(list_filter(phrases, lambda p: not contains(around, ' ' || p || ' '))) = 0),
b as (select doc_id, count(*) as n, min(s) as first, max(s) as last, string_agg(distinct label, ',' order by label) as labels from exact group by doc_id),
a as (select doc_id, string_agg(distinct label, ',' order by label) as labels, max(score) as score from (select doc_id, label, score from exact union all select * from near) group by doc_id)
select doc_id, len(w) as n_words, coalesce(b.n, 0) as n_base, first as first_word, last as last_word, coalesce(b.labels, '') as base_labels, coalesce(a.labels, '') as labels, coalesce(a.score, 0) as score
from d left join b using (doc_id) left join a using (doc_id)
"""


def _secret_sql() -> str:
    """Matches of each kind with their places, the owners and repositories of each value, and what they say of it."""
    patterns = (secrets.ASSIGN, secrets.ACCESS, secrets.HEX, secrets.URL, secrets.KEY, secrets.JWT, secrets.PEM, secrets.MIXED)
    rules = {"assign": f"length(value) >= {secrets.LEAST_VALUE}", "mixed": " and ".join(f"regexp_matches(value, '{c}')" for c in ("[0-9]", "[A-Z]", "[a-z]"))}
    parts = []
    for kind, pattern in zip(secrets.KINDS, patterns):
        rule = rules.get(kind, "true")
        rx = pattern.replace("'", "''")
        value = f"regexp_extract(found, '{rx}', 2)" if kind == "assign" else "found"
        parts.append(rf"""
m_{kind} as (select doc_id, owner, regexp_extract_all(text, '{rx}') as m, regexp_split_to_array(text, '{rx}') as g from d where regexp_matches(text, '{rx}')),
e_{kind} as (select doc_id, owner, m[i] as found, list_sum(list_transform(g[1:i], lambda x: length(x)))::bigint + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0)::bigint as s from m_{kind}, unnest(generate_series(1, len(m))) as u(i)),
s_{kind} as (select * from (select doc_id, owner, '{kind}' as kind, {secrets.KINDS.index(kind)} as rank, s, s + length(found) as e, {value} as value from e_{kind}) where {rule})""")
    every = " union all ".join(f"select * from s_{kind}" for kind in secrets.KINDS)
    count = lambda kind: f"count(*) filter (where kind = '{kind}') as n_{kind}"
    shown = lambda what, rule: f"coalesce(string_agg({what}, ',' order by s, rank, e) filter (where {rule}), '')"
    place = "kind || ':' || s || ':' || e"
    return rf"""
with d as (select doc_id, coalesce(source, '') as owner, coalesce(text, '') as text from documents),{",".join(parts)},
every as ({every}),
o as (select kind, value, count(distinct owner) as n_owners, count(distinct (owner, doc_id)) as n_repos from every group by all),
j as (select *, n_owners < {secrets.WIDE} and (n_owners = 1 or n_repos < {secrets.SPREAD}) as live from every join o using (kind, value)),
g as (select doc_id, {count("assign")}, {count("access")}, {count("hex")}, {shown(place, "rank < 3")} as base, {shown(place, "rank < 3 or live")} as spans, count(*) filter (where live) as n_live, count(*) filter (where not live) as n_copied,
             {shown("n_repos::varchar", "rank < 3 or live")} as n_repos, {shown("n_owners::varchar", "rank < 3 or live")} as n_owners from j group by doc_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans,
       coalesce(n_live, 0) as n_live, coalesce(n_copied, 0) as n_copied, coalesce(n_repos, '') as n_repos, coalesce(n_owners, '') as n_owners
from d left join g using (doc_id)
"""


ORACLE_SQL: dict[str, str] = {
    "op1_licenses": _licence_sql(),
    "op8_secrets": _secret_sql(),
    "op9_jaccard": rf"""
with recursive d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, case when len(w) < 3 then w else list_slice(w, i, i + 2) end as g from d, unnest(generate_series(1, greatest(len(w) - 2, 1))) as u(i) where len(w) > 0),
n as (select doc_id, count(*) as n, md5(string_agg(array_to_string(g, ' '), chr(10) order by array_to_string(g, ' '))) as k from s group by doc_id),
r as (select k, min(doc_id) as rep, any_value(n) as n from n group by k),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id
      where a.doc_id in (select rep from r) and b.doc_id in (select rep from r) group by 1, 2),
l as (select a, b from p join r x on x.rep = a join r y on y.rep = b where 100 * c >= 90 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
reach as (select rep as a, rep as b from r union select reach.a, e.b from reach join e on reach.b = e.a),
least as (select a as rep, min(b) as component_id from reach group by a)
select doc_id, coalesce(n.n, 0) as n_shingles, coalesce(component_id, doc_id) as component_id
from d left join n using (doc_id) left join r on r.k = n.k left join least on least.rep = r.rep
""",
    "op4_substrings": rf"""
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}+'), lambda x: x <> '') as w from documents),
win as (select doc_id, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) as k from d, unnest(generate_series(1, len(w) - 34)) as u(i)),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by k) as n from win) where n > 1),
cov as (select distinct doc_id, i + j as pos from rep, unnest(generate_series(0, 34)) as u(j)),
words as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as pos from d),
kept as (select doc_id, count(*) as n, string_agg(word, ' ' order by pos) as text from words anti join cov using (doc_id, pos) group by doc_id)
select doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(text, '')) as kept_sha256
from d left join kept using (doc_id)
""",
    "op2_quality": rf"""
with d as (select doc_id, coalesce(source, '') as host, coalesce(text, '') as text from documents),
w as (select doc_id, host, text, list_filter(regexp_split_to_array(text, '{_SPACE}+'), lambda x: x <> '') as words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '{_SPACE}', '', 'g') <> '') as lines from d),
win as (select doc_id, i, list_slice(words, i, i + 4) as k from w, unnest(generate_series(1, len(words) - 4)) as u(i)),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, k) as n from win) where n > 1),
cov as (select doc_id, count(distinct i + j) as n_repeat_words from rep, unnest([0, 1, 2, 3, 4]) as u(j) group by doc_id),
m as (select doc_id, host, len(words) as n_words, length(regexp_replace(text, '{_SPACE}', '', 'g')) as word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(lines) as n_lines,
             len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
      from w left join cov using (doc_id)),
j as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
             (word_chars < 2 * n_words or word_chars > 16 * n_words)::int + (10 * n_symbols > n_words)::int + (100 * n_dup_lines > 30 * n_lines)::int as others from m),
h as (select host, count(*) as n, sum((base_failed or others > 0)::int) as bad from j group by host),
p as (select avg(bad / n) as a, var_pop(bad / n) as v from h),
s as (select a, case when a = 0 or a >= 1 then null when v = 0 then 1000 else least(1000, greatest(1, a * (1 - a) / v - 1)) end as size from p),
r as (select host, a, n + coalesce(size, 2) + 1 as size, (bad + coalesce(a * size, 1)) / (n + coalesce(size, 2)) as r from h, s),
b as (select host, case when r - 2 * sqrt(r * (1 - r) / size) > 1.5 * a then 0 when (r + 2 * sqrt(r * (1 - r) / size)) * 1.5 < a then 2 else 1 end as allowed from r)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not (base_failed or others > allowed) as kept
from j join b using (host)
""",
    "op3_lines": rf"""
with d as (select doc_id, string_split(text, chr(10)) as l from documents),
w as (select doc_id, i, list_slice(l, i, i + 2) as k from d, unnest(generate_series(1, len(l) - 2)) as u(i)),
r as (select doc_id, i from (select doc_id, i, row_number() over (partition by k order by doc_id, i) as n from w
      where regexp_replace(array_to_string(k, ''), '{_SPACE}', '', 'g') <> '') where n > 1),
c as (select doc_id, list(distinct i + j) as gone from r, unnest([0, 1, 2]) as u(j) group by doc_id)
select doc_id, coalesce(len(l), 0) as n_lines, coalesce(len(gone), 0) as n_removed,
       sha256(coalesce(array_to_string(list_filter(l, lambda x, i: gone is null or not list_contains(gone, i)), chr(10)), '')) as kept_sha256
from d left join c using (doc_id)
""",
    "op10_warc": """
with p as (select page_id, coalesce(html, '') as html, encode(coalesce(html, '')) as payload from pages),
b as (select html, max(page_id) as best from p where octet_length(payload) >= 1000 group by html)
select page_id, octet_length(payload) as payload_bytes, sha1(p.html) as payload_digest,
       case when best is null or best = page_id then 'response' else 'revisit' end as record_type,
       case when best <> page_id then best end as refers_to
from p left join b on p.html = b.html and octet_length(payload) >= 1000
"""
}

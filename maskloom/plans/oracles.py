"""The SQL that gives the same rows as a query, for DuckDB over the same tables."""

from __future__ import annotations

import hashlib

from ..functions.keys import ALPHABET, NAMESPACE
from ..functions.text import ABBREVIATIONS
from ..operators import detect, evaluate
from ..operators.pseudonyms import FAMILY, GIVEN, PLACES, SAFE_DOMAINS, STATES, STREETS, TITLES, TOWNS, WORDS
from . import shapes
from .shapes import number, word

_MARKS = "!#$%&''*+/=?^_`{|}~-"
_EMAIL = rf"[A-Za-z0-9{_MARKS}]+(\.[A-Za-z0-9{_MARKS}]+)*@([A-Za-z0-9]([A-Za-z0-9-]{{0,61}}[A-Za-z0-9])?\.)+[A-Za-z]{{2,63}}"
_INVISIBLE = "chr(160) || chr(8239) || chr(8199) || chr(8220) || chr(8221) || chr(8216) || chr(8217) || chr(8203) || chr(8204) || chr(8205) || chr(65279) || chr(173)"
_NORM = rf"""regexp_replace(translate(nfc_normalize(coalesce(text, '')), {_INVISIBLE}, '   ""'''''), '([A-Za-z])-\r?\n([A-Za-z])', '\1\2', 'g')"""


def positions(source: str, pattern: str, name: str = "p") -> str:
    """CTEs up to one of that name (id, i, text, start, end, found): all matches in source (id, text). Their places are the lengths
    of matches and of what stands between them, summed up."""
    return rf"""
{name}_t as ({source}),
{name}_m as (select *, regexp_extract_all(text, '{pattern}') as m, regexp_split_to_array(text, '{pattern}') as g from {name}_t where regexp_matches(text, '{pattern}')),
{name}_e as (select id, i, text, m[i] as found, list_sum(list_transform(g[1:i], lambda x: length(x)))::bigint + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0)::bigint as start
      from {name}_m, unnest(generate_series(1, len(m))) as u(i)),
{name} as (select id, i, text, start, start + length(found) as "end", found from {name}_e)
"""


_DOCS = "select doc_id as id, coalesce(text, '') as text from documents"


def digest(kind: str, key: str, scope: str, secret: str | None = None) -> str:
    """SQL for the digest of an entity, in hexadecimal digits; with a secret, the HMAC."""
    message = f"('{NAMESPACE}entity' || chr(31) || {kind} || chr(31) || {scope} || chr(31) || lower(regexp_replace(trim({key}), '\\s+', ' ', 'g')))"
    if secret is None:
        return f"sha256({message})"
    key_bytes = secret.encode()
    key_bytes = (hashlib.sha256(key_bytes).digest() if len(key_bytes) > 64 else key_bytes).ljust(64, b"\0")
    pad = lambda x: f"unhex('{bytes(b ^ x for b in key_bytes).hex()}')"
    return f"sha256({pad(0x5C)} || unhex(sha256({pad(0x36)} || {message}::blob)))"


def scope_of(text: str) -> str:
    return f"sha256('{NAMESPACE}scope/' || sha256({text}))"


GLOBAL_SCOPE = f"sha256('{NAMESPACE}scope/GLOBAL')"


def base32(hex_digits: str, length: str) -> str:
    bits = f"array_to_string(list_transform(string_split({hex_digits}, ''), lambda x: lpad(bin(instr('0123456789abcdef', x) - 1), 4, '0')), '')"
    value = " + ".join(f"substr(b, 5 * i + {j + 1}, 1)::int * {16 >> j}" for j in range(5))
    return f"(select array_to_string(list_transform(generate_series(0, {length} - 1), lambda i: substr('{ALPHABET}', 1 + {value}, 1)), '') from (select {bits} as b))"


def draw(seed: str, i: str | int, n: int | str) -> str:
    return f"(('0x' || substr(sha256({seed} || ':' || {i}), 1, 12))::bigint % {n})"


def digits(seed: str, n: str | int, first: int = 0) -> str:
    return f"array_to_string(list_transform(generate_series(1, {n}), lambda i: {draw(seed, f'(i + {first})', 10)}::varchar), '')"


def picked(words: list[str], seed: str, i: int) -> str:
    return f"""(list_value({', '.join(f"'{w}'" for w in words)}))[1 + {draw(seed, i, len(words))}]"""


def titled(word: str) -> str:
    return f"(select upper(w[1]) || lower(w[2:]) from (select {word} as w))"


def luhn(number: str) -> str:
    doubled = f"list_transform(generate_series(1, length({number})), lambda i: case when (length({number}) - i) % 2 = 1 then (2 * substr({number}, i, 1)::int) // 10 + (2 * substr({number}, i, 1)::int) % 10 else substr({number}, i, 1)::int end)"
    return f"list_sum({doubled}) % 10 = 0"


def replaced(texts: str, scope: str | None = None) -> str:
    """CTEs up to a: the e-mail addresses of texts (SQL: id, text) with what they are replaced by, and where. scope: that of all texts."""
    return f"""with {positions(texts, _EMAIL)},
q as (select *, split_part(split_part(found, '@', 1), '+', 1) as base, case when contains(split_part(found, '@', 1), '+') then substr(split_part(found, '@', 1), instr(found, '+')) else '' end as tag from p),
s as (select *, {digest("'EMAIL'", "base", scope or scope_of("text"))} as seed from q),
r as (select *, 'EMAIL' as label, substr({base32("seed", "50")}, 1, greatest(least(length(base), 50), 1)) || tag || '@example.org' as replacement from s),
{_PLACED}
"""


def rebuilt(texts: str, scope: str | None = None) -> str:
    """CTEs up to v: id, text, redacted, and l: the entries of each text in order."""
    return replaced(texts, scope) + _JOINED


#: CTEs: a has the places of r's replacements in the new text; v has the texts of p_t (id, text) with all entries of a put in.
_PLACED = "a as (select *, start + coalesce(sum(length(replacement) - length(found)) over (partition by id order by start rows between unbounded preceding and 1 preceding), 0)::bigint as new_start from r)"
_JOINED = """,
z as (select n.id, any_value(n.text) as text, coalesce(list(struct_pack(s := a.start, e := a."end", n := a.new_start, r := a.replacement, l := a.label) order by a.start) filter (where a.start is not null), []) as l
      from p_t n left join a on a.id = n.id group by n.id),
v as (select id, text, l, array_to_string(list_transform(l, lambda x, i: substr(text, 1 + coalesce(l[i-1].e, 0), x.s - coalesce(l[i-1].e, 0)) || x.r), '') || substr(text, 1 + coalesce(l[-1].e, 0)) as redacted from z)
"""


_NORMALISED = f"select doc_id as id, {_NORM} as text from documents"
_REPLACED, _REBUILT = replaced(_NORMALISED), rebuilt(_NORMALISED)


def poured(source: str, fill: str) -> str:
    """The digits of fill in place of the source's."""
    nth = f"length(regexp_replace(substr({source}, 1, j), '[^0-9]', '', 'g'))"
    return f"array_to_string(list_transform(string_split({source}, ''), lambda c, j: case when regexp_matches(c, '^[0-9]$') then coalesce(nullif(substr({fill}, {nth}, 1), ''), '0') else c end), '')"


def listed(words: list[str]) -> str:
    return "list_value(" + ", ".join(f"'{w}'" for w in words) + ")"


def lettered(source: str, kept: tuple[int, ...]) -> str:
    """Capitals drawn in place of all characters but some."""
    return f"array_to_string(list_transform(string_split({source}, ''), lambda c, j: case when j - 1 in {kept} then c else chr((65 + {draw('seed', '(j - 1)', 26)})::int) end), '')"


def escaped(s: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        s = f"replace({s}, '{a}', '{b}')"
    return s


def marked(text: str, start: str, length: str) -> str:
    """Text with its entries (l of _JOINED) marked; start and length: those of an entry x."""
    of = lambda sql, x: sql.replace("x.", f"{x}.")
    end = lambda x: f"coalesce({of(start, x)} + {of(length, x)}, 0)"
    gap, inside = f"substr({text}, 1 + {end('l[i-1]')}, {start} - {end('l[i-1]')})", f"substr({text}, 1 + {start}, {length})"
    parts = f"array_to_string(list_transform(l, lambda x, i: {escaped(gap)} || '<mark title=\"' || x.l || '\">' || {escaped(inside)} || '</mark>'), '')"
    return f"{parts} || {escaped(f'substr({text}, 1 + ' + end('l[-1]') + ')')}"


def page(text: str, redacted: str) -> str:
    """The page that shows both texts of v side by side."""
    old, new = marked(text, "x.s", "(x.e - x.s)"), marked(redacted, "x.n", "length(x.r)")
    return f"'<!DOCTYPE html><html><body><table><tr><td><pre>' || {old} || '</pre></td><td><pre>' || {new} || '</pre></td></tr></table></body></html>'"


def bare(number: str) -> str:
    return f"regexp_replace({number}, '[^0-9]', '', 'g')"


#: Candidates for bank codes and cards, looked at where no letter or digit clings to them.
_CLEAR = r"""not regexp_matches(substr(text, start, 1), '[\p{L}\p{N}_]') and not regexp_matches(substr(text, "end" + 1, 1), '[\p{L}\p{N}_]')"""
_PHONE = r"(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\)[ .-]?|[2-9][0-9]{2}[ .-]?)[2-9][0-9]{2}[ .-]?[0-9]{4}"
_PHONE_ALONE = r"""not regexp_matches(substr(text, start, 1), '[\p{L}\p{N}_@§/+.-]') and not regexp_matches(substr(text, greatest(start - 2, 0) + 1, least(start, 3)), '[0-9][ .()-]{1,2}$')
  and not regexp_matches(substr(text, "end" + 1, 1), '[\p{L}\p{N}_@-]') and not regexp_matches(substr(text, "end" + 1, 2), '^[ .][0-9]')"""
#: People of documents: two to four words of a capital and small letters, no letter or digit next to them.
def people(docs: str) -> str:
    return positions(docs, r"(?:^|[^\p{L}\p{N}_])[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}", "near") + r""", people as (
  select id, text, 'PERSON' as label, start + length(found) - length(n) as start, "end", n as found from (select *, regexp_extract(found, '[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}$') as n from near)
  where not regexp_matches(substr(text, "end" + 1, 1), '[\p{L}\p{N}_]'))"""


_NAMES = people(_DOCS)
_SCHEME = "case " + " ".join(f"when regexp_matches(n, '{rx}') then '{name}'" for name, rx in detect.SCHEMES) + " end"
_COUNTRIES = ", ".join(f"'{c}'" for c in detect.COUNTRIES)


def cards(docs: str) -> str:
    return positions(docs, r"\b(?:[0-9][ -]?){13,19}\b", "numbers") + _CARDS_OF_NUMBERS


_CARDS_OF_NUMBERS = rf""",
p as (select id, text, start, start + length(rtrim(found, ' -')) as "end", rtrim(found, ' -') as found, {bare("found")} as n from numbers),
c as (select id, text, start, "end", found, n, {_SCHEME} as scheme from p where {_CLEAR} and length(n) between 13 and 19 and {luhn("n")})
"""
_CARDS = cards(_DOCS)
_STOPS = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS if a != "U.S.")
_SAFE = ", ".join(f"'{x}'" for x in SAFE_DOMAINS)
_RANKS = "case label when 'EMAIL' then 1 when 'PHONE' then 2 when 'ACCOUNT_ID' then 3 when 'DOB' then 4 when 'ADDRESS_BLOCK' then 5 when 'BANK_ORG' then 6 when 'ORG' then 7 when 'PERSON' then 8 when 'ALIAS_LABEL' then 9 when 'GPE' then 10 when 'LOC' then 11 when 'DATE_GENERIC' then 12 else 10000 end"
_MERGED = "\nunion all ".join("select o_orderkey as id, " + ", ".join(f'cast({v} as {t}) as "{c}"' for (c, t), v in zip(shapes.MERGED_COLUMNS, m)) + " from orders" for m in shapes.MERGED)
_PERSON_SEED = digest("'PERSON'", "c_name", "'GLOBAL'")
_ADDRESS = ["123", " ", "Main", " ", "St", ", ", "Springfield", ", ", "IL", " ", "62704"]


def address_part(i: int, part: str, seed: str) -> str:
    if part.isdigit():
        return f"({draw(seed, i, 9)} + 1)::varchar || {digits(f'sha256({seed} || {i})', len(part) - 1)}"
    if part in STATES:
        return picked(STATES, seed, i)
    return titled(picked(STREETS + TOWNS, seed, i)) if part.isalpha() and part.lower() not in PLACES else f"'{part}'"


_PSEUDONYMS = f"""
with s as (select c_custkey as id, {_PERSON_SEED} as seed from customer),
d as (select *, {digits("seed", 16)} as rest, ({draw("seed", 40, 8)} + 2)::varchar || {digits("seed", 2, 50)} as area, '0' || ({draw("seed", 30, 9)} + 1)::varchar || {digits("seed", 6)} as aba,
             make_date((1930 + {draw("seed", 1, 76)})::int, (1 + {draw("seed", 2, 12)})::int, (1 + {draw("seed", 3, 28)})::int) as day from s),
w as (select *, list_sum(list_transform(generate_series(1, 8), lambda i: substr(aba, i, 1)::int * (list_value(3, 7, 1))[(i - 1) % 3 + 1])) as sum from d)
select id, {titled(picked(GIVEN, "seed", 0))} || ' ' || chr((65 + {draw("seed", 2, 26)})::int) || chr(39) || {titled(picked(GIVEN, "seed", 4))} || ' Jr.' as person,
       {titled(picked(WORDS, "seed", 0))} || ' LLC' as org,
       {' || '.join(address_part(i, x, "seed") for i, x in enumerate(_ADDRESS))} as address,
       '(' || area || ') 555-' || substr(rest, 1, 4) as phone,
       lpad(({draw("seed", 1, 665)} + 1)::varchar, 3, '0') || '-' || lpad(({draw("seed", 2, 99)} + 1)::varchar, 2, '0') || '-' || lpad(({draw("seed", 3, 9999)} + 1)::varchar, 4, '0') as ssn,
       aba || ((10 - sum % 10) % 10)::varchar as routing,
       strftime(day, '%B') || ' ' || day(day) || ', ' || year(day) as date,
       {' || '.join("'DE'" if i == 4 else f"chr((65 + {draw('seed', i, 26)})::int)" for i in (0, 1, 2, 3, 4, 6, 7))} as bic
from w
"""

_EVERY = rf"""
every as (select id, text, start, "end", found, 'EMAIL' as label, null as subtype, 'email' as source, null as n, 1 as rank from mails
  union all select id, text, start, "end", found, 'PHONE', null, 'phone', null, 2 from phones where {_PHONE_ALONE}
  union all select id, text, start, "end", found, 'ACCOUNT_ID', 'cc', 'account_ids', n, 3 from c where scheme is not null
  union all select id, text, start, "end", found, 'ACCOUNT_ID', 'swift_bic', 'account_ids', found, 3 from codes where {_CLEAR} and found = upper(found) and found[5:6] in ({_COUNTRIES})
  union all select id, text, start, "end", found, label, null, 'ner_regex', null, 8 from people),
alone as (select * from every x where not exists (select 1 from every y where y.id = x.id and y.rank < x.rank and y.start < x."end" and x.start < y."end"))
"""
_CODES, _MAILS, _PHONES = (lambda docs: positions(docs, "[A-Za-z]{6}[A-Za-z0-9]{2}(?:[A-Za-z0-9]{3})?", "codes")), (lambda docs: positions(docs, _EMAIL, "mails")), (lambda docs: positions(docs, _PHONE, "phones"))
_WORD = f"case when i > 1 and i >= len(w) - 1 then ({listed(FAMILY)})[1 + {draw('seed', '(i - 1)', len(FAMILY))}] else ({listed(GIVEN)})[1 + {draw('seed', '(i - 1)', len(GIVEN))}] end"
#: All that the documents hold, each with its replacement: people by their entity, numbers by their normal form.
_PLAN = f"""with {cards(_NORMALISED)}, {_CODES(_NORMALISED)}, {_MAILS(_NORMALISED)}, {_PHONES(_NORMALISED)}, {people(_NORMALISED)}, {_EVERY},
p_t as ({_NORMALISED}),
i as (select *, {scope_of("text")} as scope from alone),
j as (select *, case when label = 'PERSON' then {base32(digest("'entity'", "found", "scope"), "20")} end as entity_id from i),
k as (select *, {digest("label", "case label when 'PERSON' then entity_id when 'ACCOUNT_ID' then n when 'EMAIL' then split_part(split_part(found, '@', 1), '+', 1) else found end", "scope")} as seed, regexp_extract_all(found, '\\p{{L}}+|[^\\p{{L}}]+') as w,
             split_part(split_part(found, '@', 1), '+', 1) as base, case when contains(split_part(found, '@', 1), '+') then substr(split_part(found, '@', 1), instr(found, '+')) else '' end as tag from j),
l as (select *, '444000' || {digits("seed", "(length(n) - 7)")} as card from k),
drawn as (select *, case when label = 'PERSON' then array_to_string(list_transform(w, lambda p, i: case when not regexp_matches(p, '^\\p{{L}}') or list_contains({listed(TITLES)}, lower(p)) then p else {_WORD} end), '')
                     when label = 'EMAIL' then substr({base32("seed", "50")}, 1, greatest(least(length(base), 50), 1)) || tag || '@example.org'
                     when label = 'PHONE' then {poured("found", f"('1555' || {digits('seed', 16)})")}
                     when subtype = 'cc' then {poured("found", f"(card || list_filter(generate_series(0, 9), lambda d: {luhn('(card || d)')})[1])")}
                     else {lettered("found", (4, 5))} end as new from l),
r as (select *, case when new = found then 'PERSON_' || upper({base32("seed", "12")}) else new end as replacement, case when new = found then 3 else 0 end as retries, case when new = found then 'matches_source' end as reason from drawn),
{_PLACED}
"""

ORACLE_SQL: dict[str, str] = {
    "normalize_text": f"with n as (select doc_id as id, coalesce(text, '') as t, {_NORM} as norm from documents) select id, norm, norm <> t as changed from n",
    "line_index": """
with t as (select doc_id as id, string_split(text, chr(10)) as p from documents),
l as (select id, i - 1 as line, p[i] as s, coalesce(list_sum(list_transform(p[1:i-1], lambda x: length(x) + 1)), 0)::bigint as start, len(p) as n from t, unnest(generate_series(1, len(p))) as u(i))
select id, line, start, start + length(s) as "end" from l where not (line = n - 1 and s = '')
""",
    "email_spans": f"""with {positions(_DOCS, _EMAIL)} select id, start, "end", found, concat(split_part(found, '@', 1), '@', lower(split_part(found, '@', 2))) as normalized from p""",
    "email_attrs": f"""with {positions(_DOCS, _EMAIL)},
q as (select id, start, split_part(found, '@', 1) as local, lower(split_part(found, '@', 2)) as domain from p)
select id, start, local, domain, split_part(local, '+', 1) as base_local, case when contains(local, '+') then substr(local, instr(local, '+') + 1) end as tag, split_part(domain, '.', -1) as tld from q""",
    "email_domain_counts": f"with {positions(_DOCS, _EMAIL)} select lower(split_part(found, '@', 2)) as domain, count(*) as n from p group by 1",
    "phone_spans": f"""with {positions(_DOCS, _PHONE)} select id, start, "end", found from p where {_PHONE_ALONE}""",
    "account_spans": rf"""with {_CARDS},
{positions(_DOCS, "[A-Za-z]{6}[A-Za-z0-9]{2}(?:[A-Za-z0-9]{3})?", "codes")}
select id, start, "end", found, 'ACCOUNT_ID' as label, 'cc' as subtype, n as normalized from c where scheme is not null
union all select id, start, "end", found, 'ACCOUNT_ID', 'swift_bic', found from codes where {_CLEAR} and found = upper(found) and found[5:6] in ({_COUNTRIES})
""",
    "card_spans": f"""with {_CARDS} select id, start, "end", n as normalized from c where scheme is not null""",
    "card_scheme_counts": f"with {_CARDS} select scheme, length(n)::int as length, count(*) as n from c where scheme is not null group by all",
    "ssn_spans": """
with t as (select o_orderkey as id, lpad((o_orderkey % 1000)::varchar, 3, '0') as a, lpad((o_custkey % 100)::varchar, 2, '0') as g, lpad((o_orderkey % 10000)::varchar, 4, '0') as s from orders)
select id, 4 as start, 15 as "end", a || g || s as normalized from t where a not in ('000', '666') and a < '900' and g <> '00' and s <> '0000'
""",
    "ssn_ein_spans": shapes.EINS.expected("subtype", "normalized"),
    "bic_spans": shapes.BICS.expected("normalized"),
    "generic_id_spans": shapes.GENERICS.expected("normalized"),
    "aba_spans": """
with t as (select o_orderkey as id, lpad((o_orderkey * 7919 % 1000000000)::varchar, 9, '0') as n from orders),
w as (select id, n, list_sum(list_transform(generate_series(1, 9), lambda i: substr(n, i, 1)::int * [3, 7, 1][(i - 1) % 3 + 1])) as s from t)
select id, 15 as start, 24 as "end", n as normalized from w where s % 10 = 0
""",
    "iban_valid": """
with b as (select c_custkey as id, lpad((c_custkey * 7 + 12)::varchar, 18, '0') as body from customer),
c as (select id, 'DE' || lpad((98 - (body || '131400')::hugeint % 97)::varchar, 2, '0') || body as r from b),
w as (select id, case id % 4 when 1 then r[1:3] || (r[4]::int + 1) % 10 || r[5:] when 2 then r[1:20] || r[22] || r[21] when 3 then r || '0' else r end as iban from c)
select id, iban, (iban[5:] || '1314' || iban[3:4])::hugeint % 97 = 1 as valid from w
""",
    "generic_dates": """
with o as (select o_orderkey as id, o_orderdate as d, strftime(o_orderdate, '%B') || ' ' || day(o_orderdate) || ', ' || year(o_orderdate) as a, strftime(o_orderdate, '%Y-%m-%d') as iso, strftime(o_orderdate, '%m/%d/%Y') as us from orders)
select id, 7 as start, 7 + length(a) as "end", a as found, iso as normalized from o
union all select id, 13 + length(a), 23 + length(a), iso, iso from o
union all select id, 27 + length(a), 37 + length(a), us, iso from o
""",
    "dob_spans": shapes.BIRTHS.expected("normalized"),
    "bank_spans": shapes.BANKS.expected(),
    "address_lines": shapes.LINES.expected("kind"),
    "address_blocks": shapes.ADDRESSES.expected(),
    "alias_links": shapes.ALIASES.expected("source"),
    "alias_mentions": f"""
with e as ({shapes.ALIASES.expected("source")})
select id, found as alias, count(*) filter (where source = 'alias_resolver') as mentions, true as joined from e group by 1, 2
""",
    "guard_filter": shapes.GUARDED.expected("label"),
    "name_spans": shapes.NAMES.expected("label"),
    "name_scores": "select c_custkey as id, " + ", ".join(f"{shapes.SCORED.case('c_custkey', i)}{'::double' if c == 'score' else ''} as {c}" for i, c in enumerate(("score", "probable", "honorifics", "given", "particles", "surname", "suffixes"), 1)) + " from customer",
    "heading_ranges": r"""
with t as (select doc_id as id, string_split(coalesce(text, ''), chr(10)) as p from documents),
l as (select id, p[i] as s, coalesce(list_sum(list_transform(p[1:i-1], lambda x: length(x) + 1)), 0)::bigint as start from t, unnest(generate_series(1, len(p))) as u(i)),
w as (select *, trim(s) as h, len(regexp_split_to_array(trim(s), '\s+')) as n from l)
select id, start, start + length(s) as "end" from w
where h <> '' and (n between 2 and 6 and (regexp_full_match(h, '\p{Lu}\p{Ll}*(?:\s+\p{Lu}\p{Ll}*)*') or h = upper(h)) or regexp_full_match(h, '[IVXLC]+\.\s+\p{Lu}.{0,80}'))
""",
    "sentence_split": rf"""
with {positions(_DOCS, r"[ \t\n\v\f\r]+")},
b as (select id, start, "end", substr(text, 1, start) as before, substr(text, "end" + 1, 2) as after from p),
k as (select id, start, "end" from b
      where regexp_matches(right(before, 3), '[.!?]["'')\]]{{0,2}}$') and regexp_matches(after, '^["''(\[]?[A-Z]')
        and not regexp_matches(right(before, 12), '(?:[ \t\n\v\f\r"''(\[]|^)(?:{_STOPS})$') and not (regexp_matches(right(before, 5), '(?:^|[^A-Za-z0-9_])[A-Z]\.[A-Z]\.$'))),
c as (select id, list(struct_pack(s := start, e := "end") order by start) as l from k group by id),
x as (select t.id, t.text, coalesce(l, []) as l from p_t t left join c using (id)),
s as (select id, text, coalesce(l[i-1].e, 0) as start, coalesce(l[i].s, length(text)) as "end" from x, unnest(generate_series(1, len(l) + 1)) as u(i))
select id, start, "end" from s where trim(substr(text, start + 1, "end" - start)) <> ''
""",
    "merge_spans": f"""
with recursive s as ({_MERGED}),
o as (select *, row_number() over (partition by id order by {_RANKS}, start - "end", -confidence, start, label, source) as n from s where "end" > start),
k as (select id, 0::bigint as n, []::struct(s int, e int, l varchar, o varchar)[] as kept from (select distinct id from o)
      union all select k.id, o.n, case when len(list_filter(kept, lambda x: x.s < o."end" and o.start < x.e)) > 0 then kept else list_append(kept, struct_pack(s := o.start, e := o."end", l := o.label, o := o.source)) end
      from k join o on o.id = k.id and o.n = k.n + 1),
f as (select id, unnest(arg_max(kept, n)) as x from k group by id)
select id, x.s as start, x.e as "end", x.l as label, x.o as source from f
""",
    "stable_ids": f"select c_custkey as id, {digest(chr(39) + 'entity' + chr(39), 'c_name', chr(39) + 'GLOBAL' + chr(39))} as digest from customer",
    "entity_tokens": f"""with d as (select c_custkey as id, {digest("'entity'", "c_name", "'GLOBAL'", "secret")} as h from customer) select id, {base32("h", "20")} as token from d""",
    "name_tokens": f"""
with s as (select c_custkey as id, {_PERSON_SEED} as seed from customer), t as (select id, seed, {base32("seed", "12")} as token from s)
select id, 'PERSON_' || upper(token) as person, 'ACCT_' || upper(token) as account, 'u' || token || '@example.org' as email, '+1555' || {digits("seed", 7)} as phone from t
""",
    "pseudonym_kinds": _PSEUDONYMS,
    "match_case": r"""
with p as (select p_partkey as id, string_split(p_name, ' ') as w, regexp_extract(p_brand, '^[A-Za-z]+') as b, p_name from part)
select id, case when b = upper(b) then upper(p_name) when b = lower(b) then lower(p_name) else array_to_string(list_transform(w, lambda x: upper(x[1]) || lower(x[2:])), ' ') end as cased,
       case when p_name = upper(p_name) then 'UPPER' when p_name = lower(p_name) then 'LOWER' else 'MIXED' end as kind from p
""",
    "shaped": f"select p_partkey as id, {shapes.SHAPED.case('p_partkey', 2)} as shaped from part",
    "coref_links": f"""
with e as ({shapes.COREFS.expected("who", "whole")}), d as (select *, {digest("'entity'", "who", scope_of("whole"))} as h from e)
select id, start, "end", found, {base32("h", "20")} as entity_id from d
""",
    "email_redacted": f"{_REBUILT} select id as doc_id, redacted from v",
    "email_plan": f"""{_REPLACED} select id as doc_id, start, "end", found as original, replacement, 'EMAIL' as label, 'email' as source, false as skip, 0 as retries from a""",
    "redact_offsets": f"{_REPLACED} select id as doc_id, start, new_start, true as there from a",
    "email_audit": f"""{_REPLACED}
select id as doc_id, printf('r%04d', row_number() over (partition by id order by start)) as id, start, "end", new_start, 'EMAIL' as label, found as original_text, replacement as replacement_text,
       false as skip_replacement, 0 as safety_retries, length(replacement) - length(found) as length_delta from a""",
    "email_audit_summary": f"""{_REPLACED}
select label, count(*) as entries, sum(length(replacement) - length(found))::bigint as length_delta, 0::bigint as kept, 0::bigint as safety_retries, 0::bigint as retried
from a group by rollup(label)""",
    "email_leakage": f"{_REPLACED} select 'EMAIL' as label, 'replacement_match' as status, count(*) as n from a having count(*) > 0",
    "residual_scan": f"""
with {positions(_DOCS, _EMAIL)},
c as (select id, count(*) as n, count(*) filter (where lower(split_part(found, '@', 2)) in ({_SAFE})) as safe from p group by id)
select doc_id, coalesce(n, 0) as total_found, coalesce(safe, 0) as total_ignored, coalesce(n - safe, 0) as residual_count, (3 * coalesce(n - safe, 0))::double as score from documents left join c on c.id = doc_id
""",
    "email_diff": f"""{_REBUILT} select id as doc_id, sha256({page("text", "redacted")}) as html_sha256 from v""",
    "email_coverage": f"{_REBUILT} select id as doc_id, len(l) as found_before, 0 as residual_count, len(l) as covered, len(l) as plan_size, text <> redacted as changed from v",
    "document_audit": f"{_REBUILT} select id as doc_id, sha256(text) as doc_hash, false as seed_present, len(l) as entries, 0 as residual_count, 0.0::double as score from v",
    "alias_clusters": f"""
with c as (select c_custkey as id, c_custkey % 7 as k, {word("c_custkey")} as w, {word("c_custkey", 11)} as v, {number("c_custkey", 5)} as n from customer)
select id, case k when 0 then 'Jane Doe' when 1 then w || ' LLC' when 3 then 'Jane ' || w when 4 then 'Robert ' || w else 'John ' || w || chr(10) || 'Hereinafter' end as primary_surface, case k when 1 then 'org' else 'person' end as kind,
       case k when 0 then 'Morgan' || n when 3 then 'Janie' || n when 4 then 'Rob' || n || ' ' || v when 5 then 'Lee' || n else '' end as aliases, case k when 1 then 'Seller' else '' end as role_aliases, case when k < 2 then 3 else 2 end as mentions
from c where k in (0, 1, 3, 4, 5)
""",
    "document_names": f"with {_NAMES} select label, found, count(*) as n from people group by all",
    "document_spans": f"""with {_CARDS}, {_CODES(_DOCS)}, {_MAILS(_DOCS)}, {_PHONES(_DOCS)}, {_NAMES}, {_EVERY} select id, start, "end", label, source from alone""",
    "replacement_plan": f"""{_PLAN} select id as doc_id, start, "end", found as original, replacement, label, subtype, source, entity_id, false as skip, retries, reason from a""",
    "redact_documents": f"{_PLAN} {_JOINED} select id as doc_id, redacted, 0 as residual_count, 0.0::double as score from v",
    "audit_entries": f"""{_PLAN}
select id as doc_id, printf('r%04d', row_number() over (partition by id order by start)) as id, start, "end", new_start, label, source, subtype, entity_id, found as original_text, replacement as replacement_text,
       false as skip_replacement, retries as safety_retries, reason as unsafe_rejected, length(replacement) - length(found) as length_delta from a""",
    "audit_summary": f"""{_PLAN}
select label, count(*) as entries, sum(length(replacement) - length(found))::bigint as length_delta, 0::bigint as kept, sum(retries)::bigint as safety_retries, count(*) filter (where retries > 0) as retried from a group by rollup(label)""",
    # every pseudonym is found again and is ours; a placeholder isn't found
    "leakage": f"{_PLAN} select label, 'replacement_match' as status, count(*) as n from a where reason is null group by label",
    "html_diff": f"""{_PLAN} {_JOINED}
select id as doc_id, sha256({page("text", "redacted")}) as html_sha256 from v""",
    "stream_of_conversations": f"""{rebuilt(f"select conv_id || ':' || turn as id, {_NORM} as text from conversations", GLOBAL_SCOPE)}
select split_part(id, ':', 1)::bigint as conv_id, split_part(id, ':', 2)::bigint as turn, redacted from v""",
    "metrics_confusion": """
with k as (select o_orderkey as k, o_orderkey % 5 <> 0 as two from orders),
r as (select case when 10 - k % 4 >= 0.5 * (10 + k % 4) then 'PERSON' end as g, 'PERSON' as f from k
      union all select 'PERSON', null from k where 10 - k % 4 < 0.5 * (10 + k % 4)
      union all select 'DOB', case when two then case when k % 3 = 0 then 'DATE_GENERIC' else 'DOB' end end from k)
select coalesce(g, '<none>') as gold_label, coalesce(f, '<none>') as found_label, count(*) as n from r group by 1, 2
""",
}
_PRF = """
with k as (select o_orderkey as k, o_orderkey % 5 <> 0 as two from orders),
r as (select 'PERSON' as g, 'PERSON' as f from k
      union all select 'DOB', case when two then case when k % 3 = 0 then 'DATE_GENERIC' else 'DOB' end end from k),
e as (select g as label, 1 as tp, 0 as fp, 0 as fn from r where g = f
      union all select g, 0, 0, 1 from r where f is null or g <> f
      union all select f, 0, 1, 0 from r where g <> f),
c as (select label, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn from e group by rollup(label)),
prf as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0.0 end as precision, case when tp + fn > 0 then tp / (tp + fn) else 0.0 end as recall,
               case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0.0 end as f1 from c)
"""


def variants_sql(n: int, seed: int) -> str:
    """The changes of evaluate.CHANGES one after the other, each by two bytes of a digest."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    steps = [f"v0 as (select doc_id, k as variant, sha256('{seed}:' || doc_id || ':' || k) as key, coalesce(text, '') as text from documents, unnest(generate_series(0, {n - 1})) as u(k))"]
    for i, (rx, choices) in enumerate(evaluate.CHANGES):
        byte = lambda j: f"('0x' || substr(key, {4 * i + 1 + 2 * j}, 2))::int"  # noqa: B023, E731
        each = " ".join(f"when {j} then regexp_replace(text, {quoted(rx)}, {quoted(c.replace('$', chr(92)))}, 'g')" for j, c in enumerate(choices))
        steps.append(f"v{i + 1} as (select doc_id, variant, key, case when {byte(0)} % 2 = 0 then case {byte(1)} % {len(choices)} {each} end else text end as text from v{i})")
    return f"with {', '.join(steps)} select doc_id, variant::int as variant, text from v{len(evaluate.CHANGES)}"


ORACLE_SQL["fuzz_variants"] = variants_sql(3, 7)
ORACLE_SQL["metrics_prf"] = f"{_PRF} select * from prf"
ORACLE_SQL["metrics_summary"] = f"""{_PRF}
select 'macro' as average, avg(precision) as precision, avg(recall) as recall, avg(f1) as f1 from prf where label is not null
union all select 'micro', precision, recall, f1 from prf where label is null
"""

"""Pseudonyms: each is drawn from a seed (a keyed digest of what it stands for) and has the shape of its source.

A name's letters are taken word by word: every run of letters gets another word in its case, and what stands between the runs
stays, so initials, hyphens, apostrophes and line breaks keep their places. Numbers keep their length and separators and pass
the checks of their kind. The same seed gives the same pseudonym. ``unsafe`` says what can't stand for a span, first of all the
span's own text; the plan draws again then, and takes a placeholder in the end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.text import let, listed, match_case, one_of
from .detect import EIN_PREFIXES, STATES, STREET_TYPES, date_of

GIVEN = "Avery Blake Corin Dara Ellis Farah Glenn Harlow Imre Jules Kiran Linden Marlo Nadia Orin Perrin Quill Rumi Soren Tamsin Uri Vesna Wyatt Xenia Yara Zubin Anouk Bram Celia Dov Edda Fenn Greta Hugo Ines Joss Katya Lorne Mina Niall".split()
FAMILY = "Abbot Barlow Calder Draper Eastman Fielding Garner Holloway Ingram Jarvis Kendrick Langley Mercer Norwood Oakes Pemberton Quincy Radley Selby Thorne Underhill Vance Whitlock Yardley Ashdown Bristow Crane Dunmore Everard Fairfax Goddard Hartwell Ivers Jessop Kerrigan Lockwood Marsden Nettleton Ormond Prescott".split()
WORDS = "Amber Basalt Cobalt Delta Ember Falcon Granite Harbor Indigo Juniper Keystone Lantern Meridian Nova Orchard Pinnacle Quarry Redwood Sierra Tundra Umber Verdant Willow Yonder Zephyr Anchor Birchfield Copper Dovetail Eastgate".split()
STREETS = "Acorn Bramble Clover Dogwood Elder Foxglove Garland Hazel Ivy Jasmine Kestrel Lavender Maple Nettle Olive Primrose Quince Rowan Sorrel Thistle Violet Wisteria Yarrow".split()
TOWNS = "Ashford Bellmead Carrick Dunmore Elmsley Fernhill Glenwood Hartley Inverness Kelso Larkspur Millbrook Northam Oakdale Penrose Ridgefield Stanmore Thornbury Westbrook Yarmouth".split()
#: Words of a name that say what it is and stay.
TITLES = "mr ms mrs mx dr prof hon sir dame lord lady rev fr judge justice jr sr ii iii iv esq esquire phd md jd llm cpa de del della di da van von der den dos das du la le of bin bint ibn".split()
FORMS = "inc llc llp ltd limited plc corp corporation company co na nv sa usa bank trust credit union national association and of the n a".split()
PLACES = [w.lower() for w in STREET_TYPES.split("|")] + "n s e w ne nw se sw north south east west suite ste apt apartment unit floor fl rm room p o po box".split()
SAFE_DOMAIN, SAFE_DOMAINS = "example.org", ["example.org", "example.com", "example.net"]
#: Digits of numbers that can't be anyone's: exchange or area 555.
SAFE_NUMBER = r"^1555\d*$|^1?\d{3}555\d*$|^555\d{4}$"
CARD_PREFIXES = {"visa": "444000", "mastercard": "555000", "amex": "343000", "discover": "601100"}


def runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))


def pick(words: list[str], seed: Column, i: Column | int) -> Column:
    return F.get(listed(words), keys.draw(seed, i, len(words)))


def worded(source: Column, seed: Column, words: list[str], stay: list[str], last: list[str] | None = None) -> Column:
    """Every run of letters replaced but those that stay; single capitals by other capitals; the last of several from ``last``."""

    def of(parts: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            letter = F.chr(keys.draw(seed, i, 26) + 65)
            word = pick(words, seed, i)
            if last:
                word = F.when((i > 0) & (i >= F.size(parts) - 2), pick(last, seed, i)).otherwise(word)
            new = F.when(F.length(p) == 1, match_case(p, letter)).otherwise(let(word, lambda w: match_case(p, w)))
            return F.when(~p.rlike(r"^\p{L}") | one_of(F.lower(p), stay), p).otherwise(F.when(p == "s", p).otherwise(new))

        return F.array_join(F.transform(parts, one), "")

    return let(runs(source), of)


def person(source: Column, seed: Column) -> Column:
    return worded(source, seed, GIVEN, TITLES, FAMILY)


def organisation(source: Column, seed: Column) -> Column:
    return worded(source, seed, WORDS, FORMS)


def address(source: Column, seed: Column) -> Column:
    """Line by line: words and numbers change, kinds of streets and units stay, and so do all separators."""
    chunks = F.regexp_extract_all(source, F.lit(r"\p{L}+|\p{N}+|[^\p{L}\p{N}]+"), F.lit(0))

    def one(p: Column, i: Column) -> Column:
        number = F.concat((keys.draw(seed, i, 9) + 1).cast("string"), keys.digits(keys.hmac_sha256(F.concat(seed, i.cast("string")), None), F.length(p) - 1))
        word = F.when(one_of(p, STATES), pick(STATES, seed, i)).when(one_of(F.lower(p), PLACES), p).when(F.length(p) == 1, match_case(p, F.chr(keys.draw(seed, i, 26) + 65))).otherwise(match_case(p, pick(STREETS + TOWNS, seed, i)))
        return F.when(p.rlike(r"^\p{N}"), number).when(p.rlike(r"^\p{L}"), word).otherwise(p)

    return F.array_join(F.transform(chunks, one), "")


def email(attrs: Column, seed: Column) -> Column:
    token = F.substr(keys.base32(seed, 50), F.lit(1), F.greatest(F.least(F.length(attrs["base_local"]), F.lit(50)), F.lit(1)))
    return F.concat(token, F.coalesce(F.concat(F.lit("+"), attrs["tag"]), F.lit("")), F.lit("@" + SAFE_DOMAIN))


def phone(source: Column, seed: Column) -> Column:
    """Digits in their places; the exchange is 555, and a number with a plus becomes +1 555."""
    n = F.length(F.regexp_replace(F.regexp_replace(source, r"(?i)(?:ext\.?|x|extension)\s?\d{1,6}$", ""), "[^0-9]", ""))
    rest = keys.digits(seed, F.lit(16))
    area = F.concat((keys.draw(seed, 40, 8) + 2).cast("string"), keys.digits(seed, F.lit(2), 50))
    fill = F.when(source.startswith("+"), F.concat(F.lit("1555"), rest)).when(n == 11, F.concat(F.lit("1"), area, F.lit("555"), rest)).otherwise(F.concat(area, F.lit("555"), rest))
    return keys.poured(source, fill)


def card(source: Column, attrs: Column, seed: Column) -> Column:
    prefix = F.coalesce(*(F.when(attrs["scheme"] == k, v) for k, v in CARD_PREFIXES.items()), F.lit("444000"))
    n = attrs["length"].cast("int")
    return keys.poured(source, keys.luhn_completed(F.concat(prefix, keys.digits(seed, n - 7))))


def routing(source: Column, seed: Column) -> Column:
    return keys.poured(source, keys.aba_completed(F.concat(F.lit("0"), (keys.draw(seed, 30, 9) + 1).cast("string"), keys.digits(seed, F.lit(6)))))


def iban(source: Column, attrs: Column, seed: Column) -> Column:
    """Country and length stay; letters stay letters; the check digits are right."""
    compact = attrs["normalized"]
    body = F.array_join(F.transform(F.split(F.substr(compact, F.lit(5)), ""), lambda c, i: F.when(c.rlike("[0-9]"), keys.draw(seed, i, 10).cast("string")).otherwise(F.chr(keys.draw(seed, i, 26) + 65))), "")
    made = keys.iban_completed(F.substring(compact, 1, 2), body)
    blocks = lambda x: F.when(source.contains(" "), F.rtrim(F.regexp_replace(x, "(.{4})", "$1 "))).otherwise(x)
    return let(made, blocks)


def bic(source: Column, seed: Column) -> Column:
    """Capitals of the same length; the country stays."""
    letter = lambda i: F.chr(keys.draw(seed, i, 26) + 65)
    return F.array_join(F.transform(F.split(source, ""), lambda c, i: F.when(i.isin(4, 5), c).otherwise(letter(i))), "")


def ssn(source: Column, seed: Column) -> Column:
    area = F.lpad((keys.draw(seed, 1, 665) + 1).cast("string"), 3, "0")
    return keys.poured(source, F.concat(area, F.lpad((keys.draw(seed, 2, 99) + 1).cast("string"), 2, "0"), F.lpad((keys.draw(seed, 3, 9999) + 1).cast("string"), 4, "0")))


def date(source: Column, seed: Column) -> Column:
    """A day of 1930 to 2005 in the form of the source; what is no date stays."""
    day = F.make_date(1930 + keys.draw(seed, 1, 76), 1 + keys.draw(seed, 2, 12), 1 + keys.draw(seed, 3, 28))
    return F.when(date_of(source).isNull(), source).otherwise(let(day, lambda d: dated(source, d)))


def dated(source: Column, day: Column) -> Column:
    """A day in the form of the source."""
    month = F.when(source.rlike(r"\p{L}{4,}|\b[Mm]ay\b"), F.date_format(day, "MMMM")).otherwise(F.date_format(day, "MMM"))
    cased = match_case(F.regexp_extract(source, r"\p{L}{3,}", 0), month)
    number = F.dayofmonth(day).cast("string")
    named = F.concat(cased, F.lit(" "), number, F.when(source.contains(","), ",").otherwise(""), F.lit(" "), F.year(day).cast("string"))
    forms = [
        (r"^\d{4}-", F.date_format(day, "yyyy-MM-dd")),
        (r"^\d{1,2}/", F.date_format(day, "MM/dd/yyyy")),
        (r"^\d{1,2}-", F.date_format(day, "MM-dd-yyyy")),
        (r"^\p{L}", named),
        (r"^\d{1,2}(?:st|nd|rd|th)?\s", F.concat_ws(" ", number, cased, F.year(day).cast("string"))),
    ]
    return F.coalesce(*(F.when(source.rlike(rx), v) for rx, v in forms), source)


def digits(source: Column, seed: Column) -> Column:
    return keys.poured(source, keys.digits(seed, F.length(source)))


def ein(source: Column, seed: Column) -> Column:
    """A prefix of the list, then seven digits."""
    prefix = F.get(listed(EIN_PREFIXES), keys.draw(seed, 1, len(EIN_PREFIXES)))
    return keys.poured(source, F.concat(prefix, keys.digits(seed, F.lit(7), 10)))


def placeholder(label: Column, seed: Column) -> Column:
    """A token that says what stood there, for spans that no pseudonym fits: PERSON_..., ACCT_... and the like."""
    token = F.upper(keys.base32(seed, 12))
    forms = {"PERSON": "PERSON_", "ORG": "ORG_", "BANK_ORG": "BANK_", "ADDRESS_BLOCK": "ADDRESS_", "ACCOUNT_ID": "ACCT_", "ALIAS_LABEL": "ALIAS_"}
    name = F.coalesce(*(F.when(label == k, v) for k, v in forms.items()), F.lit("X_"))
    number = F.concat(F.lit("+1555"), keys.digits(seed, F.lit(7)))
    return F.when(label == "EMAIL", F.concat(F.lit("u"), F.lower(token), F.lit("@" + SAFE_DOMAIN))).when(label == "PHONE", number).otherwise(F.concat(name, token))


def unsafe(s: Column, x: Column) -> Column:
    """Why a replacement can't stand for a span: the first rule that it breaks, or null."""
    label, kind = s["label"], s["subtype"]
    number, own = F.regexp_replace(x, "[^0-9]", ""), F.regexp_replace(s["text"], "[^0-9]", "")
    account = lambda k: (label == "ACCOUNT_ID") & F.coalesce(kind == k, F.lit(False))
    domain = F.substring_index(x, "@", -1)
    rules = [
        ("matches_source", x == s["text"]),
        ("non_ascii_domain", (label == "EMAIL") & domain.rlike("[^ -~]")),
        ("unsafe_domain", (label == "EMAIL") & ~F.lower(domain).isin(*SAFE_DOMAINS)),
        ("empty_local", (label == "EMAIL") & x.startswith("@")),
        ("unsafe_non_555", (label == "PHONE") & ~number.rlike(SAFE_NUMBER) & (F.length(number) >= 7)),
        ("invalid_digit_count", (label.isin("PHONE") | account("cc") | account("routing_aba") | account("ssn") | account("ein")) & (F.length(number) != F.length(own))),
        ("luhn_invalid", account("cc") & ~keys.luhn_valid(number)),
        ("aba_invalid", account("routing_aba") & ~keys.aba_valid(number)),
        ("iban_invalid", account("iban") & ~keys.iban_valid(F.upper(F.regexp_replace(x, " ", "")))),
        ("ssn_invalid", account("ssn") & number.rlike(r"^(?:000|666|9)|^\d{3}00|0000$")),
        ("unsafe_bic", account("swift_bic") & ~x.rlike("^[A-Z]{4}[A-Za-z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?$")),
    ]
    return F.coalesce(*(F.when(c, F.lit(name)) for name, c in rules), F.lit(None).cast("string"))

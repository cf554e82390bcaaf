"""Texts made of the columns of a table, row by row in one of several shapes, together with what must be found in them.

The test documents hold no banks, names, aliases or codes, so queries on these make texts of other tables. A shape is a list of
pieces, SQL expressions over the table's columns that Spark and DuckDB read alike; a ``Found`` piece is one that the operator must
find, with its further columns. Shapes without such a piece are those in which nothing may be found. Both the texts and the
expected rows come from the same list, so an oracle is a sum of lengths.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SPANS  # noqa: F401

NEWLINE, QUOTE = "chr(10)", "chr(34)"


@dataclass(frozen=True)
class Found:
    text: str
    columns: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Made:
    """A table, its key, and shapes: row k has the shape of number k modulo their number. names: expressions that pieces refer to."""

    table: str
    key: str
    shapes: tuple[tuple[str | Found, ...], ...]
    names: dict[str, str] = field(default_factory=dict)

    def expression(self, piece: str | Found) -> str:
        text = piece.text if isinstance(piece, Found) else piece
        for name, value in self.names.items():
            text = text.replace("{" + name + "}", f"({value})")
        return text

    def texts(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """id, text."""
        cases = " ".join(f"when {i} then concat({', '.join(map(self.expression, shape))})" for i, shape in enumerate(self.shapes))
        return spark.read.parquet(f"{sf_dir}/{self.table}.parquet").select(F.col(self.key).alias("id"), F.expr(f"case {self.key} % {len(self.shapes)} {cases} end").alias("text"))

    def expected(self, *columns: str) -> str:
        """SQL for id, start, end, found and the columns named, a row for each Found piece. whole is the row's text."""
        rows = []
        for i, shape in enumerate(self.shapes):
            own = {"whole": f"concat({', '.join(map(self.expression, shape))})"}
            for j, piece in enumerate(shape):
                if isinstance(piece, Found):
                    before = " + ".join(f"length({self.expression(p)})" for p in shape[:j]) or "0"
                    more = "".join(f", {self.expression((own | piece.columns).get(c, 'null'))} as {c}" for c in columns)
                    text = self.expression(piece)
                    rows.append(f'select {self.key} as id, {before} as start, {before} + length({text}) as "end", {text} as found{more} from {self.table} where {self.key} % {len(self.shapes)} = {i}')
        return "\nunion all ".join(rows)


def word(key: str, salt: int = 0) -> str:
    """A word with a capital, that hangs on a number."""
    return f"concat(chr(cast(65 + ({key} + {salt}) % 26 as int)), 'el', chr(cast(97 + ({key} + {salt}) % 7 as int)), 'ton')"


def number(key: str, width: int, factor: int = 1) -> str:
    """A number's last digits."""
    return f"lpad(cast({key} * {factor} % {10**width} as string), {width}, '0')"


def quoted(text: str) -> str:
    return f"'{text}'"


_C = {"w": word("c_custkey"), "v": word("c_custkey", 11), "n": number("c_custkey", 5)}
_O = {"w": word("o_orderkey"), "n": number("o_orderkey", 6, 7919), "five": number("o_orderkey", 5, 7919)}
_S = {"w": word("s_suppkey"), "v": word("s_suppkey", 5)}

BANKS = Made("supplier", "s_suppkey", (
    ("'paid by '", Found("concat({w}, ' Trust Company')"), "' today'"),
    ("'lent by '", Found("concat({w}, ' ', {v}, ' Bank, N.A.')"), "' in May'"),
    ("'The Food Bank gives to '", "{w}"),
    ("'a note of '", Found("concat('Bank of ', {w}, ', N.A.')"), "' and others'"),
    ("'members of '", Found("concat({w}, ' Credit Union')"), "', all of them'"),
    ("'from '", Found("concat({w}, ' ', {v}, ' Bank & Trust Company')"), "' to us'"),
    ("'your bank account number and '", "{w}"),
    ("'with '", Found("concat({w}, 'bank, N.A.')"), "' since then'"),
    ("'a letter of '", Found("concat({w}, ' Bank PLC')"), "' came'"),
    ("'Bank holiday for '", "{w}"),
), _S)

NAMES = Made("customer", "c_custkey", (
    ("'we met '", Found("concat('John ', {w})", {"label": "'PERSON'"}), "' of '", Found("concat({v}, ' LLC')", {"label": "'ORG'"}), "' there'"),
    ("'then '", Found("concat({w}, ' ', {v}, ' Corp.')", {"label": "'ORG'"}), "' signed'"),
    ("'the '", "lower({w})", "' of nobody'"),
    ("'to ('", Found("concat('Mary ', {w}, ' ', {v})", {"label": "'PERSON'"}), "'), who came'"),
    ("'at '", Found("concat({w}, ', IL')", {"label": "'GPE'"}), "' since then'"),
    ("'Buyer and '", "lower({w})"),
    ("'joined '", Found("concat({w}, ' Credit Union')", {"label": "'ORG'"}), "' last year'"),
    ("'so '", Found("concat({w}, ' ', {v}, ' Anna Marie')", {"label": "'PERSON'"}), "' '", "'won'"),
), _C)

ALIASES = Made("customer", "c_custkey", (
    ("'Jane Doe, hereinafter '", QUOTE, Found("concat('Morgan', {n})", {"source": "'aliases'"}), QUOTE, "', signs. Then '", Found("concat('Morgan', {n})", {"source": "'alias_resolver'"}), "' pays Morgan'", "{n}", "'x.'"),
    ("'for '", "{w}", "' LLC (hereinafter referred to as '", QUOTE, Found("'Seller'", {"source": "'aliases'"}), QUOTE, "'); then '", Found("'Seller'", {"source": "'alias_resolver'"}), "' delivers and Sellers do not.'"),
    ("'it shall hereinafter be referred to as the institution of '", "{w}"),
    ("'by Jane '", "{w}", "', a/k/a '", QUOTE, Found("concat('Janie', {n})", {"source": "'aliases'"}), QUOTE, "' here'"),
    ("'by Robert '", "{w}", "' fka '", Found("concat('Rob', {n}, ' ', {v})", {"source": "'aliases'"}), "', gone'"),
    ("'John '", "{w}", NEWLINE, "'Hereinafter '", QUOTE, Found("concat('Lee', {n})", {"source": "'aliases'"}), QUOTE, "' signs'"),
    ("'aka the party of '", "lower({w})"),
), _C)

ADDRESSES = Made("customer", "c_custkey", (
    ("'To'", NEWLINE, Found("concat({n}, ' Main St', chr(10), 'Suite ', c_nationkey + 1, chr(10), chr(10), 'Springfield, IL ', {n})"), NEWLINE, "'end'"),
    (Found("concat('P.O. Box ', c_custkey + 1, chr(10), {w}, ', NY ', {n})"),),
    ("'1 Main St'", NEWLINE, "'words in between'", NEWLINE, "concat({w}, ', NY ', {n})"),
    ("'Main Street'", NEWLINE, "concat({w}, ', NY ', {n})"),
    ("'Address: '", Found("concat(c_custkey + 1, ' ', {w}, ' Ave NW', chr(13), chr(10), {v}, ', DC')")),
    ("'1 Main St'", NEWLINE, NEWLINE, NEWLINE, "concat({w}, ', NY ', {n})"),
), _C)

LINES = Made("customer", "c_custkey", (
    (Found("concat({n}, ' Broadway')", {"kind": "'street'"}), NEWLINE, "'prose'"),
    ("'Address: '", Found("concat('1', {n}, ' ', {w}, ' Ave NW')", {"kind": "'street'"})),
    (Found("concat('P.O. Box ', {n})", {"kind": "'po_box'"}), "', here'"),
    ("'at'", NEWLINE, Found("concat({w}, ', CA ', {n})", {"kind": "'city_state_zip'"})),
    (Found("concat('Suite ', c_nationkey + 1)", {"kind": "'unit'"}), NEWLINE, Found("'Apt 5B'", {"kind": "'unit'"})),
    ("'Bank of Example, N.A.'", NEWLINE, "'Main Street'"),
), _C)

BIRTHS = Made("orders", "o_orderkey", (
    ("'Name'", NEWLINE, "'DOB: '", Found("{us}", {"normalized": "{iso}"}), "'. Seen '", "{iso}"),
    ("'Born on '", Found("{long}", {"normalized": "{iso}"}), "' in town'"),
    ("'Date of Birth:'", NEWLINE, Found("{long}", {"normalized": "{iso}"})),
    ("'Executed on '", "{long}"),
    ("'D.O.B. '", Found("{us}", {"normalized": "{iso}"}), "', seen'"),
    ("'DOB: 02/30/2021, born late'",),
), {"us": "concat(lpad(cast(month(o_orderdate) as string), 2, '0'), '/', lpad(cast(day(o_orderdate) as string), 2, '0'), '/', cast(year(o_orderdate) as string))", "iso": "concat(cast(year(o_orderdate) as string), '-', lpad(cast(month(o_orderdate) as string), 2, '0'), '-', lpad(cast(day(o_orderdate) as string), 2, '0'))", "long": "concat(substr('January  February March    April    May      June     July     August   SeptemberOctober  November December ', cast(month(o_orderdate) * 9 - 8 as int), cast(length(trim(substr('January  February March    April    May      June     July     August   SeptemberOctober  November December ', cast(month(o_orderdate) * 9 - 8 as int), 9))) as int)), ' ', cast(day(o_orderdate) as string), ', ', cast(year(o_orderdate) as string))"})

BICS = Made("orders", "o_orderkey", (
    ("'code '", Found("concat('DEUT', 'DE', {letters})", {"normalized": "concat('DEUTDE', {letters})"}), "' paid'"),
    ("'code '", Found("concat('CHAS', 'US', {letters}, '3XY')", {"normalized": "concat('CHASUS', {letters}, '3XY')"}), "'.'"),
    ("'code DEUTXX'", "{letters}"),
    ("'word '", "concat('absolute', lower({letters}))"),
), {"letters": "concat(chr(cast(65 + o_orderkey % 26 as int)), chr(cast(65 + o_custkey % 26 as int)))"})

EINS = Made("orders", "o_orderkey", (
    ("'EIN '", Found("concat('12-', {n}, '3')", {"subtype": "'ein'", "normalized": "concat('12', {n}, '3')"}), "' on file'"),
    ("'EIN 07-'", "{n}", "'3 is of no office'"),
    ("'SSN '", Found("concat('123-45-', lpad(cast(1 + o_orderkey % 9999 as string), 4, '0'))", {"subtype": "'ssn'", "normalized": "concat('12345', lpad(cast(1 + o_orderkey % 9999 as string), 4, '0'))"})),
    ("'SSN 666-45-'", "lpad(cast(o_orderkey % 9999 as string), 4, '0')"),
    ("'SSN 123-00-1234 or 923-45-6789 of '", "{w}"),
), _O)

GENERICS = Made("orders", "o_orderkey", (
    ("'Acct # '", Found("concat('0034-567-', {five})", {"normalized": "concat('0034567', {five})"}), "'; paid'"),
    ("'Ref: '", Found("concat('123-45', {five})", {"normalized": "concat('12345', {five})"}), "', late'"),
    ("'Ref: 12-34, '", "{w}"),
    ("'acct abcdefghij, '", "{w}"),
    ("'Account '", Found("concat('AB ', {n})", {"normalized": "concat('AB', {n})"}), "'.'"),
), _O)

GUARDED = Made("customer", "c_custkey", (
    ("'we saw '", Found("concat('John ', {w})", {"label": "'PERSON'"}), "' there'"),
    ("'John '", "{w}", NEWLINE, "'is a heading'"),
    ("'in '", "{w}", "', IL by chance'"),
    ("'IV. John '", "{w}", "' of old'"),
), _C)

COREFS = Made("customer", "c_custkey", (
    ("'John '", "{w}", "' lives here. '", Found("'He'", {"who": "concat('John ', {w})"}), "' pays. Mary Jones and '", Found("'they'", {"who": "'Mary Jones'"}), "' met.'"),
    ("'He left before John '", "{w}", "' came and gave '", Found("'him'", {"who": "concat('John ', {w})"}), "' a letter'"),
    ("'nobody saw them in '", "lower({w})"),
), _C)

#: Spans made of an order key, column by column: start, end, text, label, source, confidence.
MERGED_COLUMNS = [("start", "int"), ("end", "int"), ("text", "string"), ("label", "string"), ("source", "string"), ("confidence", "double")]
MERGED = [
    ("0", "10", "'a'", "'PERSON'", "'x'", "0.8"), ("5", "9 + o_orderkey % 3", "'b'", "'EMAIL'", "'e'", "0.99"), ("10", "20", "'c'", "'ORG'", "'o'", "0.8"), ("10", "20", "'d'", "'ORG'", "'n'", "0.8 + o_orderkey % 2 / 10.0"),
    ("20", "30", "'e'", "'PHONE'", "'p'", "0.99"), ("22", "28", "'f'", "'EMAIL'", "'e'", "0.99"), ("30 + o_orderkey % 4", "44", "'g'", "'DATE_GENERIC'", "'d'", "0.97"), ("30", "32 + o_orderkey % 5", "'h'", "'DOB'", "'b'", "0.99"),
    ("43", "50", "'i'", "'GPE'", "'x'", "0.8"), ("49", "60 + o_orderkey % 7", "'j'", "'PERSON'", "'x'", "0.8"), ("49", "60", "'k'", "'PERSON'", "'y'", "0.9"), ("70", "70", "'l'", "'EMAIL'", "'e'", "0.99"), ("80", "90", "'m'", "'OTHER'", "'z'", "0.5"),
]


def literal(value: str | float | bool) -> str:
    if isinstance(value, str):
        return "concat(" + ", chr(39), ".join(f"'{p}'" for p in value.split("'")) + ")"
    return str(value).lower()


@dataclass(frozen=True)
class Cases:
    """Rows of constants: row k has the one of number k modulo their number."""

    rows: tuple[tuple[str | float | bool, ...], ...]

    def case(self, key: str, column: int = 0) -> str:
        return f"case {key} % {len(self.rows)} " + " ".join(f"when {i} then {literal(r[column])}" for i, r in enumerate(self.rows)) + " end"


#: A name, its score, whether it is probably one, and its parts: honorifics, given, particles, surname, suffixes.
SCORED = Cases((
    ("Dr. Mary Anna van Smith Jr.", 0.9, True, "Dr.", "Mary Anna", "van", "Smith", "Jr."),
    ("J. D. Salinger", 0.6, True, "", "J. D.", "", "Salinger", ""),
    ("Buyer", 0.0, False, "", "", "", "Buyer", ""),
    ("Ludwig van Beethoven", 0.7, True, "", "Ludwig", "van", "Beethoven", ""),
    ("UNITED STATES", 0.4, False, "", "UNITED", "", "STATES", ""),
    ("Mary-Jane O'Neill-Smith Jr.", 0.65, True, "", "Mary-Jane", "", "O'Neill-Smith", "Jr."),
    ("Anna Maria 42", 0.35, False, "", "Anna Maria", "", "42", ""),
    ("Mr. John Smith III", 0.65, True, "Mr.", "John", "", "Smith", "III"),
))
#: A source, a replacement, and the replacement in the source's shape.
SHAPED = Cases((
    ("SMITH-JONES", "Carter Green", "CARTER-GREEN"),
    ("O'NEIL", "Dangelo", "D'ANGELO"),
    ("John's", "Alex", "Alex's"),
    ("J. D.", "Alex Carter", "A. C."),
    ("McDONALD", "Smithson", "SmITHSON"),
    ("12-34", "Alex", "Alex"),
    ("(jones)", "Carter", "(carter)"),
))

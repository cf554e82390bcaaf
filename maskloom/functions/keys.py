"""Keyed hashing and checksums as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

ALPHABET = "abcdefghijklmnopqrstuvwxyz234567"
#: What separates uses of one secret.
NAMESPACE = "maskloom/1/"


def hmac_sha256(message: Column, secret: str | None) -> Column:
    """HMAC-SHA256 in hexadecimal digits; without a secret, the plain hash."""
    data = message.cast("binary")
    if not secret:
        return F.sha2(data, 256)
    import hashlib

    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.lit(bytearray(b ^ x for b in key))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), data), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def canonical(key: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(key), r"(?U)\s+", " "))


@dataclass(frozen=True)
class Scope:
    """Within what the same name gets the same pseudonym: one document (by its text) or all of them."""

    secret: str | None = None
    everywhere: bool = False

    def of(self, text: Column) -> Column:
        name = F.lit("GLOBAL") if self.everywhere else F.sha2(text.cast("binary"), 256)
        return hmac_sha256(F.concat(F.lit(NAMESPACE + "scope/"), name), self.secret)


def digest(kind: Column | str, key: Column, scope: Column, secret: str | None) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return hmac_sha256(F.concat_ws("\x1f", F.lit(NAMESPACE + "entity"), kind, scope, canonical(key)), secret)


def base32(hex_digest: Column, length: int) -> Column:
    """The first characters of a digest in lower-case base 32 without padding; the last of 52 has one bit."""
    bits = F.concat(F.array_join(F.transform(F.split(hex_digest, ""), lambda c: F.lpad(F.conv(c, 16, 2), 4, "0")), ""), F.lit("0000"))
    return let(bits, lambda b: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.substr(F.lit(ALPHABET), F.conv(F.substr(b, i * 5 + 1, F.lit(5)), 2, 10).cast("int") + 1, F.lit(1))), ""))


def stable_id(kind: Column | str, key: Column, scope: Column, secret: str | None, length: int = 20) -> Column:
    if not 8 <= length <= 52:
        raise ValueError("length must be from 8 to 52")
    return base32(digest(kind, key, scope, secret), length)


def draw(seed: Column, i: Column | int, n: int | Column) -> Column:
    """A number from 0 to n - 1: the i-th draw of a seed (a hexadecimal digest)."""
    i = F.lit(i) if isinstance(i, int) else i
    word = F.substring(F.sha2(F.concat_ws(":", seed, i.cast("string")), 256), 1, 12)
    return F.pmod(F.conv(word, 16, 10).cast("bigint"), F.lit(n) if isinstance(n, int) else n).cast("int")


def digits(seed: Column, n: Column, first: int = 0) -> Column:
    """n decimal digits drawn from a seed."""
    drawn = lambda s: F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: draw(s, i + first, 10).cast("string")), "")
    return F.when(n > 0, let(seed, drawn)).otherwise(F.lit(""))


def poured(source: Column, fill: Column) -> Column:
    """The digits of fill in place of the source's, one by one; zeros when they run out."""

    def of(whole: Column) -> Column:
        before = lambda i: F.length(F.regexp_replace(F.substr(source, F.lit(1), i), "[^0-9]", ""))
        digit = lambda i: let(F.substr(whole, before(i) + 1, F.lit(1)), lambda d: F.coalesce(F.nullif(d, F.lit("")), F.lit("0")))
        return F.array_join(F.transform(F.split(source, ""), lambda c, i: F.when(c.rlike("^[0-9]$"), digit(i)).otherwise(c)), "")

    return let(fill, of)


def luhn_valid(s: Column) -> Column:
    return F.call_function("luhn_check", s)


def luhn_completed(prefix: Column) -> Column:
    """The prefix with the digit that makes it pass the Luhn check."""
    return let(prefix, lambda p: F.element_at(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(p, d.cast("string"))), luhn_valid), 1))


def weighted(s: Column, weights: list[int]) -> Column:
    return sum((F.substring(s, i + 1, 1).cast("int") * w for i, w in enumerate(weights)), F.lit(0))


def aba_valid(s: Column) -> Column:
    """Nine digits whose 3-7-1 weighted sum is a multiple of ten."""
    return F.when(s.rlike("^[0-9]{9}$"), F.pmod(weighted(s, [3, 7, 1] * 3), F.lit(10)) == 0).otherwise(False)


def aba_completed(eight: Column) -> Column:
    return let(eight, lambda e: F.concat(e, F.pmod(10 - F.pmod(weighted(e, [3, 7, 1, 3, 7, 1, 3, 7]), F.lit(10)), F.lit(10)).cast("string")))


def mod97(s: Column) -> Column:
    """The remainder by 97 of a string of digits and capitals, a letter counting as 10 to 35."""
    value = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    step = lambda acc, c: F.pmod(acc * F.when(value(c) > 9, 100).otherwise(10) + value(c), F.lit(97))
    return F.aggregate(F.split(s, ""), F.lit(0), step)


def iban_valid(compact: Column) -> Column:
    return compact.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{8,30}$") & (mod97(F.concat(F.substring(compact, 5, 40), F.substring(compact, 1, 4))) == 1)


def iban_completed(country: Column, body: Column) -> Column:
    check = lambda b: 98 - mod97(F.concat(b, country, F.lit("00")))
    return let(body, lambda b: F.concat(country, F.lpad(check(b).cast("string"), 2, "0"), b))

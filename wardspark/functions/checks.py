"""Checksums of identifiers: plain Python, for use inside Arrow UDFs, and Column forms where Catalyst can do it."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def luhn(digits: str) -> bool:
    """Card checksum: from the right, every second digit doubled with its digits added."""
    reverse = [int(c) for c in reversed(digits)] if digits.isascii() and digits.isdigit() else None
    return reverse is not None and (sum(reverse[0::2]) + sum(sum(divmod(2 * d, 10)) for d in reverse[1::2])) % 10 == 0


def national_id(digits: str) -> bool:
    """Eleven digits, the first not 0; the tenth and the eleventh are check digits."""
    if not re.fullmatch(r"[1-9][0-9]{10}", digits):
        return False
    d = [int(c) for c in digits]
    return d[9] == (7 * sum(d[0:9:2]) - sum(d[1:8:2])) % 10 and d[10] == sum(d[:10]) % 10


def iban_shape(compact: str) -> bool:
    return re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", compact) is not None


def iban(compact: str) -> bool:
    """ISO 7064 mod 97-10 over the compact upper-case form; letters count from 10 on."""
    return iban_shape(compact) and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def mrz_digit(data: str) -> str:
    """Check digit of a machine readable field: weights 7, 3, 1; a filler counts 0."""
    return str(sum((0 if c == "<" else int(c, 36)) * (7, 3, 1)[i % 3] for i, c in enumerate(data)) % 10)


def passport_lines(first: str, second: str) -> bool:
    """TD3 machine readable zone: two lines of 44 with five check digits and a sex mark."""
    if not re.fullmatch(r"P[A-Z0-9<]{43}", first) or not re.fullmatch(r"[A-Z0-9<]{44}", second):
        return False
    fields = [(second[a:b], second[b]) for a, b in ((0, 9), (13, 19), (21, 27), (28, 42))]
    fields.append((second[:10] + second[13:20] + second[21:43], second[43]))
    return second[20] in "MF<" and all(mrz_digit(data) == digit for data, digit in fields)


def ipv4(text: str) -> bool:
    parts = text.split(".")
    return len(parts) == 4 and all(re.fullmatch(r"0|[1-9][0-9]{0,2}", p) and int(p) <= 255 for p in parts)


def ipv6(text: str) -> bool:
    """Eight groups, or fewer around one ``::``; brackets, a zone and a dotted tail are allowed."""
    if text[:1] == "[" and text[-1:] == "]":
        text = text[1:-1]
    text = text.split("%", 1)[0]
    head, colon, tail = text.rpartition(":")
    if "." in tail:
        if not colon or not ipv4(tail):
            return False
        text = f"{head}:0:0"
    sides = text.split("::")
    if ":::" in text or len(sides) > 2:
        return False
    groups = [g for side in sides for g in (side.split(":") if side else [])]
    whole = len(groups) == 8 if len(sides) == 1 else len(groups) < 8
    return whole and all(re.fullmatch(r"[0-9A-Fa-f]{1,4}", g) for g in groups)


def _digit(c: Column, place: int) -> Column:
    return F.substring(c, place, 1).cast("int")


def national_id_column(c: Column) -> Column:
    """``national_id`` of a string column, inside codegen; false for null."""
    ok = F.coalesce(c.rlike(r"^[1-9][0-9]{10}$"), F.lit(False))
    safe = F.when(ok, c).otherwise(F.lit("00000000000"))
    d = [_digit(safe, i) for i in range(1, 12)]
    odd, even = d[0] + d[2] + d[4] + d[6] + d[8], d[1] + d[3] + d[5] + d[7]
    return ok & (d[9] == F.pmod(odd * 7 - even, F.lit(10))) & (d[10] == F.pmod(odd + even + d[9], F.lit(10)))


def luhn_column(c: Column) -> Column:
    return F.coalesce(F.call_function("luhn_check", F.regexp_replace(c, "[^0-9]", "")), F.lit(False))


def iban_column(c: Column) -> Column:
    """``iban`` of a string column: the remainder is carried along the characters by ``aggregate``."""
    compact = F.upper(F.regexp_replace(c, r"[\s-]", ""))
    turned = F.concat(F.substring(compact, 5, 64), F.substring(compact, 1, 4))
    codes = F.transform(F.split(turned, ""), lambda x: F.ascii(x))
    value = lambda a: F.when(a >= 65, a - 55).otherwise(a - 48)
    rest = F.aggregate(
        codes, F.lit(0), lambda r, a: F.when(a == 0, r).otherwise(F.pmod(r * F.when(a >= 65, 100).otherwise(10) + value(a), F.lit(97)))
    )
    return F.coalesce(compact.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (rest == 1), F.lit(False))

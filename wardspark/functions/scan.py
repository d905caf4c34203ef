"""The text detectors in their order, as one pass per text for Arrow UDFs.

``Scanner.scan`` gives the masked text, the number of hits, and hits by operator-defined rule. The output is the
normalised text even when nothing was found.
"""

from __future__ import annotations

import base64
import binascii
import re
from dataclasses import dataclass

from wardspark.functions import checks
from wardspark.functions import patterns as P
from wardspark.functions.custom import CustomPattern
from wardspark.functions.names import column_matches, label_by_name

_NORMAL = str.maketrans(P.WIDE, P.NARROW, P.DROPPED)
_EMAIL, _ENCODED_EMAIL = re.compile(P.EMAIL), re.compile(P.ENCODED_EMAIL, re.IGNORECASE | re.ASCII)
_ENCODED_AT = re.compile(P.ENCODED_AT, re.IGNORECASE | re.ASCII)
_PHONE, _DIGIT = re.compile(P.PHONE), re.compile("[0-9]")
#: A maximal run of digits that single separators may group.
_RUN = re.compile(r"[0-9](?:[ ./-]?[0-9])*")
_TAIL = re.compile(r"[A-Za-z0-9_]*")
_DOTTED, _COLONS, _PASSPORT = re.compile(P.DOTTED), re.compile(P.COLONS), re.compile(P.PASSPORT)
_IBAN_START = re.compile(r"[A-Za-z]{2}[\s-]*[0-9]{2}")
#: Up to 34 letters and digits with any grouping between them.
_IBAN_RUN = re.compile(r"[A-Za-z0-9](?:[\s-]*[A-Za-z0-9]){0,33}")
_TOKEN, _AUDIT_TOKEN = re.compile(P.SECRET_TOKEN, re.ASCII), re.compile(P.AUDIT_TOKEN, re.ASCII)
_URL, _BEARER, _ASSIGNMENT = re.compile(P.URL_PASSWORD), re.compile(P.BEARER, re.IGNORECASE), re.compile(P.ASSIGNMENT, re.IGNORECASE)
_BASE64, _HEX = re.compile(P.BASE64_TOKEN), re.compile(P.HEX_TOKEN)


@dataclass(frozen=True)
class Detectors:
    """``audit`` is the variant for arguments and errors in the audit log: no names, no whole base64, fewer tokens."""

    ip: bool = False
    mrz: bool = True
    names: bool = True
    scan_chars: int = P.SCAN_CHARS
    custom: tuple[CustomPattern, ...] = ()
    audit: bool = False


def normalise(text: str) -> str:
    return text if text.isascii() else text.translate(_NORMAL)


def strength(run: str) -> str | None:
    """What the digits of a run prove: ``checksum``, only ``shape``, or nothing."""
    digits = re.sub("[^0-9]", "", run)
    n = len(digits)
    if n == 11:
        return "checksum" if checks.national_id(digits) or digits.startswith("05") else "shape"
    if n == 10 or n == 9 and re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", run):
        return "shape"
    return "checksum" if 13 <= n <= 16 and checks.luhn(digits) else None


def _is_dotted(run: str) -> bool:
    """Four or more groups of one to three digits: an address or a version."""
    groups = re.split(r"[./]+", run)
    return len(groups) >= 4 and all(re.fullmatch("[0-9]{1,3}", g) for g in groups)


def mask_numbers(text: str) -> tuple[str, int]:
    count = 0

    def phone(m: re.Match) -> str:
        nonlocal count
        if m.group().isdigit():
            return m.group()
        count += 1
        return P.PII

    digits = len(_DIGIT.findall(text))
    if digits < 9:  # fewer prove nothing
        return text, 0
    if digits > 9 and re.search(r"[+()\s-]", text):
        text = _PHONE.sub(phone, text)
    out, at = [], 0
    for m in _RUN.finditer(text):
        a, b = m.span()
        if a < at:
            continue
        kind = strength(m.group())
        tail = _TAIL.match(text, b).end()
        # a run that only has the shape may carry one letter, more make it part of a token
        if kind is None or _is_dotted(m.group()) or kind == "shape" and tail - b > 1:
            continue
        out += [text[at:a], P.PII]
        at, count = tail, count + 1
    return "".join(out) + text[at:], count


def _substitute(pattern: re.Pattern, text: str, holds=None, label: str = P.PII) -> tuple[str, int]:
    count = 0

    def one(m: re.Match) -> str:
        nonlocal count
        if holds and not holds(m.group()):
            return m.group()
        count += 1
        return m.expand(label) if "\\" in label else label

    return pattern.sub(one, text), count


def find_ibans(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, whether the checksum holds) from left to right. From each possible start the longest valid prefix
    counts; without one, the longest prefix of the right shape counts if it begins a word."""
    found, at = [], 0
    while m := _IBAN_START.search(text, at):
        start = m.start()
        run = _IBAN_RUN.match(text, start).group()
        ends = [e.end() for e in re.finditer("[A-Za-z0-9]", run)]
        ends = [e for e in reversed(ends) if e >= 15]
        compact = {e: re.sub(r"[\s-]", "", run[:e]).upper() for e in ends}
        valid = next((e for e in ends if checks.iban(compact[e])), None)
        shaped = next((e for e in ends if checks.iban_shape(compact[e])), None)
        begins = start == 0 or not re.match("[A-Za-z0-9_]", text[start - 1])
        if valid or shaped and begins:
            end = start + (valid or shaped)
            found.append((start, end, bool(valid)))
            at = end
        else:
            at = start + 1
    return found


def has_iban(text: str) -> bool:
    return any(ok for _, _, ok in find_ibans(text))


def mask_ips(text: str) -> tuple[str, int]:
    text, six = _substitute(_COLONS, text, checks.ipv6)
    text, four = _substitute(_DOTTED, text, checks.ipv4)
    return text, six + four


def _name_patterns() -> tuple[re.Pattern, re.Pattern]:
    import regex  # classes of letters by case; needed only where names are looked for

    shape = r"\p{Lu}\p{L}+(?:\s+\p{Lu}\p{L}+){0,2}"
    titled = "|".join(map(re.escape, P.TITLES))
    labelled = "|".join(P.NAME_LABELS)
    alone = r"(?<![\p{L}\p{N}])"
    any_case = shape.replace(r"\p{Lu}", r"\p{L}")  # without regard to case, upper and lower letters are one class
    return (
        regex.compile(rf"{alone}({titled})\s+{shape}"),
        regex.compile(rf"{alone}({labelled})\s*:\s*{any_case}", regex.IGNORECASE),
    )


def _decoded(token: str) -> str | None:
    """Text of a base64 token as a lenient decoder reads it."""
    core = token.rstrip("=")
    core = core[: len(core) - (len(core) % 4 == 1)]
    try:
        return base64.b64decode(core + "=" * (-len(core) % 4)).decode("utf-8", "replace")
    except (binascii.Error, ValueError):
        return None


def _hides_pii(text: str | None) -> bool:
    if not text or "\0" in text:
        return False
    plain = normalise(text)
    return bool(_EMAIL.search(plain) or re.search(r"(?<![A-Za-z0-9_])[1-9][0-9]{10}(?![A-Za-z0-9_])", plain)) or has_iban(text)


class Scanner:
    def __init__(self, detectors: Detectors | None = None):
        self.detectors = detectors or Detectors()
        self.custom = [(c, re.compile(c.pattern)) for c in self.detectors.custom]
        self.names = _name_patterns() if self.detectors.names and not self.detectors.audit else ()

    def scan(self, text: str | None, column: str | None = None) -> tuple[str | None, int, dict[str, int]]:
        if not text:
            return text, 0, {}
        if column and (label := label_by_name(column)):
            return label, 1, {}
        if len(text) > self.detectors.scan_chars:
            return P.PII, 1, {}
        text, count = self.built_in(normalise(text))
        classes: dict[str, int] = {}
        for rule, pattern in self.custom:
            if rule.columns and not (column and column_matches(rule.columns, column)):
                continue
            changed, hits = _substitute(pattern, text, label=rule.label)
            if hits > P.CUSTOM_MATCHES_MAX:
                return rule.label, count + 1, classes | {rule.name: classes.get(rule.name, 0) + 1}
            if hits:
                text, count = changed, count + hits
                classes[rule.name] = classes.get(rule.name, 0) + hits
        return text, count, classes

    def built_in(self, text: str) -> tuple[str, int]:
        text, shielded, count = self._ibans(text)
        steps = []
        if "@" in text:
            steps.append(lambda t: _substitute(_EMAIL, t))
        if _ENCODED_AT.search(text):
            steps.append(lambda t: _substitute(_ENCODED_EMAIL, t))
        steps.append(mask_numbers)
        if self.detectors.ip:
            steps.append(mask_ips)
        if self.detectors.mrz and "\n" in text:
            steps.append(lambda t: _substitute(_PASSPORT, t, lambda m: checks.passport_lines(*re.split("\r?\n", m))))
        for step in steps:
            text, n = step(text)
            count += n
        if re.search("[A-Za-z]", text):
            text, n = self._secrets(text)
            count += n
        for pattern, label in zip(self.names, (rf"\1 {P.PII}", rf"\1: {P.PII}"), strict=False):
            text, n = _substitute(pattern, text, label=label)
            count += n
        bare = text.strip()
        if not self.detectors.audit and len(bare) <= 256 and re.fullmatch(P.WHOLE_BASE64, bare) and (plain := _decoded(bare)) is not None:
            if "@" in plain and _EMAIL.search(plain) or mask_numbers(plain)[1] or has_iban(plain):
                text, count = P.PII, count + 1
        for k, original in enumerate(shielded):
            text = text.replace(f"\ue000{k}\ue001", original)
        if P.PII in text:
            joined = re.sub(r"[A-Za-z0-9]+\[MASKED_PII\]", P.PII, text)
            text, count = joined, max(count, int(joined != text))
        return self._encoded(text, count)

    @staticmethod
    def _ibans(text: str) -> tuple[str, list[str], int]:
        """Valid numbers are masked; look-alikes hide from the digit detectors behind private-use marks."""
        out, at, shielded, count = [], 0, [], 0
        for start, end, valid in find_ibans(text):
            out += [text[at:start], P.PII if valid else f"\ue000{len(shielded)}\ue001"]
            if valid:
                count += 1
            else:
                shielded.append(text[start:end])
            at = end
        return "".join(out) + text[at:], shielded, count

    def _secrets(self, text: str) -> tuple[str, int]:
        """Tokens, passwords in URLs, bearers and assignments, each where a word of its pattern occurs at all."""
        low, count = text.lower(), 0
        steps = (
            (any(w in text for w in P.TOKEN_WORDS), _AUDIT_TOKEN if self.detectors.audit else _TOKEN, P.SECRET),
            ("://" in text, _URL, rf"\1{P.SECRET}\2"),
            ("bearer" in low, _BEARER, rf"\1{P.SECRET}"),
            ((":" in text or "=" in text) and any(w in low for w in P.ASSIGNED_WORDS), _ASSIGNMENT, rf"\1{P.SECRET}"),
        )
        for possible, pattern, label in steps:
            if possible:
                text, n = _substitute(pattern, text, label=label)
                count += n
        return text, count

    @staticmethod
    def _encoded(text: str, count: int) -> tuple[str, int]:
        if len(text) > 80 and text.isdigit():
            return text, count
        text, n = _substitute(_BASE64, text, lambda t: _hides_pii(_decoded(t)))
        readable = lambda t: len(t) % 2 == 0 and _hides_pii(bytes.fromhex(t).decode("utf-8", "replace"))
        text, m = _substitute(_HEX, text, readable)
        return text, count + n + m

"""Labels and patterns of the text detectors, in the order in which they apply."""

PII, SECRET = "[MASKED_PII]", "[MASKED_SECRET]"

#: Characters of a text that is scanned; a longer one is masked whole.
SCAN_CHARS, SCAN_CHARS_MAX = 16384, 1048576

#: Zero-width characters and the soft hyphen go; full-width @ and digits and dashes become ASCII.
DROPPED = "​‌‍﻿­"
WIDE = "＠" + "".join(chr(0xFF10 + i) for i in range(10)) + "‐‑‒–—―−"
NARROW = "@0123456789" + "-" * 7

EMAIL = r"[a-zA-Z0-9._%+-]{1,64}@[a-zA-Z0-9.-]{1,253}\.[a-zA-Z]{2,24}"
ENCODED_AT = r"(?:&#0*64;|&#x0*40;|&commat;|\\u0040|%40)"
ENCODED_EMAIL = rf"[a-zA-Z0-9._%+-]{{1,64}}{ENCODED_AT}[a-zA-Z0-9.-]{{1,253}}\.[a-zA-Z]{{2,24}}"
PHONE = r"(?<![0-9])(?:\+?[0-9]{1,3}[\s-]?)?\(?[0-9]{3}\)?[\s-]?[0-9]{3}[\s-]?[0-9]{4}(?![0-9])"
DOTTED = r"(?<![0-9.])(?:[0-9]{1,3}\.)+[0-9]{1,3}(?![0-9.])"
COLONS = r"(?<![0-9A-Fa-f:])\[?(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?:\.(?:0|[1-9][0-9]{0,2})){0,3}\]?(?![0-9A-Fa-f:])"
PASSPORT = r"P[A-Z0-9<]{43}\r?\n[A-Z0-9<]{44}"
SECRET_TOKEN = (
    r"\b(?:sk-[A-Za-z0-9_-]{12,}|sk_live_[A-Za-z0-9]{6,}|sk_test_[A-Za-z0-9]{6,}|AKIA[0-9A-Z]{16}"
    r"|ghp_[A-Za-z0-9]{20,}|gsk_[A-Za-z0-9]{20,}|xox[baprs]-[A-Za-z0-9-]{8,}|eyJ[A-Za-z0-9._-]{20,})\b"
)
URL_PASSWORD = r"([a-zA-Z][a-zA-Z0-9+.-]*://[^:@\s/\"']+:)[^@\s/\"']+(@)"
BEARER = r"(Bearer\s+)[A-Za-z0-9._~+/=-]{6,}"
ASSIGNMENT = (
    r"((?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|authorization)[\"'\s]*[:=][\"'\s]*)[^\"'\s,;}]{4,}"
)
#: Words without one of which these patterns cannot match: a cheap test before them.
TOKEN_WORDS = ("sk-", "sk_", "AKIA", "ghp_", "gsk_", "xox", "eyJ")
ASSIGNED_WORDS = ("passw", "pwd", "secret", "token", "api", "access", "authorization")
#: As SECRET_TOKEN, for arguments and errors in the audit log.
AUDIT_TOKEN = (
    r"\b(?:sk-[A-Za-z0-9]{12,}|sk_live_[A-Za-z0-9]{6,}|AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{20,}|gsk_[A-Za-z0-9]{20,}"
    r"|xox[baprs]-[A-Za-z0-9-]{8,}|eyJ[A-Za-z0-9._-]{20,})\b"
)
TITLES = ("Sn.", "Sayın", "Sayin", "Bayan", "Bay", "Mrs.", "Mr.", "Ms.", "Dr.", "Av.", "Prof.")
NAME_LABELS = (
    "müşteri", "musteri", "yetkili", "kişi", "kisi", "temsilci", "adı soyadı", "adi soyadi", "ad soyad", "customer",
    "contact", "full name", "name",
)
WHOLE_BASE64 = r"[A-Za-z0-9+/]{12,}={0,2}"
BASE64_TOKEN = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{16,80}={0,2}(?![A-Za-z0-9+/=])"
HEX_TOKEN = r"(?<![A-Za-z0-9_])[0-9A-Fa-f]{24,80}(?![A-Za-z0-9_])"

#: Parts of a column's last name that make it private, and patterns that make it secret.
PII_NAMES = ("email", "phone", "tckn", "card", "iban")
SECRET_NAMES = r"secret|token|password|passwd|pwd|api[_-]?key|access[_-]?key|(?<![a-z0-9_])key(?![a-z0-9_])|credential"
SPLIT_ID_NAMES = r"(?:tckn|tc_no|tcno|tc_kimlik)[._-]?(?:1|2|left|right|part[12]|a|b)$"

#: Limits of operator-defined patterns.
CUSTOM_SOURCE_MAX, CUSTOM_QUANTIFIER_MAX, CUSTOM_MATCHES_MAX = 200, 64, 256

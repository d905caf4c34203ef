"""Functions that the gate lets through by names which Spark does not know, in Spark's words.

The gate reads a statement as it was written. What runs is written anew call by call, and is read by the gate once more,
with the functions that this module puts in as the only ones besides; so a mistake here can refuse a statement, not let one
through.
"""

from __future__ import annotations

import re
from collections.abc import Callable

Rule = Callable[[list[str]], str | None]

#: Functions that stand in the rewritten statement besides those of the gate.
NATIVE = frozenset({"split", "hex", "base64", "chr"})
#: Names of encodings in statements, and in Spark.
CHARSETS = {"'utf8'": "'UTF-8'", "'utf-8'": "'UTF-8'", "'latin1'": "'ISO-8859-1'", "'iso-8859-1'": "'ISO-8859-1'", "'sql_ascii'": "'US-ASCII'"}
_TOKEN = re.compile(r"'(?:''|\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|(?<![\w.`])[A-Za-z_]\w*(?=\s*\()|[(),\[\]]", re.S)


def _split(args: list[str]) -> str | None:
    flags = {2: "", 3: "(?i)"}.get(len(args))
    if flags is None or len(args) == 3 and args[2].lower() not in ("'i'", "''"):
        return None
    ignored = flags if len(args) == 3 and args[2] != "''" else ""
    return f"split({args[0]}, {f"concat('{ignored}', {args[1]})" if ignored else args[1]})"


def _bytes(args: list[str]) -> str | None:
    charset = CHARSETS.get(args[1].lower()) if len(args) == 2 else None
    return charset and f"encode({args[0]}, {charset})"


def _encoded(args: list[str]) -> str | None:
    kind = args[1].lower() if len(args) == 2 else ""
    if kind == "'hex'":
        return f"lower(hex({args[0]}))"
    return f"replace(base64({args[0]}), chr(13), '')" if kind == "'base64'" else None


def _cast(args: list[str]) -> str | None:
    return f"cast({args[1]} AS {args[0]})" if len(args) == 2 and re.fullmatch(r"[A-Za-z]+", args[0]) else None


def _boundaries(args: list[str]) -> str | None:
    """Days, months or years that begin between two times; other units as Spark counts them."""
    if len(args) != 3:
        return None
    unit, a, b = args
    part = lambda what: f"(extract({what} FROM {b}) - extract({what} FROM {a}))"
    said = {
        ("day", "dd", "d"): f"datediff(cast({b} AS date), cast({a} AS date))", ("year", "yy", "yyyy"): part("year"),
        ("month", "mm", "m"): f"({part('year')} * 12 + {part('month')})",
    }
    return next((text for units, text in said.items() if unit.lower() in units), None)


#: What runs instead of a call; None leaves it as it is.
RULES: dict[str, Rule] = {"regexp_split_to_array": _split, "convert_to": _bytes, "encode": _encoded}
DIALECT_RULES: dict[str, dict[str, Rule]] = {
    "mssql": {
        "isnull": lambda a: f"coalesce({', '.join(a)})" if len(a) == 2 else None,
        "getdate": lambda a: None if a else "current_timestamp",
        "sysdatetime": lambda a: None if a else "current_timestamp",
        "datepart": lambda a: f"extract({a[0]} FROM {a[1]})" if len(a) == 2 and a[0].isalpha() else None,
        "convert": _cast,
        "datediff": _boundaries,
        "charindex": lambda a: f"position({', '.join(a)})" if len(a) in (2, 3) else None,
    },
}


def rewritten(sql: str, rules: dict[str, Rule]) -> str:
    """The statement with each call that a rule knows in other words, inner calls first; quoted text and comments stay."""
    out, at = [], 0
    while m := _TOKEN.search(sql, at):
        name = m.group().lower()
        if name not in rules:
            out.append(sql[at : m.end()])
            at = m.end()
            continue
        args, end = _arguments(sql, sql.index("(", m.end()) + 1)
        said = None if args is None else rules[name]([rewritten(a, rules).strip() for a in args])
        if said is None:
            out.append(sql[at : m.end()])
            at = m.end()
        else:
            out += [sql[at : m.start()], said]
            at = end
    return "".join(out) + sql[at:]


def _arguments(sql: str, at: int) -> tuple[list[str] | None, int]:
    """The arguments of a call whose bracket opens before ``at``, and where it ends; None if it never does."""
    args, depth, start = [], 0, at
    for m in _TOKEN.finditer(sql, at):
        word = m.group()
        if word in ("(", "["):
            depth += 1
        elif word in (")", "]") and depth:
            depth -= 1
        elif word == ")":
            last = sql[start : m.start()]
            return (args + [last] if args or last.strip() else []), m.end()
        elif word == "," and not depth:
            args.append(sql[start : m.start()])
            start = m.end()
    return None, at

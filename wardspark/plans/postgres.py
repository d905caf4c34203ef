"""PostgreSQL statements in Spark's words: quoted names, casts, array literals, subscripts from 1, members of JSON texts.

The gate reads the result like any other statement, so what is not understood here is refused there. JSON columns are
texts; ``->`` gives a text member without its quotes, as ``->>`` does.
"""

from __future__ import annotations

import re

#: Names of types, and what Spark calls them; JSON is kept as text.
TYPES = {
    "text": "string", "varchar": "string", "bpchar": "string", "name": "string", "uuid": "string", "json": "string", "jsonb": "string", "int2": "smallint",
    "int4": "int", "int8": "bigint", "float4": "float", "float8": "double", "bool": "boolean", "bytea": "binary", "numeric": "decimal(38, 18)", "timestamptz": "timestamp",
}
#: Words before a bracket that are no function's name.
_NO_CALL = frozenset({"in", "and", "or", "not", "values", "over", "as", "any", "all", "exists", "select", "where", "on", "when", "then", "else", "by", "filter", "from", "using"})
_TOKENS = re.compile(r"\s+|--[^\n]*|/\*.*?\*/|'(?:''|[^'])*'|\"(?:\"\"|[^\"])*\"|->>|->|::|[A-Za-z_][\w$]*|\d+(?:\.\d+)?|.", re.S)
_BLANK = re.compile(r"\s+|--.*|/\*.*", re.S)


def to_spark(sql: str) -> str:
    tokens, out, open_ = _TOKENS.findall(sql), [], []
    at = 0
    while at < len(tokens):
        t, last = tokens[at], _last(out)
        following = next((k for k in range(at + 1, len(tokens)) if not _BLANK.fullmatch(tokens[k])), None)
        coming = tokens[following] if following is not None else ""
        at += 1
        if t[0] == "'":
            out.append(t.replace("\\", "\\\\"))  # a backslash is a sign like any other
        elif t[0] == '"' and len(t) > 2:
            out.append("`" + t[1:-1].replace('""', '"').replace("`", "``") + "`")
        elif t == "(":
            open_.append(out[last].lower() if last is not None else "")
            out.append(t)
        elif t == "[" and last is not None and out[last].lower() == "array":
            del out[last + 1 :]
            open_.append("array")
            out.append("(")
        elif t == "[" and (start := _operand(out)) is not None:
            open_.append("index")
            out[start:start] = ["try_element_at", "("]
            out.append(", ")
        elif t in (")", "]"):
            kind = open_.pop() if open_ else ""
            out.append(")" if kind in ("array", "index") or t == ")" else t)
        elif t in ("->", "->>") and (path := _path(coming)) and (start := _operand(out)) is not None:
            out[start:start] = ["get_json_object", "("]
            out += [", ", path, ")"]
            at = following + 1
        elif t == "::" and coming.lower() in TYPES:
            out += [t, TYPES[coming.lower()]]
            at = following + 1
        elif t.lower() in TYPES and open_ and open_[-1] == "cast" and coming == ")" and last is not None and out[last].lower() == "as":
            out.append(TYPES[t.lower()])
        else:
            out.append(t)
    return "".join(out)


def _path(key: str) -> str | None:
    """A member's name or number as a path; None for what is neither."""
    if key.isdigit():
        return f"'$[{key}]'"
    name = key[1:-1] if key[:1] == "'" else ""
    if not name or re.search(r"['\"\\\[\]*]", name):
        return None
    return f"'$.{name}'" if re.fullmatch(r"\w+", name) else f"'$[''{name}'']'"


def _last(out: list[str], end: int | None = None) -> int | None:
    return next((k for k in range((len(out) if end is None else end) - 1, -1, -1) if not _BLANK.fullmatch(out[k])), None)


def _name(token: str) -> bool:
    return token[:1] == "`" or token[:1].isalpha() or token[:1] == "_"


def _operand(out: list[str], end: int | None = None) -> int | None:
    """Where the operand starts that ends before ``end``: a literal, a name, a call, a bracket, or one of these with a cast."""
    at = _last(out, end)
    if at is None:
        return None
    if out[at] == ")":
        depth = 0
        while at >= 0:
            depth += (out[at] == ")") - (out[at] == "(")
            if not depth:
                break
            at -= 1
        if at < 0:
            return None
        if at and _name(out[at - 1]) and out[at - 1].lower() not in _NO_CALL:
            at -= 1
    elif not (_name(out[at]) and out[at].lower() not in _NO_CALL or out[at][0] == "'" or out[at][0].isdigit()):
        return None
    while at > 1 and out[at - 1] == "." and _name(out[at - 2]):
        at -= 2
    before = _last(out, at)
    return _operand(out, before) if before is not None and out[before] == "::" else at

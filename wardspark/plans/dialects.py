"""Front ends for statements in other dialects: what they refuse beyond the gate, and how they read in Spark SQL."""

from __future__ import annotations

import re

from wardspark.plans import calls, postgres
from wardspark.plans.gate import without_literals
from wardspark.plans.policy import Policy, PolicyError

#: What the two dialects refuse before parsing, with the reasons shown.
REFUSED = {
    "mssql": (
        (r"\bGO\b", "GO batch separator is not permitted."),
        (r"\bEXEC(?:UTE)?\b", "EXEC/EXECUTE is not permitted."),
        (r"\bxp_", "xp_* procedures are not permitted."),
        (r"\bsp_", "sp_* procedures are not permitted."),
        (r"\bOPENROWSET\b", "OPENROWSET is not permitted."),
        (r"\bOPENQUERY\b", "OPENQUERY is not permitted."),
        (r"\bOPENDATASOURCE\b", "OPENDATASOURCE is not permitted."),
        (r"\bFOR\s+XML\b", "FOR XML is not permitted."),
        (r"\bFOR\s+JSON\b", "FOR JSON is not permitted."),
        (r"\bSET\s+ROWCOUNT\b", "SET ROWCOUNT is not permitted."),
        (
            r"\bWITH\s*\([^)]*\b(?:UPDLOCK|XLOCK|HOLDLOCK|SERIALIZABLE|PAGLOCK|TABLOCKX|TABLOCK|ROWLOCK|READPAST|READCOMMITTEDLOCK)\b",
            "Locking hints are not permitted on a read-only gate.",
        ),
        (r"\bINTO\b", "SELECT INTO is not permitted."),
        (r"\bTOP\s*\(?\s*[0-9.]+\s*\)?\s+PERCENT\b", "TOP n PERCENT is not a row cap and is not permitted."),
    ),
    "oracle": (
        (r"\bROWNUM\b", "ROWNUM is not a row cap and is not permitted."),
        (r"\bUTL_", "UTL_* packages are not permitted."),
        (r"\bDBMS_", "DBMS_* packages are not permitted."),
        (r"\bBEGIN\b", "Anonymous PL/SQL blocks are not permitted."),
        (r"\w@\w", "Database link (@) is not permitted."),
    ),
}


def without_comments(sql: str) -> str:
    """Line and block comments become a space; quoted text stays."""
    return re.sub(r"('(?:''|[^'])*')|--[^\n\r]*|/\*.*?(?:\*/|\Z)", lambda m: m.group(1) or " ", sql, flags=re.S)


def to_spark(sql: str, policy: Policy) -> str:
    """The statement in Spark's words; the gate reads the result like any other statement."""
    if policy.dialect not in REFUSED:
        return postgres.to_spark(sql) if policy.dialect == "postgres" else sql
    bare = without_literals(sql)
    for pattern, reason in REFUSED[policy.dialect]:
        if re.search(pattern, bare, re.IGNORECASE):
            raise PolicyError(reason)
    return _mssql(sql) if policy.dialect == "mssql" else _oracle(sql)


def _quoted(sql: str) -> str:
    return re.sub(r'\[([^\]]+)\]|"([^"]+)"', lambda m: f"`{m.group(1) or m.group(2)}`", sql)


def _mssql(sql: str) -> str:
    """TOP n moves to the end of its SELECT as LIMIT n; brackets become backticks; + between texts joins them; calls that
    Spark does not know, or knows with another meaning, are put in its words."""
    sql = calls.rewritten(_quoted(sql), calls.DIALECT_RULES["mssql"])
    sql = re.sub(r"([\w`.)']+)\s*\+\s*('(?:''|[^'])*')", r"concat(\1, \2)", sql)
    while m := re.search(r"\bSELECT\s+(DISTINCT\s+)?TOP\s*\(?\s*(\d+)\s*\)?", sql, re.IGNORECASE):
        end = _end_of_select(sql, m.end())
        sql = f"{sql[: m.start()]}SELECT {m.group(1) or ''}{sql[m.end() : end].strip()} LIMIT {m.group(2)} {sql[end:]}"
    return sql.strip()


def _end_of_select(sql: str, at: int) -> int:
    """Where the SELECT ends: the bracket that closes it, a set operator, a semicolon, or the end."""
    depth = 0
    for m in re.finditer(r"'(?:''|[^'])*'|`[^`]*`|\(|\)|;|\b(?:UNION|EXCEPT|INTERSECT)\b", sql[at:], re.IGNORECASE):
        word = m.group()
        if word == "(":
            depth += 1
        elif word == ")":
            depth -= 1
        if depth < 0 or depth == 0 and (word == ";" or word[0].isalpha()):
            return at + m.start()
    return len(sql)


def _oracle(sql: str) -> str:
    sql = _quoted(without_comments(sql))
    return re.sub(r"\bFETCH\s+(?:FIRST|NEXT)\s+(\d+)\s+ROWS?\s+ONLY\b", r"LIMIT \1", sql, flags=re.IGNORECASE).strip()

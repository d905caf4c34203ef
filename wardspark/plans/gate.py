"""Admission of statements before Spark sees them: text checks, then an allowlist over the parsed plan.

``spark.sql`` runs commands while it analyses them, so nothing reaches it that this gate has not admitted. Whatever
node or expression is not known here is refused.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import ParseException
from pyspark.sql import SparkSession

from wardspark.plans import tree
from wardspark.plans.policy import Policy, PolicyError

#: Words of writing statements, in the order in which they are reported.
WRITE_WORDS = (
    "DROP", "TRUNCATE", "DELETE", "UPDATE", "INSERT", "ALTER", "CREATE", "GRANT", "REVOKE", "MERGE", "COPY", "CALL",
    "DO", "VACUUM",
)
#: Functions that any dialect may call.
SAFE_FUNCTIONS = frozenset({
    "abs", "avg", "btrim", "ceil", "ceiling", "char_length", "coalesce", "concat", "concat_ws", "convert_to", "count",
    "encode", "floor", "greatest", "least", "length", "lower", "ltrim", "max", "min", "nullif", "octet_length",
    "regexp_replace", "regexp_split_to_array", "replace", "round", "rtrim", "split_part", "sum", "trim", "upper",
})
#: Further functions by dialect; only without a schema.
DIALECT_FUNCTIONS = {
    "mssql": frozenset({
        "charindex", "convert", "dateadd", "datediff", "datepart", "getdate", "isnull", "left", "len", "right",
        "substring", "sysdatetime",
    }),
    "oracle": frozenset({
        "decode", "instr", "last_day", "months_between", "nvl", "nvl2", "to_char", "to_date", "to_number", "trunc",
    }),
}
#: Special forms of standard SQL that Spark parses as functions.
FORMS = frozenset({"extract", "overlay", "substring", "substr", "position", "cast", "array", "get_json_object", "element_at", "try_element_at", "between"})
#: Functions that pour rows into one value.
DUMP_FUNCTIONS = frozenset({
    "array_agg", "json_agg", "jsonb_agg", "listagg", "row_to_json", "string_agg",
    "collect_list", "collect_set", "map_agg", "to_csv", "to_json", "to_xml", "to_avro", "to_protobuf", "group_concat",
})
#: Names before the dot that would reach files or the session instead of a table.
SYSTEM_SCHEMAS = frozenset({
    "pg_catalog", "information_schema", "sys", "system", "global_temp",
    "avro", "binaryfile", "csv", "delta", "iceberg", "jdbc", "json", "orc", "parquet", "text", "xml",
})

READ_NODES = frozenset({
    "Project", "Filter", "Join", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Union",
    "SubqueryAlias", "UnresolvedRelation", "UnresolvedWith", "OneRowRelation", "UnresolvedInlineTable",
    "UnresolvedHaving", "UnresolvedSubqueryColumnAliases", "UnresolvedTableValuedFunction", "WithWindowDefinition",
    "UnresolvedTVFAliases", "LocalRelation",
})
SET_NODES = frozenset({"Intersect", "Except"})
EXPRESSIONS = frozenset({
    "UnresolvedAttribute", "AttributeReference", "UnresolvedStar", "UnresolvedAlias", "Alias", "Literal", "UnresolvedFunction", "Cast",
    "CaseWhen", "And", "Or", "Not", "EqualTo", "EqualNullSafe", "GreaterThan", "GreaterThanOrEqual", "LessThan",
    "LessThanOrEqual", "In", "InSubquery", "ListQuery", "ScalarSubquery", "Add", "Subtract", "Multiply", "Divide",
    "IntegralDivide", "Remainder", "UnaryMinus", "UnaryPositive", "IsNull", "IsNotNull", "IsTrue", "IsNotTrue", "Like",
    "ILike", "RLike", "LikeAll", "LikeAny", "SortOrder", "WindowExpression", "WindowSpecDefinition",
    "UnresolvedWindowExpression", "WindowSpecReference", "UnspecifiedFrame", "SpecifiedWindowFrame", "CurrentRow",
    "UnboundedPreceding", "UnboundedFollowing", "UnresolvedExtractValue", "Concat", "StringTrim", "StringTrimLeft",
    "StringTrimRight", "StringTrimBoth", "StringLocate", "Overlay", "Substring", "UnresolvedOrdinal", "CreateArray",
    "UnresolvedInlineTable", "Between", "BetweenExpr", "UnresolvedStarExceptOrReplace", "SimilarTo", "CurrentTimestamp",
})
#: Calls that the parser turns into nodes of their own, by the function that was called.
CALLED = {"TimestampAdd": "dateadd", "TimestampDiff": "datediff"}
READ_ONLY = "Only read-only SELECT/WITH queries are permitted."
MANY = "Multiple statements are not permitted."
LOCK = "Row-locking clauses (FOR UPDATE/SHARE) are not permitted."


@dataclass(frozen=True)
class Admitted:
    sql: str
    tables: tuple[str, ...]
    functions: tuple[str, ...]


def without_literals(sql: str) -> str:
    return re.sub(r"\"(?:\"\"|[^\"])*\"", '""', re.sub(r"'(?:''|[^'])*'", "''", sql))


def statements(sql: str) -> list[str]:
    """Cut at semicolons outside quotes and comments; blank pieces go."""
    marks = re.finditer(r"'(?:''|\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|;", sql, re.S)
    cuts = [m.start() for m in marks if m.group() == ";"]
    pieces = [sql[a + 1 : b] for a, b in zip([-1, *cuts], [*cuts, len(sql)], strict=True)]
    return [p for p in pieces if p.strip()]


def check_text(sql: str) -> None:
    head = " ".join(sql.upper().split())
    if not head.startswith(("SELECT", "WITH")):
        raise PolicyError(READ_ONLY)
    bare = without_literals(head)
    for word in WRITE_WORDS:
        if re.search(rf"(?<![A-Z0-9_]){word}(?![A-Z0-9_])", bare):
            raise PolicyError(f"Blocked write operation: {word}")
    if re.search(r"\bFOR\s+(?:UPDATE|SHARE|NO\s+KEY\s+UPDATE|KEY\s+SHARE)\b", head):
        raise PolicyError(LOCK)


def admit(spark: SparkSession, sql: str, policy: Policy, also: frozenset[str] = frozenset()) -> Admitted:
    """The statement with its tables and functions, or PolicyError; ``also`` are functions let through besides."""
    check_text(sql)
    pieces = statements(sql)
    try:
        plans = [tree.parsed(spark, piece) for piece in pieces]
    except ParseException as error:
        raise PolicyError(f"Failed to parse SQL: {error.getMessage() if hasattr(error, 'getMessage') else error}") from None
    if len(plans) != 1:
        raise PolicyError(MANY)
    walk = _Walk(policy, {q for q in re.findall(r"`([^`]*)`", pieces[0])}, also)
    walk.plan(plans[0], frozenset())
    return Admitted(pieces[0], tuple(sorted(walk.tables)), tuple(sorted(walk.functions)))


class _Walk:
    def __init__(self, policy: Policy, quoted: set[str], also: frozenset[str] = frozenset()):
        self.policy, self.quoted = policy, quoted
        self.known = FORMS | also | DIALECT_FUNCTIONS.get(policy.dialect, frozenset())
        self.tables: set[str] = set()
        self.functions: set[str] = set()

    def refuse(self, reason: str):
        raise PolicyError(reason, tuple(sorted(self.tables)))

    def plan(self, node: tree.Node, ctes: frozenset[str]) -> None:
        """Sources first, then the expressions above them."""
        known = READ_NODES | (SET_NODES if self.policy.allow_set_ops else frozenset())
        if node.kind not in known:
            self.refuse(READ_ONLY)
        if node.kind == "UnresolvedWith":
            bound = node.fields["cteRelations"]
            ctes = ctes | {b["_1"].lower() for b in bound}
            for b in bound:
                self.plan(b["_2"], ctes)
        elif node.kind == "UnresolvedRelation":
            self.table(tree.names(node.fields["multipartIdentifier"]), ctes)
        elif node.kind == "UnresolvedTableValuedFunction":
            self.function(tree.names(node.fields["name"]))
        for child in node.children:
            self.plan(child, ctes)
        for name in node.fields:
            if name != "cteRelations":
                for inner in node.trees(name):
                    self.expression(inner, ctes)

    def expression(self, node: tree.Node, ctes: frozenset[str]) -> None:
        if node.kind in ("ScalarSubquery", "InSubquery", "ListQuery", "Exists"):
            if node.kind == "Exists" and not self.policy.allow_exists:
                self.refuse("Function 'exists' is not permitted by policy.")
            for name in node.fields:
                for inner in node.trees(name):
                    (self.plan if name == "plan" else self.expression)(inner, ctes)
        elif node.kind not in EXPRESSIONS and node.kind not in CALLED:
            self.refuse(READ_ONLY)
        else:
            if node.kind in CALLED:
                self.function([CALLED[node.kind]])
            if node.kind == "UnresolvedFunction":
                self.function(tree.names(node.fields["nameParts"]))
            for inner in node.inner():
                self.expression(inner, ctes)
        for child in node.children:
            self.expression(child, ctes)

    def table(self, parts: list[str], ctes: frozenset[str]) -> None:
        if len(parts) == 1:
            if parts[0].lower() not in ctes:
                self.refuse(f"Unqualified table '{parts[0]}' is not permitted; use schema.table.")
            return
        name = ".".join(parts)
        if any(p in self.quoted and p != p.lower() for p in parts):
            self.refuse(f"Quoted mixed-case identifier '{name}' is not permitted; policy matching is lowercase-only.")
        name = name.lower()
        self.tables.add(name)
        if parts[0].lower() in SYSTEM_SCHEMAS or name.startswith("public.pg_"):
            self.refuse(f"Access to system catalog '{name}' is forbidden.")
        # a quoted name with a comma, dot or bracket would read like several parts
        odd = any(not re.fullmatch(r"\w+", p) for p in parts)
        if len(parts) != 2 or odd or not self.policy.allows_table(name):
            self.refuse(f"Access to table '{name}' is not permitted by policy.")

    def function(self, parts: list[str]) -> None:
        name = ".".join(parts).lower()
        self.functions.add(name)
        base = name.rsplit(".", 1)[-1]
        if base in DUMP_FUNCTIONS:
            self.refuse(f"High-risk aggregate/serialization function '{name}' is not permitted by policy.")
        plain = name.removeprefix("pg_catalog.")
        if plain not in SAFE_FUNCTIONS and name not in self.known:
            self.refuse(f"Function '{name}' is not permitted by policy.")

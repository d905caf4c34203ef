"""Building and listing records: references, digests, identifiers, redacted listings, briefs, policy discovery."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspark.functions import canon
from wardspark.functions import patterns as P
from wardspark.operators.evidence import inclusion_holds

REDACTED = "[REDACTED]"
#: Names of fields that a listing never shows.
HIDDEN_FIELDS = r"(?i)token|secret|password|apikey|api[_-]?key|servicekey|service_key|dsn|url|\bkey\b|anonkey|anon_key|headers|authorization"
#: Parts of column names to mask, and of table names to deny, when a policy is drafted from a catalog.
PRIVATE_PARTS = (
    "email", "mail", "telefon", "phone", "tel", "adres", "address", "tc", "kimlik", "ssn", "kart", "card", "password",
    "sifre", "secret",
)
SENSITIVE_TABLES = (
    "finans", "kredi", "maas", "sifre", "secret", "bilanco", "muhasebe", "salary", "finance", "password", "token",
)
#: Columns that a brief leaves out.
BRIEF_DROPS = r"(?i)phone|email|gsm|tckn"
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"

_HIDDEN, _TOKEN = re.compile(HIDDEN_FIELDS), re.compile(P.SECRET_TOKEN, re.ASCII)


def redact(value):
    """A copy of nested data: hidden fields and texts shaped like secrets are replaced."""
    if isinstance(value, dict):
        return {k: REDACTED if _HIDDEN.search(k) else redact(v) for k, v in value.items()}
    if isinstance(value, list):
        return [redact(v) for v in value]
    return _TOKEN.sub(REDACTED, value) if isinstance(value, str) else value


def redacted(line: Column) -> Column:
    """``redact`` of JSON lines; a line that is no JSON is hidden whole."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lines in parts:
            out = []
            for text in lines:
                try:
                    out.append(None if text is None else json.dumps(redact(json.loads(text)), ensure_ascii=False, separators=(",", ":")))
                except ValueError:
                    out.append(REDACTED)
            yield pd.Series(out, dtype=object)

    return run(line)


def data_refs(tables: Column, tool: Column, target: Column, source: Column) -> Column:
    """Distinct objects that an access touched: its tables, and the target of describe_table."""
    none = F.array().cast("array<string>")
    named = F.when((tool == "describe_table") & (target != ""), F.array(target))
    every = F.array_distinct(F.concat(F.coalesce(tables, none), F.coalesce(named, none)))
    return F.transform(
        every, lambda o: F.struct(F.coalesce(source, F.lit("unknown")).alias("source"), o.alias("object"), none.alias("fieldsRequested"))
    )


def disclosure(payload: Column, complete: Column, denied: Column) -> Column:
    """Digest and size of the bytes that left, for complete accesses that were not denied; else undeclared."""
    measured = complete & ~denied & payload.isNotNull()
    return F.struct(
        F.when(measured, F.concat(F.lit("sha256:"), F.sha2(payload.cast("binary"), 256))).alias("hash"),
        F.when(measured, F.octet_length(payload).cast("long")).alias("bytes"),
        F.when(measured, "measured").otherwise("undeclared").alias("source"),
    )


def args_hash(args) -> str:
    """Digest of request arguments: texts as they are, anything else in canonical form."""
    import hashlib

    body = args if isinstance(args, str) else canon.canonical(args)
    return "sha256:" + hashlib.sha256(body.encode()).hexdigest()


def ulid(millis: Column) -> Column:
    """Sortable identifier: ten letters of time, sixteen at random."""
    letter = lambda n: F.substring(F.lit(CROCKFORD), (n + 1).cast("int"), F.lit(1))
    time = [letter(F.shiftright(millis, 5 * k).bitwiseAND(F.lit(31))) for k in range(9, -1, -1)]
    return F.concat(*time, *(letter(F.floor(F.rand() * 32)) for _ in range(16)))


def drafted(columns: DataFrame) -> DataFrame:
    """table_name, allowed and mask_columns of a first policy, from (table_name, column_name)."""
    has = lambda c, parts: F.lower(c).rlike("|".join(parts))
    masks = F.array_sort(F.collect_set(F.when(has("column_name", PRIVATE_PARTS), F.col("column_name"))))
    rows = columns.groupBy("table_name").agg(masks.alias("m"))
    name = F.element_at(F.split("table_name", r"\."), -1)
    allowed = ~has(name, SENSITIVE_TABLES)
    return rows.select("table_name", allowed.alias("allowed"), F.when(allowed, F.col("m")).alias("mask_columns"))


def brief(frames: dict[str, DataFrame], rows: int = 10, columns: int = 6) -> str:
    """Markdown tables of the first rows of governed results, without contact columns."""
    out = []
    for title, df in frames.items():
        names = [c for c in df.columns if not re.search(BRIEF_DROPS, c)][:columns]
        lines = ["| " + " | ".join("" if r[n] is None else str(r[n]) for n in names) + " |" for r in df.select(*names).limit(rows).collect()]
        head = ["| " + " | ".join(names) + " |", "| " + " | ".join("---" for _ in names) + " |"]
        out += [f"## {title}", *(head + lines if lines else ["_empty_"]), ""]
    return "\n".join(out)


def countersigned(record: dict, log: DataFrame, keys: dict[str, bytes]) -> int:
    """Code of a countersignature: 20 for a record without its parts, 13 for a bad signature, 14 if the log does not
    lead from the record to its head, else 0."""
    sig = record.get("sig")
    if not isinstance(sig, dict) or not isinstance(record.get("hash"), str) or not isinstance(record.get("seq"), int):
        return 20
    if record["hash"] != canon.entry_hash(record):
        return 14
    raw = canon.canonical_base64(sig.get("value"))
    key = keys.get(sig.get("keyId"))
    if raw is None or key is None or not canon.ed25519_ok(key, record["hash"].encode(), raw):
        return 13
    head = log.agg(F.max_by("hash", "seq").alias("h")).first()["h"]
    path = log.where(F.col("seq") >= record["seq"])
    return 0 if head is not None and inclusion_holds(path, record["seq"], record["hash"], head).first()["holds"] else 14

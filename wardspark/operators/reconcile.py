"""Reconciliation of access receipts with a database's own statement counters over a window."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How table and CTE names stand in statement texts, words that are no tables, and housekeeping.
_NAME = r'"[^"]+"|[a-z_][a-z0-9_$]*'
TABLES = rf"(?i)\b(?:from|join|into|update)\s+(?:only\s+)?({_NAME})(?:\s*\.\s*({_NAME}))?"
CTES = rf"(?i)({_NAME})\s+as\s*\("
NO_TABLES = ("select", "values", "lateral", "unnest")
HOUSEKEEPING = r"(?i)^\s*(set\b|show\b|begin\b|commit\b|rollback\b|select\s+set_config\b|deallocate\b|discard\b)"
SYSTEM_SCHEMAS = ("pg_catalog", "information_schema")

OUTCOMES = ("matched", "excluded", "observed-without-receipt", "receipted-without-observation", "indeterminate")


class SnapshotError(ValueError):
    """Code 20: the inputs cannot be compared."""


@dataclass(frozen=True)
class Profile:
    """What an operator declares: statements per receipt, excluded housekeeping rules, and the clocks' skew."""

    version: str = "1"
    max_statements: int | None = None
    exclusions: tuple[tuple[str, str], ...] = ()
    skew_ms: int | None = None

    @staticmethod
    def of(values: dict, flag_skew: str | None = None) -> Profile:
        known = {"v", "version", "multiplicity", "exclusions", "clocks"}
        if extra := set(values) - known:
            raise SnapshotError(f"unknown profile fields: {', '.join(sorted(extra))}")
        most = (values.get("multiplicity") or {}).get("maxStatementsPerReceipt")
        if most is not None and (not isinstance(most, int) or most < 1):
            raise SnapshotError("maxStatementsPerReceipt must be a positive integer")
        skew = (values.get("clocks") or {}).get("skew")
        stated = [duration_ms(s) for s in (flag_skew, skew) if s is not None]
        if len(set(stated)) > 1:
            raise SnapshotError("the skew flag and the profile disagree")
        rules = tuple((e["id"], e["version"]) for e in values.get("exclusions") or ())
        return Profile(str(values.get("version", "1")), most, rules, stated[0] if stated else None)


def duration_ms(text: str) -> int:
    """``250ms``, ``30s``, ``5m`` or ``2h`` in milliseconds."""
    found = re.fullmatch(r"(\d+)(ms|s|m|h)", text.strip())
    if not found:
        raise SnapshotError(f"no duration: {text}")
    return int(found[1]) * {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000}[found[2]]


def _bare(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, '^"|"$', ""))


def tables(sql: Column) -> Column:
    """Distinct (schema, table) of a statement, without the names of its CTEs; schema is null where it is not named."""
    ctes = F.transform(F.regexp_extract_all(sql, F.lit(CTES), 1), _bare)
    first, second = (F.transform(F.regexp_extract_all(sql, F.lit(TABLES), i), _bare) for i in (1, 2))
    pairs = F.transform(
        F.arrays_zip(first.alias("a"), second.alias("b")),
        lambda p: F.struct(
            F.when(p["b"] != "", p["a"]).alias("schema"), F.when(p["b"] != "", p["b"]).otherwise(p["a"]).alias("table")
        ),
    )
    keep = lambda p: ~p["table"].isin(*NO_TABLES) & (p["schema"].isNotNull() | ~F.array_contains(ctes, p["table"]))
    return F.array_distinct(F.filter(pairs, keep))


def classified(patterns: DataFrame, sql: str = "query") -> DataFrame:
    """``kind`` (infrastructure, unattributed, data) and ``tables`` (of users, for data)."""
    system = lambda t: F.coalesce(t["schema"].isin(*SYSTEM_SCHEMAS), F.lit(False)) | (t["schema"].isNull() & t["table"].startswith("pg_"))
    named = patterns.withColumn("_all", tables(F.col(sql))).withColumn("tables", F.filter("_all", lambda t: ~system(t)))
    kind = (
        F.when(F.col(sql).rlike(HOUSEKEEPING), "infrastructure")
        .when(F.size("_all") == 0, "unattributed")
        .when(F.size("tables") == 0, "infrastructure")
        .otherwise("data")
    )
    return named.withColumn("kind", kind).drop("_all")


def check_snapshot(entries: DataFrame) -> None:
    """queryid, query, calls: ids are unique, calls are counts."""
    bad = entries.where(F.col("queryid").isNull() | F.col("calls").isNull() | (F.col("calls") < 0))
    twice = entries.groupBy("queryid").count().where("count > 1")
    if not bad.isEmpty() or not twice.isEmpty():
        raise SnapshotError("snapshot has invalid or repeated entries")


def check_window(before: dict, after: dict) -> None:
    for name in ("role", "source"):
        if before[name] != after[name]:
            raise SnapshotError(f"{name} mismatch: before={before[name]}, after={after[name]}")
    if after["ts"] <= before["ts"]:
        raise SnapshotError("window is empty or inverted")


def deltas(before: DataFrame, after: DataFrame, strict: bool = True) -> DataFrame:
    """queryid, query and delta of the statements with new calls; a counter that fell or vanished is an error."""
    a = after.select("queryid", "query", F.col("calls").alias("now"))
    b = before.select("queryid", F.col("calls").alias("was"))
    both = a.join(b, "queryid", "full")
    delta = F.col("now") - F.coalesce("was", F.lit(0))
    if strict:
        reset = F.col("now").isNull() | (delta < 0)
        delta = F.when(reset, F.raise_error(F.concat(F.lit("counter reset on queryid "), "queryid"))).otherwise(delta)
    return both.select("queryid", "query", delta.cast("long").alias("delta")).where("delta > 0")


def named_objects(receipts: DataFrame) -> DataFrame:
    """receipts: id, ts_ms, tool, target, objects (array). Gives id, ts_ms, tool and table (last part of the name)."""
    target = F.when((F.col("tool") == "describe_table") & (F.col("target") != ""), F.array("target"))
    none = F.array().cast("array<string>")
    every = F.concat(F.coalesce("objects", none), F.coalesce(target, none))
    last = lambda o: F.element_at(F.split(F.lower(o), r"\."), -1)
    return receipts.select("id", "ts_ms", "tool", F.explode(F.transform(every, last)).alias("table"))


def table_evidence(receipts: DataFrame, start: int, end: int) -> DataFrame:
    """table, covered (a receipt in the window names it) and offset (smallest distance of one outside), one row each."""
    outside = F.when(F.col("ts_ms") < start, F.lit(start) - F.col("ts_ms")).when(F.col("ts_ms") > end, F.col("ts_ms") - F.lit(end))
    return (
        named_objects(receipts)
        .withColumn("off", outside)
        .groupBy("table")
        .agg(F.coalesce(F.bool_or(F.col("off").isNull()), F.lit(False)).alias("covered"), F.min("off").cast("long").alias("offset"))
    )


def verdicts(patterns: DataFrame, receipts: DataFrame, start: int, end: int, skew_ms: int | None = None) -> DataFrame:
    """queryid, delta, verdict, uncovered (sorted tables), required_skew, plausible.

    patterns: queryid, query, delta. Every table of a pattern needs a receipt in the window; where all missing ones
    have a receipt outside, the boundary may explain it, within the declared skew."""
    kinds = classified(patterns).select("queryid", "delta", "kind", "tables")
    each = kinds.where("kind = 'data'").select("queryid", F.explode("tables").alias("t")).select("queryid", "t.schema", "t.table")
    seen = each.join(table_evidence(receipts, start, end), "table", "left")
    open_ = ~F.coalesce("covered", F.lit(False))
    name = F.concat_ws(".", "schema", "table")
    found = seen.groupBy("queryid").agg(
        F.array_sort(F.collect_set(F.when(open_, name))).alias("uncovered"),
        F.count_if(open_ & F.col("offset").isNull()).alias("without"),
        F.max(F.when(open_, F.col("offset"))).alias("skew"),
    )
    rows = kinds.join(found, "queryid", "left")
    within = F.lit(True) if skew_ms is None else F.col("skew") <= skew_ms
    maybe = (F.col("without") == 0) & within
    verdict = (
        F.when(F.col("kind") != "data", F.col("kind"))
        .when(F.size("uncovered") == 0, "reconciled")
        .when(maybe, "indeterminate")
        .otherwise("unreconciled")
    )
    rows = rows.withColumn("verdict", verdict)
    unsure = F.col("verdict") == "indeterminate"
    plausible = F.lit(True) if skew_ms is not None else F.col("skew") <= end - start
    return rows.select(
        "queryid", "delta", "verdict", F.coalesce("uncovered", F.array().cast("array<string>")).alias("uncovered"),
        F.when(unsure, F.col("skew")).alias("required_skew"), F.when(unsure, plausible).alias("plausible"),
    )


def receipt_counts(receipts: DataFrame, start: int, end: int) -> DataFrame:
    """One row: receipts in the window, outside it, and in it without a named object."""
    inside = F.coalesce(F.col("ts_ms").between(start, end), F.lit(False))
    named = (F.coalesce(F.size("objects"), F.lit(0)) > 0) | ((F.col("tool") == "describe_table") & (F.coalesce("target", F.lit("")) != ""))
    return receipts.agg(
        F.count_if(inside).alias("in_window"), F.count_if(~inside).alias("out_of_window"),
        F.count_if(inside & ~named & F.col("tool").isin("query", "search")).alias("unassigned"),
    )


def unobserved(receipts: DataFrame, patterns: DataFrame, start: int, end: int) -> DataFrame:
    """id of receipts in the window that name objects of which the counters saw none."""
    seen = classified(patterns).where("kind = 'data'").select(F.explode("tables.table").alias("table")).distinct().withColumn("seen", F.lit(True))
    named = named_objects(receipts).where(F.col("ts_ms").between(start, end)).join(seen, "table", "left")
    return named.groupBy("id").agg(F.bool_or(F.coalesce("seen", F.lit(False))).alias("any")).where("NOT any").select("id")


def exit_code(found: DataFrame) -> DataFrame:
    """One row: 40 for unreconciled or unattributed patterns, else 41 for indeterminate ones, else 0."""
    n = lambda *v: F.count_if(F.col("verdict").isin(*v))
    return found.agg(F.when(n("unreconciled", "unattributed") > 0, 40).when(n("indeterminate") > 0, 41).otherwise(0).alias("code"))


def rule_id(sql: Column) -> Column:
    """Housekeeping rule of a statement: its first word, or the catalog."""
    word = F.lower(F.regexp_extract(sql, r"(?i)^\s*(set|show|begin|commit|rollback|deallocate|discard)\b", 1))
    return F.when(sql.rlike(r"(?i)^\s*select\s+set_config\b"), "set_config").when(word != "", word).otherwise("catalog")


#: The outcomes, and those that are exceptions.
OUTCOMES = ("matched", "excluded", "observed-without-receipt", "receipted-without-observation", "indeterminate")
EXCEPTIONS = OUTCOMES[2:]


def outcomes(patterns: DataFrame, found: DataFrame, silent: DataFrame, profile: Profile | None) -> DataFrame:
    """item, outcome and reason of every pattern and unobserved receipt in the five-outcome form."""
    rows = found.join(patterns.select("queryid", "query"), "queryid")
    declared = [e[0] for e in profile.exclusions] if profile else []
    most = profile.max_statements if profile else None
    v, excluded = F.col("verdict"), rule_id(F.col("query")).isin(*declared) if declared else F.lit(False)
    matched = F.lit(False) if most is None else F.col("delta") <= most
    outcome = (
        F.when(v == "infrastructure", F.when(excluded, "excluded").otherwise("indeterminate"))
        .when(v.isin("unattributed", "indeterminate"), "indeterminate")
        .when(v == "unreconciled", "observed-without-receipt")
        .otherwise(F.when(matched, "matched").otherwise("indeterminate" if most is None else "observed-without-receipt"))
    )
    reason = (
        F.when((v == "infrastructure") & ~excluded, "exclusion-not-in-profile" if profile else "exclusion-undeclared")
        .when(v == "unattributed", "unattributed")
        .when(v == "indeterminate", "window-boundary")
        .when((v == "reconciled") & ~matched, "multiplicity-undeclared" if most is None else "multiplicity-exceeded")
    )
    observed = rows.select(F.col("queryid").alias("item"), outcome.alias("outcome"), reason.alias("reason"))
    quiet = silent.select(F.col("id").cast("string").alias("item"), F.lit("receipted-without-observation").alias("outcome"), F.lit(None).cast("string").alias("reason"))
    return observed.unionByName(quiet)


def projected(items: DataFrame, profile: Profile | None, inputs: dict[str, str], window: tuple[int, int], source: str) -> dict:
    """The result document of the five-outcome form: counts, what was not matched, the bounds that somebody declared, and
    the digests of the inputs (``start``, ``end``, ``receipts`` and ``profile``, as raw texts). Items other than matches
    are what a person reads one by one; there is a row for each statement pattern and each unobserved receipt."""
    import hashlib

    digest = lambda name: "sha256:" + hashlib.sha256(inputs[name].encode()).hexdigest()
    known = dict.fromkeys(OUTCOMES, 0) | {r["outcome"]: r["n"] for r in items.groupBy("outcome").agg(F.count("*").alias("n")).collect()}
    rows = items.where("outcome <> 'matched'").orderBy("outcome", "item").toLocalIterator()
    declared = lambda x: "operator-declared" if x else "undeclared"
    return {
        "v": "reconciliation/2", "window": {"start": window[0], "end": window[1]}, "source": source,
        "snapshots": {"start": digest("start"), "end": digest("end")}, "receipts": digest("receipts"),
        "profile": {"digest": digest("profile"), "version": profile.version} if profile else None,
        "bounds": {
            "multiplicity": declared(profile and profile.max_statements is not None), "skew": declared(profile and profile.skew_ms is not None),
            "exclusion": declared(profile and profile.exclusions),
        },
        "outcome": "exceptions" if any(known[o] for o in EXCEPTIONS) else "no-exceptions",
        "items": [{k: v for k, v in r.asDict().items() if v is not None} for r in rows], "counts": known,
    }


def two_clocks(source: DataFrame, desk: DataFrame, start, end, skipped: tuple[str, ...] = ("catalog",)) -> DataFrame:
    """object and verdict: both ledgers have object and ts, the window is half open, each ledger keeps its own clock."""
    inside = (F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(end))
    seen = source.where(inside & ~F.col("object").isin(*skipped)).select("object").distinct()
    told = desk.groupBy("object").agg(F.bool_or(inside).alias("here"))
    verdict = F.when(F.col("here"), "attributed").when(F.col("here").isNull(), "observed-without-receipt").otherwise("indeterminate")
    return seen.join(told, "object", "left").select("object", verdict.alias("verdict"))

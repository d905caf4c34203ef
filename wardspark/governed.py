"""Governed queries: gate, analysis, lineage, cap, masks; the result is a DataFrame with what the policy did to it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardspark.operators import mask
from wardspark.plans import calls, caps, dialects, gate, lineage, tree
from wardspark.plans.policy import Actor, Policy, PolicyError, rule_for
from wardspark.sources import shared


@dataclass
class Governed:
    """``df`` has the columns of the query; ``counted`` has ``_masked`` and ``_classes`` besides."""

    df: DataFrame
    counted: DataFrame
    policy: Policy
    tables: tuple[str, ...]
    functions: tuple[str, ...]
    masked_fields: tuple[str, ...]
    flags: tuple[str, ...] = field(default=())

    def checked(self, limit: int = caps.PAYLOAD_BYTES) -> DataFrame:
        """``df``, or PolicyError if its rows take more than ``limit`` bytes as JSON."""
        return caps.within_payload(self.df, limit)

    def summary(self) -> DataFrame:
        """rows, masked_count and decision of the access, in one pass over the capped result."""
        masked = F.coalesce(F.sum("_masked"), F.lit(0)).cast("long")
        out = self.counted.agg(F.count("*").alias("rows"), masked.alias("masked_count"))
        return out.withColumn("decision", F.when(F.col("masked_count") > 0, "partial").otherwise("allow"))


def admitted(spark: SparkSession, sql: str, policy: Policy) -> tuple[gate.Admitted, DataFrame, lineage.Lineage]:
    """Gate and lineage; nothing has run yet."""
    text = dialects.to_spark(sql, policy)
    seen = gate.admit(spark, text, policy)
    runs = calls.rewritten(seen.sql, calls.RULES)
    if runs != seen.sql:
        runs = gate.admit(spark, runs, policy, calls.NATIVE).sql
    gate.check_text(runs)  # once more on what runs, whatever the gate made of it
    df = spark.sql(runs)
    return seen, df, lineage.trace(tree.analyzed(df), policy)


@contextmanager
def _recursion_of_any_size(spark: SparkSession) -> Iterator[None]:
    """Spark ends a recursive statement beyond a fixed number of rows (1,000,000) with an error; its limit of 100 levels
    stays, so that a recursion without an end still fails."""
    key = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def query(
    spark: SparkSession, sql: str, policy: Policy, actor: Actor | None = None, scan: bool = True, carry: bool = True, cap: bool = True
) -> Governed:
    """The rows of a query that the policy lets through, masked; PolicyError if it refuses.

    The cap stands inside the masks, so detectors see at most ``max_rows`` rows. Masks stand above the query: filters,
    joins and groups work on the stored values. Scans look at the rows more than once, and a limit without an order may
    choose other rows each time; so the capped rows are stored once, in the folder that the cluster shares, and the query
    runs once (``shared.release`` deletes them). Of a statement without an order and a limit, the first rows by its columns
    from left to right are kept.

    Without ``cap`` all rows are given, for jobs whose result is a table and no answer to a caller; that is for the code to
    say, as a policy always has a cap. Known values come to the driver, so nothing can be carried over then: where a
    result has masked columns beside texts, it is refused unless ``carry`` is off."""
    policy = policy.for_actor(actor)
    seen, df, traced = admitted(spark, sql, policy)
    by_key = [i for i, n in enumerate(df.columns) if rule_for(policy.masks, n)]
    positions = sorted({*traced.masked_positions(), *by_key})
    plan = tree.analyzed(df)
    if cap:
        ordered = df if caps.chosen(plan) else caps.in_column_order(df, positions)
        capped = caps.cap_rows(ordered, policy.max_rows)
    else:
        capped = df
    recursive = any(node.kind == "UnionLoop" for node in plan.walk())
    if scan or recursive:
        with _recursion_of_any_size(spark) if recursive else nullcontext():
            capped = shared.stored(capped.toDF(*(f"c{i}" for i in range(len(df.columns))))).toDF(*df.columns)
    fields = tuple(dict.fromkeys(df.columns[i] for i in positions))
    cells = F.lit(len(positions)).cast("long")
    masked = mask.mask_positions(capped, positions)
    if len(set(df.columns)) < len(df.columns) or not scan:
        counted = masked.withColumn("_masked", cells)
        return Governed(masked, counted, policy, seen.tables, seen.functions, fields)
    skip = set(fields)
    hits = [c for c in mask.numbers_with_hits(masked) if c not in skip]
    masked = masked.withColumns({c: mask.col(c).cast("string") for c in hits}) if hits else masked
    named = [f.name for f in masked.schema if f.name not in skip and mask.label_by_name(f.name) and isinstance(f.dataType, (T.StringType, T.NumericType))]
    by_name = sum((F.when(mask.truthy(mask.col(c), masked.schema[c].dataType), 1).otherwise(0) for c in named), cells)
    counted = mask.scan_texts(mask.mask_by_name(masked.withColumn("_named", by_name), skip), policy.detectors(), skip | set(named) | {"_named"})
    counted = counted.withColumn("_masked", F.col("_masked") + F.col("_named")).drop("_named")
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in skip]
    if carry and positions and texts:
        if not cap:
            raise ValueError("values of masked columns are carried over in capped results only")
        raw = capped.toDF(*(f"c{i}" for i in range(len(df.columns))))
        values = mask.known_values(raw, [f"c{i}" for i in positions if isinstance(df.schema[i].dataType, T.StringType)] or [f"c{positions[0]}"])
        counted = mask.carry_over(counted, values, texts)
        counted = counted.withColumn("_masked", F.col("_masked") + F.col("_carried")).drop("_carried")
    counted = mask.split_ids(counted)
    counted = counted.withColumn("_masked", F.col("_masked") + F.col("_split")).drop("_split")
    return Governed(counted.drop("_masked", "_classes"), counted, policy, seen.tables, seen.functions, fields)


def decision(spark: SparkSession, sql: str, policy: Policy) -> tuple[str, str | None]:
    """``allow`` or ``deny`` with the reason; nothing runs."""
    try:
        admitted(spark, sql, policy)
    except PolicyError as error:
        return "deny", error.reason
    return "allow", None


class Executors:
    """Named functions of an operator that run gated SQL elsewhere; they never see a statement that was not admitted."""

    def __init__(self):
        self.functions: dict[str, Callable[[str], DataFrame]] = {}

    def register(self, name: str, function: Callable[[str], DataFrame]) -> None:
        self.functions[name] = function

    def run(self, spark: SparkSession, name: str, sql: str, policy: Policy) -> DataFrame:
        if not policy.allows_connector(name):
            raise PolicyError(f"Connector '{name}' is not permitted by policy.")
        seen = gate.admit(spark, dialects.to_spark(sql, policy), policy)
        return caps.cap_rows(normalised(spark, name, self.functions[name](seen.sql)), policy.max_rows)


def normalised(spark: SparkSession, name: str, out) -> DataFrame:
    """What an executor gave, as rows: a DataFrame, or a list of records of which all must be dictionaries; the columns
    of records are the names of all of them, in the order in which they first occur."""
    if isinstance(out, DataFrame):
        return out
    if not isinstance(out, list) or not all(isinstance(r, dict) for r in out):
        raise TypeError(f"executor {name} must return a DataFrame or a list of records")
    names = list(dict.fromkeys(k for r in out for k in r))
    if not names:
        return spark.createDataFrame([], "value string")
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in out], names)

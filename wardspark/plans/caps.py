"""Limits on rows and bytes of a result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardspark.plans.policy import PolicyError
from wardspark.plans.tree import Node

PAYLOAD_BYTES = 50_000


def cap_rows(df: DataFrame, rows: int) -> DataFrame:
    """Never more than ``rows``; an inner limit that is smaller stays, an offset stays inside."""
    return df.limit(rows)


def chosen(plan: Node) -> bool:
    """Whether a statement (its analyzed plan) says itself which rows come first or how many: an order or a limit on top."""
    while plan.kind in ("Project", "WithCTE", "Offset") and plan.children:
        plan = plan.children[-1]
    return plan.kind in ("GlobalLimit", "LocalLimit") or plan.kind == "Sort" and plan.fields.get("global") is True


def orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(orderable(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return orderable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType, T.CalendarIntervalType))


def in_column_order(df: DataFrame, hidden: list[int]) -> DataFrame:
    """``df`` ordered by its columns from left to right, so that a cap takes the same rows each time. Columns at ``hidden``
    come last, as the rows that are chosen would tell of their values otherwise."""
    fields = df.schema.fields
    by = [i for i in sorted(range(len(fields)), key=lambda i: (i in hidden, i)) if orderable(fields[i].dataType)]
    if not by:
        return df
    plain = df.toDF(*(f"c{i}" for i in range(len(fields))))
    return plain.orderBy(*(F.asc_nulls_last(f"c{i}") for i in by)).toDF(*df.columns)


def truncated(df: DataFrame, rows: int) -> tuple[DataFrame, bool]:
    """The capped rows, and whether there were more; reads one row beyond the cap."""
    more = df.limit(rows + 1)
    return df.limit(rows), more.count() > rows


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row as JSON; columns that are null are not written."""
    return F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))))


def payload_bytes(df: DataFrame) -> DataFrame:
    return df.agg(F.coalesce(F.sum(row_bytes(df)), F.lit(0)).cast("long").alias("bytes"))


#: Fixed value: the refusal of a result that is too large.
TOO_LARGE = "Response payload exceeds 50KB limit. Aggregation or massive row detected."


def within_payload(df: DataFrame, limit: int = PAYLOAD_BYTES) -> DataFrame:
    """``df``, or PolicyError if its rows take more than ``limit`` bytes. Reads it once more: give it what is stored."""
    if payload_bytes(df).first()["bytes"] > limit:
        raise PolicyError(TOO_LARGE)
    return df


def largest_prefix(df: DataFrame, order: list[str], rows: int, budget: int = PAYLOAD_BYTES) -> DataFrame:
    """The longest prefix in ``order`` of at most ``rows`` rows whose JSON fits ``budget``.

    The rows are limited first (TakeOrderedAndProject), so the running sum sees no more than ``rows`` of them."""
    few = df.orderBy(*order).limit(rows).withColumn("_bytes", row_bytes(df))
    running = F.sum("_bytes").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return few.withColumn("_sum", running).where(F.col("_sum") <= budget).drop("_bytes", "_sum")

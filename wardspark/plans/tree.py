"""Catalyst plans as Python trees. A whole plan comes over in one call, as JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Node:
    kind: str
    fields: dict[str, Any]
    children: list[Node]

    def inner(self) -> Iterator[Node]:
        """Trees in the fields: expressions, and plans that no child index names."""
        for value in self.fields.values():
            yield from _nodes(value)

    def walk(self) -> Iterator[Node]:
        """This node and all below it, expressions and subquery plans too."""
        yield self
        for node in (*self.children, *self.inner()):
            yield from node.walk()

    def trees(self, name: str) -> list[Node]:
        return list(_nodes(self.fields.get(name)))


def _nodes(value: Any) -> Iterator[Node]:
    if isinstance(value, Node):
        yield value
    elif isinstance(value, list):
        for v in value:
            yield from _nodes(v)
    elif isinstance(value, dict):
        for v in value.values():
            yield from _nodes(v)


def _is_tree(value: Any) -> bool:
    return isinstance(value, list) and bool(value) and isinstance(value[0], dict) and "class" in value[0]


def build(flat: list[dict]) -> Node:
    """From the preorder list of Catalyst's JSON form."""
    rest = iter(flat)

    def one() -> Node:
        raw = next(rest)
        fields = {k: _value(v) for k, v in raw.items() if k not in ("class", "num-children")}
        return Node(raw["class"].rsplit(".", 1)[-1].rstrip("$"), fields, [one() for _ in range(raw["num-children"])])

    return one()


def _value(value: Any) -> Any:
    if _is_tree(value):
        return build(value)
    if isinstance(value, list):
        return [_value(v) for v in value]
    if isinstance(value, dict):
        return {k: _value(v) for k, v in value.items()}
    return value


def names(value: Any) -> list[str]:
    """Parts of a name, which the JSON form writes as ``[a, b]``."""
    return value.strip("[]").split(", ") if isinstance(value, str) and value != "[]" else []


def parsed(spark: SparkSession, sql: str) -> Node:
    parser = spark._jsparkSession.sessionState().sqlParser()
    return build(json.loads(parser.parsePlan(sql).toJSON()))


def analyzed(df: DataFrame) -> Node:
    return build(json.loads(df._jdf.queryExecution().analyzed().toJSON()))

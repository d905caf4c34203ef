"""Column lineage over the analyzed plan: which outputs derive from masked columns, and where protected ones stand.

Catalyst has resolved aliases, CTEs and subqueries, so a column is its expression id. Ids are tainted bottom-up;
unions, recursive loops and references to CTEs hand taint over by position. A loop is traced until nothing new is
tainted. A plan node that is not known here is refused, as its outputs could not be traced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from wardspark.plans.policy import Policy, PolicyError, rule_for
from wardspark.plans.tree import Node, names

NO_NAME = "Query output expression references a masked column but has no reliable output name to redact."
UNTRACED = "Query plan node '{}' cannot be traced and is not permitted."
#: Expressions that hand a column over unchanged.
_PLAIN = frozenset({"Alias", "Cast", "AttributeReference", "OuterReference"})
#: Nodes whose outputs are those of their child, and leaves whose outputs are no stored columns.
_THROUGH = frozenset({
    "CTERelationDef", "Deduplicate", "Distinct", "Filter", "GlobalLimit", "LocalLimit", "Offset", "Sort", "SubqueryAlias", "View",
})
_LEAVES = frozenset({"LocalRelation", "OneRowRelation"})


@dataclass
class Lineage:
    outputs: list[int]
    masked: dict[int, str]  # rule by expression id
    protected: dict[int, str]  # shown name by expression id
    sources: dict[int, str] = field(default_factory=dict)  # plain output name by expression id

    def masked_positions(self) -> list[int]:
        return [i for i, e in enumerate(self.outputs) if e in self.masked]


def _id(node: Node) -> int:
    return node.fields["exprId"]["id"]


def trace(plan: Node, policy: Policy) -> Lineage:
    """Lineage of an analyzed plan; PolicyError if a masked output has no name or a protected column stands where it
    may not."""
    return _Trace(policy).run(plan)


class _Trace:
    def __init__(self, policy: Policy):
        self.policy = policy
        self.masked: dict[int, str] = {}
        self.protected: dict[int, str] = {}
        self.ctes: dict[int, list[int]] = {}
        self.columns: dict[int, str] = {}

    def run(self, plan: Node) -> Lineage:
        return Lineage(self.visit(plan), self.masked, self.protected, self.columns)

    def visit(self, node: Node) -> list[int]:
        """Output ids of a plan node. A node may be visited again: taint only grows."""
        kind = node.kind
        if kind == "WithCTE":
            *defs, main = node.children
            for d in defs:
                self.ctes[d.fields["id"]] = self.visit(d)
            return self.visit(main)
        if kind in ("CTERelationRef", "UnionLoopRef"):
            outputs = [_id(a) for a in node.trees("output")]
            self.hand_over(self.ctes[node.fields["cteId" if kind == "CTERelationRef" else "loopId"]], outputs)
            return outputs
        if kind in ("LogicalRelation", "HiveTableRelation", "DataSourceV2Relation"):
            return self.source(node)
        if kind == "UnionLoop":
            return self.loop(node)
        children = [self.visit(c) for c in node.children]
        if kind == "Union":
            for other in children[1:]:
                self.hand_over(other, children[0])
            return children[0]
        for name in node.fields:
            for e in node.trees(name):
                self.subqueries(e)
        self.positions(node, children)
        lists = {"Project": "projectList", "Aggregate": "aggregateExpressions"}
        if kind in lists:
            return [self.project(e) for e in node.trees(lists[kind])]
        if kind == "Window":
            return children[0] + [self.project(e) for e in node.trees("windowExpressions")]
        if kind in ("Intersect", "Except") and len(children) == 2:
            self.hand_over(children[1], children[0])
            return children[0]
        if kind == "Join":
            semi = any(w in str(node.fields.get("joinType")) for w in ("LeftSemi", "LeftAnti"))
            return children[0] if semi else [i for c in children for i in c]
        if kind in _THROUGH and len(children) == 1:
            return children[0]
        if kind in _LEAVES:
            return [_id(a) for a in node.trees("output")]
        raise PolicyError(UNTRACED.format(kind))

    def loop(self, node: Node) -> list[int]:
        """A recursive CTE: its own ids take over from the anchor and from every turn, until nothing changes."""
        anchor = self.visit(node.children[0])
        own = [x["id"] for x in node.fields["outputAttrIds"]]
        if len(own) != len(anchor):
            raise PolicyError(UNTRACED.format(node.kind))
        self.ctes[node.fields["id"]] = own
        self.hand_over(anchor, own)
        size = -1
        while size != (size := len(self.masked) + len(self.protected)):
            self.hand_over(self.visit(node.children[1]), own)
        return own

    def source(self, node: Node) -> list[int]:
        table = ((node.fields.get("catalogTable") or {}).get("identifier")) or {}
        outputs = []
        for a in node.trees("output"):
            name, e = a.fields["name"], _id(a)
            outputs.append(e)
            self.columns[e] = name.lower()
            where = (name.lower(), table.get("table"), table.get("database"))
            if rule := rule_for(self.policy.masks, *where):
                self.masked[e] = rule
            if rule := rule_for(self.policy.protected_columns, *where):
                shown = rule if "." in rule and not rule.startswith("*.") else ".".join(x for x in (table.get("table"), name) if x)
                self.protected[e] = shown
        return outputs

    def hand_over(self, given: list[int], taken: list[int]) -> None:
        if len(given) != len(taken):
            raise PolicyError(UNTRACED.format("of unequal sides"))
        for a, b in zip(given, taken, strict=True):
            for taint in (self.masked, self.protected, self.columns):
                if a in taint:
                    taint.setdefault(b, taint[a])

    def subqueries(self, e: Node) -> None:
        for node in e.walk():
            plan = node.fields.get("plan")
            plan = plan.plan if isinstance(plan, _Done) else plan
            if isinstance(plan, Node):
                node.fields["plan"] = _Done(self.visit(plan), plan)

    def taint(self, e: Node, of: dict[int, str]) -> str | None:
        for node in e.walk():
            if node.kind == "AttributeReference" and _id(node) in of:
                return of[_id(node)]
            done = node.fields.get("plan")
            if isinstance(done, _Done):
                for i in done.outputs:
                    if i in of:
                        return of[i]
        return None

    def project(self, e: Node) -> int:
        own = _id(e)
        if e.kind != "Alias":
            return own
        plain = all(n.kind in _PLAIN for n in e.walk())
        if rule := self.taint(e, self.masked):
            self.masked[own] = rule
            if "explicitMetadata" in e.fields and not plain:  # Spark made the name up
                raise PolicyError(NO_NAME)
        if shown := self.taint(e, self.protected):
            if not plain:
                self.forbid(shown, "SELECT")
            self.protected[own] = shown
        if plain and (column := self.taint(e, self.columns)):
            self.columns[own] = column
        return own

    def positions(self, node: Node, children: list[list[int]]) -> None:
        if not self.protected:
            return
        having = node.kind == "Filter" and node.children and node.children[0].kind == "Aggregate"
        places = {
            "Filter": [("condition", "HAVING" if having else "WHERE")],
            "Join": [("condition", "JOIN")],
            "Aggregate": [("groupingExpressions", "GROUP BY")],
            "Sort": [("order", "ORDER BY")],
            "Window": [("partitionSpec", "GROUP BY"), ("orderSpec", "ORDER BY")],
            "Deduplicate": [("keys", "GROUP BY")],
        }.get(node.kind, [])
        for name, place in places:
            for e in node.trees(name):
                if shown := self.taint(e, self.protected):
                    self.forbid(shown, place)
        if node.kind in ("Distinct", "Intersect", "Except"):  # all of them compare whole rows
            if shown := next((self.protected[i] for c in children for i in c if i in self.protected), None):
                self.forbid(shown, "GROUP BY")

    def forbid(self, shown: str, place: str):
        raise PolicyError(f'protected column "{shown}" may not appear in {place}', flags=("protected-column-denied",))


@dataclass
class _Done:
    """A subquery plan that has been traced, and what to trace again in a loop."""

    outputs: list[int]
    plan: Node

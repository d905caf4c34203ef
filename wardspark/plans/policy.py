"""Policies: which tables, functions and rows a query may reach, and which columns are masked or protected."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from typing import Any

from wardspark.functions import patterns as P
from wardspark.functions.custom import CustomPattern, vetted
from wardspark.functions.names import glob, leaf
from wardspark.functions.scan import Detectors

MAX_ROWS, DEFAULT_ROWS, COSTLY_ROWS = 10000, 100, 500
DIALECTS = ("spark", "postgres", "mssql", "oracle")


class PolicyError(Exception):
    """A refusal: the reason, the tables seen so far, and flags for the record."""

    def __init__(self, reason: str, tables: tuple[str, ...] = (), flags: tuple[str, ...] = ()):
        super().__init__(reason)
        self.reason, self.tables, self.flags = reason, tables, flags


def unavailable(error: PolicyError) -> str:
    """What the caller may read: a denied and a missing table look alike; the record keeps the reason."""
    return "The requested table is not available." if error.reason.startswith("Access to table") else error.reason


@dataclass(frozen=True)
class Profile:
    """What may differ for one identified person: how much is readable, never what is reachable."""

    mask_columns: tuple[str, ...] | None = None
    max_rows: int | None = None
    mask_labelled_names: bool | None = None


@dataclass(frozen=True)
class Actor:
    id: str
    per_user: bool = False


@dataclass(frozen=True)
class Policy:
    allow_tables: tuple[str, ...] = ()
    deny_tables: tuple[str, ...] = ()
    mask_columns: tuple[str, ...] = ()
    protected_columns: tuple[str, ...] = ()
    max_rows: int = DEFAULT_ROWS
    dialect: str = "spark"
    mask_labelled_names: bool = True
    allow_tools: tuple[str, ...] = ()
    deny_tools: tuple[str, ...] = ()
    allow_connectors: tuple[str, ...] = ()
    deny_connectors: tuple[str, ...] = ()
    profiles: Mapping[str, Profile] = field(default_factory=dict)
    actor_profiles: Mapping[str, str] = field(default_factory=dict)
    scan_chars: int = P.SCAN_CHARS
    detect_ip: bool = False
    detect_mrz: bool = True
    custom_patterns: tuple[CustomPattern, ...] = ()
    allow_set_ops: bool = False
    allow_exists: bool = False
    profile: str | None = None

    def __post_init__(self):
        if not (isinstance(self.max_rows, int) and 0 < self.max_rows <= MAX_ROWS):
            raise ValueError(f"max_rows must be from 1 to {MAX_ROWS}")
        if not 1 <= self.scan_chars <= P.SCAN_CHARS_MAX:
            raise ValueError(f"scan_chars must be from 1 to {P.SCAN_CHARS_MAX}")
        if self.dialect not in DIALECTS:
            raise ValueError(f"unknown dialect {self.dialect!r}")
        if self.protected_columns and self.dialect in ("mssql", "oracle"):
            raise ValueError(f"dialect {self.dialect!r} cannot enforce protected columns")
        vetted(self.custom_patterns)

    @staticmethod
    def of(values: Mapping[str, Any]) -> Policy:
        """From plain values; unknown names are refused, lists become tuples."""
        known = {f.name for f in fields(Policy)} - {"profile"}
        if extra := sorted(set(values) - known):
            raise ValueError(f"unknown policy fields: {', '.join(extra)}")
        made = {k: tuple(v) if isinstance(v, list) else v for k, v in values.items()}
        if "profiles" in made:
            names = {f.name for f in fields(Profile)}
            for name, profile in made["profiles"].items():
                if extra := sorted(set(profile) - names):
                    raise ValueError(f"profile {name} has unknown fields: {', '.join(extra)}")
            made["profiles"] = {n: Profile(**{k: tuple(v) if isinstance(v, list) else v for k, v in p.items()}) for n, p in made["profiles"].items()}
        if "custom_patterns" in made:
            made["custom_patterns"] = tuple(c if isinstance(c, CustomPattern) else CustomPattern(**c) for c in made["custom_patterns"])
        return Policy(**made)

    def for_actor(self, actor: Actor | None) -> Policy:
        """The policy with the person's profile; anything unexpected gives the base policy."""
        name = self.actor_profiles.get(actor.id) if actor and actor.per_user else None
        profile = self.profiles.get(name) if name else None
        if profile is None:
            return self
        changes = {f.name: v for f in fields(Profile) if (v := getattr(profile, f.name)) is not None}
        return replace(self, **changes, profile=name)

    @property
    def id(self) -> str:
        return f"policy/{self.profile}" if self.profile else "policy"

    @property
    def masks(self) -> tuple[str, ...]:
        return self.mask_columns + self.protected_columns

    @property
    def costly(self) -> bool:
        return self.max_rows > COSTLY_ROWS

    def detectors(self) -> Detectors:
        return Detectors(self.detect_ip, self.detect_mrz, self.mask_labelled_names, self.scan_chars, self.custom_patterns)

    def allows_table(self, name: str) -> bool:
        parts = name.strip().split(".")
        return len(parts) == 2 and all(parts) and _allowed(name, self.allow_tables, self.deny_tables, False)

    def allows_tool(self, name: str) -> bool:
        """Open unless narrowed: tables are the door."""
        return _allowed(name, self.allow_tools, self.deny_tools, True)

    def allows_connector(self, name: str) -> bool:
        return _allowed(name, self.allow_connectors, self.deny_connectors, False)


def _allowed(name: str, allow: tuple[str, ...], deny: tuple[str, ...], unset: bool) -> bool:
    if any(glob(p, name) for p in deny):
        return False
    return any(glob(p, name) for p in allow) if allow else unset


def rule_for(rules: tuple[str, ...], column: str, table: str | None = None, schema: str | None = None) -> str | None:
    """The first rule that names a column in any of its spellings, or by its last part."""
    spellings = [column]
    if table:
        spellings.append(f"{table}.{column}")
    if schema:
        spellings += [f"{schema}.{column}"] + ([f"{schema}.{table}.{column}"] if table else [])
    return next((r for r in rules if any(glob(r, s) for s in spellings) or leaf(r.strip()) == column.lower()), None)

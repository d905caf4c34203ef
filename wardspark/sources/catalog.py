"""Tables that policies can name: Parquet folders as a database, their description, and sources by name."""

from __future__ import annotations

import re
from abc import ABC, abstractmethod
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardspark.plans import caps
from wardspark.plans.policy import Policy, PolicyError

DATABASE = "tpch"
DESCRIBED_TABLES = 30
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)


def register(spark: SparkSession, folder: str, database: str = DATABASE, tables: tuple[str, ...] = TABLES) -> None:
    """Unmanaged tables ``database.name`` over the Parquet files of a folder; only their definitions are kept.

    All sessions of an application share the definitions, and each of them keeps the files of the tables that it has read. So
    every call holds the definitions against the folder, and the session forgets those files."""
    if not spark.catalog.databaseExists(database):
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    place = spark._jvm.org.apache.hadoop.fs.Path
    whole = place(folder).getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place(folder)).toString()
    state = spark._jsparkSession.sessionState()
    known, parser = state.catalog(), state.sqlParser()
    for name in tables:
        table = parser.parseTableIdentifier(f"{database}.{name}")
        if known.tableExists(table):
            uri = known.getTableMetadata(table).storage().locationUri()
            if uri.isDefined() and place(uri.get()).toString() == f"{whole}/{name}.parquet":
                continue
            spark.sql(f"DROP TABLE {database}.{name}")
        spark.catalog.createTable(f"{database}.{name}", path=f"{folder.rstrip('/')}/{name}.parquet", source="parquet")
    known.invalidateAllCachedTables()


def table_names(spark: SparkSession, policy: Policy) -> list[str]:
    """Tables of all databases that the policy allows, without system schemas."""
    names = [f"{d.name}.{t.name}" for d in spark.catalog.listDatabases() for t in spark.catalog.listTables(d.name) if not t.isTemporary]
    return sorted(n for n in names if policy.allows_table(n))


def describe(spark: SparkSession, table: str, policy: Policy) -> DataFrame:
    """column_name, data_type, nullable and description of an allowed table."""
    if not policy.allows_table(table) or not spark.catalog.tableExists(table):
        raise PolicyError(f"Access to table '{table}' is not permitted by policy.")
    rows = [(f.name, f.dataType.simpleString(), f.nullable, f.metadata.get("comment")) for f in spark.table(table).schema]
    return caps.within_payload(spark.createDataFrame(rows, "column_name string, data_type string, nullable boolean, description string"))


def schema_resource(spark: SparkSession, policy: Policy) -> dict[str, list[str]]:
    """Columns of the first allowed tables."""
    return {t: spark.table(t).columns for t in table_names(spark, policy)[:DESCRIBED_TABLES]}


def with_descriptions(df: DataFrame, descriptions: dict[str, str]) -> DataFrame:
    """Business descriptions as comments of columns."""
    fields = [F.col(f"`{f.name}`").alias(f.name, metadata=dict(f.metadata) | {"comment": descriptions[f.name]}) if f.name in descriptions else F.col(f"`{f.name}`") for f in df.schema]
    return df.select(*fields)


class Source(ABC):
    """A named source: what it can do, its tables, and rows."""

    can: frozenset[str] = frozenset()

    @abstractmethod
    def tables(self) -> list[str]: ...

    @abstractmethod
    def describe(self, table: str) -> T.StructType: ...

    def query(self, sql: str) -> DataFrame:
        raise PolicyError("This source cannot run queries.")

    def search(self, term: str, table: str | None = None) -> DataFrame:
        raise PolicyError("This source cannot search.")


class MemorySource(Source):
    """Rows held in the session: stand-ins for services that this library does not reach."""

    can = frozenset({"schema", "describe", "search"})

    def __init__(self, frames: dict[str, DataFrame]):
        self.frames = frames

    def tables(self) -> list[str]:
        return sorted(self.frames)

    def describe(self, table: str) -> T.StructType:
        return self.frames[table].schema

    def search(self, term: str, table: str | None = None) -> DataFrame:
        df = self.frames[table or self.tables()[0]]
        texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
        hit = F.lit(False)
        for c in texts:
            hit = hit | F.contains(F.lower(F.col(f"`{c}`")), F.lit(term.lower()))
        return df.where(hit).withColumn("_table", F.lit(table or self.tables()[0]))


FACTORIES: dict[str, Callable[..., Source]] = {"memory": MemorySource}


def make_source(kind: str, **config) -> Source:
    if kind not in FACTORIES:
        raise ValueError(f"unknown source type {kind!r}")
    return FACTORIES[kind](**config)


def choose(sources: dict[str, Source], policy: Policy, wanted: str | None = None, ability: str = "query") -> str:
    """The named source, or the first allowed one with the ability, or the first allowed one."""
    allowed = [n for n in sources if policy.allows_connector(n)]
    if wanted is not None:
        if wanted not in allowed:
            raise PolicyError(f"Connector '{wanted}' is not permitted by policy.")
        return wanted
    able = [n for n in allowed if ability in sources[n].can]
    if not allowed:
        raise PolicyError("No connector is permitted by policy.")
    return (able or allowed)[0]


_REST = re.compile(r"\s*select\s+(\*|[\w\s,]+?)\s+from\s+(\w+)\.(\w+)(?:\s+limit\s+(\d+))?\s*;?\s*", re.IGNORECASE)
REST_LIMIT, REST_LIMIT_MAX = 20, 100


def rest_query(frames: dict[str, DataFrame], sql: str, schema: str = "public") -> DataFrame:
    """The form that a REST source understands: columns or * of one table, with a limit."""
    found = _REST.fullmatch(sql)
    if not found:
        raise PolicyError("Only SELECT columns FROM schema.table [LIMIT n] is supported by this source.")
    columns, space, name, limit = found.groups()
    if space.lower() != schema or name.lower() not in frames:
        raise PolicyError(f"Access to table '{space}.{name}' is not permitted by policy.")
    df = frames[name.lower()]
    rows = min(max(int(limit or REST_LIMIT), 1), REST_LIMIT_MAX)
    return (df if columns.strip() == "*" else df.select(*(c.strip() for c in columns.split(",")))).limit(rows)

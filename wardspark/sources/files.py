"""Text files, API descriptions and record files."""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardspark.plans.policy import PolicyError
from wardspark.sources import shared

#: Bounds of a folder of documents.
FILE_BYTES, FILES = 256_000, 1000
DOCS_SCHEMA = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("content", T.StringType()), T.StructField("_table", T.StringType())]
)


def scope_of(path: Column) -> Column:
    """Name of a document: its path below the folder in small letters, with one underscore for each run of other signs."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(path), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(slug == "", "document").otherwise(slug)


def read_docs(spark: SparkSession, folder: str) -> DataFrame:
    """path, content and _table of the .md and .txt files below a folder, and file, relative (path below the folder) and
    scope, which names a file even where two folders hold the same file name. Larger files are left out by their length, and files whose names
    begin with a dot or an underscore because Spark does not list them."""
    names = r".*\.(md|txt)$"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    picked = files.where(F.lower("path").rlike(names) & (F.col("length") <= FILE_BYTES))
    content = F.decode("content", "UTF-8")
    slug = F.regexp_replace(F.regexp_replace(F.lower("path"), r"^.*/", ""), r"\.(md|txt)$", "")
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")
    relative = F.substr("path", F.lit(len(root) + 2))
    return picked.select(
        "path", content.alias("content"), F.concat(F.lit("docs."), slug).alias("_table"), F.regexp_extract("path", r"[^/]*$", 0).alias("file"),
        relative.alias("relative"), scope_of(relative).alias("scope"),
    ).orderBy("path").limit(FILES)


def endpoints(spec: dict[str, Any]) -> list[dict[str, str]]:
    """Every path and method of an API description as a table ``api."GET /x"``."""
    methods = ("get", "post", "put", "patch", "delete", "head", "options")
    return [
        {
            "table": f'api."{m.upper()} {path}"', "method": m.upper(), "path": path,
            "summary": op.get("summary", ""), "description": op.get("description", ""),
        }
        for path, ops in spec.get("paths", {}).items() for m, op in ops.items() if m in methods
    ]


def _resolved(spec: dict, node: dict, seen: frozenset[str] = frozenset()) -> dict:
    ref = node.get("$ref")
    if not ref or ref in seen:
        return {} if ref else node
    at: Any = spec
    for part in ref.removeprefix("#/").split("/"):
        at = at.get(part, {}) if isinstance(at, dict) else {}
    return _resolved(spec, at, seen | {ref})


def type_name(spec: dict, node: dict) -> str:
    node = _resolved(spec, node)
    if any(k in node for k in ("oneOf", "anyOf", "allOf")):
        return "union"
    if node.get("type") == "array":
        return f"array<{type_name(spec, node.get('items', {}))}>"
    return node.get("type") or ("object" if "properties" in node else "any")


def describe_endpoint(spec: dict[str, Any], method: str, path: str) -> list[tuple[str, str, bool]]:
    """(name, type, nullable) of parameters, body and response fields."""
    op = spec["paths"][path][method.lower()]
    out = []
    for p in op.get("parameters", ()):
        p = _resolved(spec, p)
        out.append((f"param:{p['name']}", type_name(spec, p.get("schema", {})), not p.get("required", False)))
    parts = [("body", op.get("requestBody", {}))]
    ok = next((op["responses"][c] for c in sorted(op.get("responses", {})) if c.startswith("2")), {})
    for prefix, holder in (*parts, ("response", ok)):
        schema = _resolved(spec, _resolved(spec, holder).get("content", {}).get("application/json", {}).get("schema", {}))
        if schema.get("type") == "array":
            schema = _resolved(spec, schema.get("items", {}))
        required = schema.get("required", ())
        out += [(f"{prefix}:{n}", type_name(spec, s), n not in required) for n, s in schema.get("properties", {}).items()]
    return out


def api_request(spec: dict[str, Any], sql: str) -> str:
    """The path that ``SELECT * FROM api."GET /x/1"`` asks for; only GET, only described paths."""
    found = re.search(r'from\s+api\."([A-Za-z]+)\s+([^"]+)"', sql, re.IGNORECASE)
    if not found:
        raise PolicyError('Only SELECT ... FROM api."GET /path" is supported by this source.')
    method, path = found.group(1).upper(), found.group(2)
    if method != "GET":
        raise PolicyError("Only GET endpoints can be queried.")
    for template in spec.get("paths", {}):
        pattern = re.sub(r"\\\{[^}]+\\\}", "[^/]+", re.escape(template))
        if "get" in spec["paths"][template] and re.fullmatch(pattern, path.split("?")[0]):
            return path
    raise PolicyError(f"Access to table 'api.\"{method} {path}\"' is not permitted by policy.")


def shaped(spark: SparkSession, body: str, rows: int) -> DataFrame:
    """A JSON array as rows, an object as one row, anything else as ``value``; at most ``rows``."""
    value = json.loads(body)
    items = [i if isinstance(i, dict) else {"value": i} for i in (value if isinstance(value, list) else [value])[:rows]]
    if not items:
        return spark.createDataFrame([], "line string")
    text = F.lit(json.dumps(items))
    shape = spark.range(1).select(F.schema_of_json(text).alias("s")).first()["s"]
    return spark.range(1).select(F.explode(F.from_json(text, shape)).alias("r")).select("r.*")


def append_records(df: DataFrame, path: str, order: str | None = None) -> None:
    """Records as JSON lines, through Spark's commit protocol; a failed write leaves nothing behind. With ``order``, the
    lines of this write are in its order: a sort over all executors, whose files are named in the order of their ranges."""
    (df.orderBy(order) if order else df).write.mode("append").json(path)


def append_chain(lines: DataFrame, path: str, order: str = "seq") -> int:
    """Lines of a chain (seq, value) at the end of a log: refused, with nothing written, unless they start where the log
    ends. Gives the last seq. The lines are stored first, so that what is checked is what is written."""
    spark = lines.sparkSession
    lines = shared.stored(lines.select(order, "value"))
    chain = F.from_json("value", "chain STRUCT<seq:BIGINT,prevHash:STRING,hash:STRING>")["chain"]
    ends = lambda df: df.select(chain.alias("c")).agg(F.min(F.struct("c.seq", "c.prevHash")).alias("a"), F.max(F.struct("c.seq", "c.hash")).alias("z")).first()
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    tail, new = ends(spark.read.text(path))["z"] if there else None, ends(lines)
    if new["a"] is None:
        return tail["seq"] if tail else 0
    if tail is None and new["a"]["seq"] != 1 or tail is not None and (new["a"]["seq"], new["a"]["prevHash"]) != (tail["seq"] + 1, tail["hash"]):
        raise ValueError("the lines do not go on where the log ends")
    lines.orderBy(order).select("value").write.mode("append").text(path)
    return new["z"]["seq"]


def snapshot(statements: DataFrame, roles: DataFrame, role: str, source: str, ts: str) -> DataFrame:
    """One row: a snapshot document of the statement counters of a role."""
    rows = statements.join(roles.where(F.col("rolname") == role), statements["userid"] == roles["oid"])
    entry = F.struct(F.col("queryid").cast("string").alias("queryid"), "query", "calls")
    return rows.agg(F.sort_array(F.collect_list(entry)).alias("entries")).select(
        F.to_json(F.struct(F.lit("snapshot/1").alias("v"), F.lit(ts).alias("ts"), F.lit(role).alias("role"), F.lit(source).alias("source"), "entries")).alias("document")
    )

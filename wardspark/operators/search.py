"""Search in texts and endpoints, within the tables that a policy allows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspark.plans.caps import PAYLOAD_BYTES, largest_prefix
from wardspark.plans.policy import Policy, PolicyError

#: Shortest term, results, length of a snippet, best endpoints.
SHORTEST, RESULTS, SNIPPET, ENDPOINTS = 3, 50, 150, 20


def scoped(listed: list[str], policy: Policy, wanted: list[str] | None = None) -> list[str]:
    """Tables that are listed, allowed and, if named, wanted."""
    known = {t.lower(): t for t in listed}
    if wanted:
        for t in wanted:
            if t.lower() not in known or not policy.allows_table(t.lower()):
                raise PolicyError(f"Access to table '{t}' is not permitted by policy.")
    return [t for t in listed if policy.allows_table(t) and (not wanted or t.lower() in {w.lower() for w in wanted})]


def check_term(term: str) -> str:
    if len(term.strip()) < SHORTEST:
        raise PolicyError(f"Search terms need at least {SHORTEST} characters.")
    return term.strip().lower()


def search_texts(df: DataFrame, term: str, key: str, text: str, rows: int = RESULTS, budget: int | None = None) -> DataFrame:
    """key and snippet of the texts that contain a term, in order of key; limited by rows, and by bytes if wanted."""
    hit = F.contains(F.lower(text), F.lit(check_term(term)))
    snippet = F.concat(F.substring(text, 1, SNIPPET), F.lit("..."))
    found = df.where(hit).select(key, snippet.alias("snippet"))
    return found.orderBy(key).limit(rows) if budget is None else largest_prefix(found, [key], rows, budget)


def search_docs(docs: DataFrame, term: str, tables: list[str] | None = None, rows: int = RESULTS, budget: int = PAYLOAD_BYTES) -> DataFrame:
    """_table, file, path and contentSnippet of the documents (path, file, scope, content) whose text or path contains a
    term, in order of path: the longest prefix of at most ``rows`` rows whose JSON fits ``budget``. ``tables`` are scopes,
    with or without ``docs.`` before them. A null text matches by its path alone and has a null snippet."""
    word = F.lit(check_term(term))
    wanted = [t.strip()[5:] if t.strip().lower().startswith("docs.") else t.strip() for t in tables or []]
    inside = docs.where(F.col("scope").isin(wanted)) if wanted else docs
    hit = F.coalesce(F.contains(F.lower("content"), word), F.lit(False)) | F.contains(F.lower("path"), word)
    snippet = F.concat(F.substring("content", 1, SNIPPET), F.when(F.length("content") > SNIPPET, "...").otherwise(""))
    found = inside.where(hit).select(F.concat(F.lit("docs."), "scope").alias("_table"), "file", "path", snippet.alias("contentSnippet"))
    return largest_prefix(found, ["path"], rows, budget)


def search_endpoints(df: DataFrame, term: str, name: str, summary: str, description: str, order: str, rows: int = ENDPOINTS) -> DataFrame:
    """Rows with ``score``: 10 for a hit in the name, 5 in the summary, 3 in the description; ties in input order."""
    word = F.lit(check_term(term))
    score = F.lit(0)
    for column, points in ((name, 10), (summary, 5), (description, 3)):
        score = score + F.when(F.contains(F.lower(column), word), points).otherwise(0)
    return df.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), order).limit(rows)

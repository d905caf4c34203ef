"""Mixing sources to target weights: iterative proportional fitting and calibrated sampling, in DataFrame functions.

Documents are counted into cells of (source, lang, topic); the cells' token weights are raked in turn to the target
shares of the three margins; a document is kept with a probability in proportion to raked weight over tokens of its
cell, capped at 1, with the scale at which the expected tokens meet the budget. The cells depend on the categories,
not on the number of documents, and are summed before the shuffle; a hot source is a few cells. The sums of a margin
are aggregated and joined back, so that no task holds all cells of one category.

Defined cases: a null source or lang is ``unknown``; a null text has no tokens and topic ``empty``; empty cells get
weight 0; a margin without a target keeps its shares; the draw depends on the doc_id and the seed only, so repeated
rows are kept or dropped together, and so are those with a null doc_id (the null counts as the empty text); an empty
table gives no rows; extra columns are kept by ``sample``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.llm.common import stored, table

MARGINS = ("source", "lang", "topic")
ITERATIONS, SCALE_STEPS = 10, 6
#: First rule that matches gives the topic; otherwise it is prose.
TOPICS = (
    ("legal", ("icensed under", "License")),
    ("contact", ("@",)),
    ("listing", (" | ",)),
    ("emphatic", ("!!",)),
)


@dataclass(frozen=True)
class Targets:
    """For each margin either weights by category (others keep their share) or an exponent that flattens shares."""

    source: dict[str, float] | float = 0.7
    lang: dict[str, float] | float = field(default_factory=lambda: {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1})
    topic: dict[str, float] | float = 0.8
    keep: float = 0.5
    seed: str = "mix"


def _topic(text: Column) -> Column:
    out = F.when(F.coalesce(text, F.lit("")) == "", "empty")
    for name, marks in TOPICS:
        hit = F.lit(False)
        for mark in marks:
            hit = hit | F.contains(text, F.lit(mark))
        out = out.when(hit, name)
    return out.otherwise("prose")


def described(docs: DataFrame) -> DataFrame:
    """_row (all columns of ``docs``, whatever their names), _source, _lang, _topic and _tokens (words)."""
    text = F.col("text")
    return docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"),
        F.coalesce(F.col("source").cast("string"), F.lit("unknown")).alias("_source"),
        F.coalesce(F.col("lang").cast("string"), F.lit("unknown")).alias("_lang"),
        _topic(text).alias("_topic"),
        F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f]+")), F.lit(0)).cast("long").alias("_tokens"),
    )


def _target(margin: str, target: dict[str, float] | float) -> Column:
    """Weight of a category before it is normalised to a share."""
    share = F.col(f"share_{margin}")
    if not isinstance(target, dict):
        return F.when(share > 0, F.pow(share, F.lit(float(target)))).otherwise(0.0)
    out = share
    for name, weight in target.items():
        out = F.when(F.col(f"_{margin}") == name, F.lit(float(weight))).otherwise(out)
    return out


def raked(cells: DataFrame, targets: Targets, iterations: int = ITERATIONS) -> DataFrame:
    """Cells (_source, _lang, _topic, tokens) with ``weight``, whose margins meet the target shares."""
    whole = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    base, cells = cells, cells.withColumns({"weight": F.col("tokens").cast("double"), "whole": F.lit(whole)})
    for margin in MARGINS:
        sums = base.groupBy(f"_{margin}").agg(F.sum("tokens").alias("own"))
        shares = sums.withColumn(f"share_{margin}", F.coalesce(F.try_divide(F.col("own").cast("double"), F.lit(whole)), F.lit(0.0)))
        aim = F.when(F.col("own") > 0, _target(margin, getattr(targets, margin))).otherwise(0.0)
        aims = shares.select(f"_{margin}", aim.alias("aim"))
        total = float(aims.agg(F.sum("aim")).first()[0] or 0)
        cells = cells.join(aims.select(f"_{margin}", F.try_divide("aim", F.lit(total)).alias(f"aim_{margin}")), f"_{margin}")
    cells = stored(cells)
    for _ in range(iterations):
        # each iteration is a plan of its own: sums of few categories are joined back by broadcast, as AQE sees their size
        for margin in MARGINS:
            sums = cells.groupBy(f"_{margin}").agg(F.sum("weight").alias("own"))
            aim = F.col(f"aim_{margin}") * F.col("whole")
            weight = F.coalesce(F.try_divide(F.col("weight") * aim, F.col("own")), F.lit(0.0))
            cells = cells.join(sums, f"_{margin}").withColumn("weight", weight).drop("own")
        cells = stored(cells)
    return cells


def calibrated(cells: DataFrame, keep: float) -> DataFrame:
    """Cells with ``probability``: min(1, scale * weight / tokens), expected tokens being ``keep`` of all."""
    ratio = F.coalesce(F.try_divide("weight", F.col("tokens").cast("double")), F.lit(0.0))
    cells, scale = cells.withColumn("ratio", ratio), 0.0
    for _ in range(SCALE_STEPS):
        full = F.col("ratio") * F.lit(scale) >= 1
        row = cells.agg(
            F.sum("tokens").cast("double").alias("whole"),
            F.sum(F.when(full, F.col("tokens")).otherwise(0)).cast("double").alias("full"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("rest"),
        ).first()
        if not row["rest"]:
            break
        scale = max(scale, (keep * row["whole"] - row["full"]) / row["rest"])
    return cells.withColumn("probability", F.least(F.lit(1.0), F.col("ratio") * F.lit(scale)))


def draw(seed: str) -> Column:
    """Uniform in [0, 1) by doc_id."""
    text = F.concat(F.lit(seed), F.coalesce(F.col("_row.doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def weighed(docs: DataFrame, targets: Targets | None = None) -> DataFrame:
    """_row, _source, _lang, _topic, _tokens, _weight, _probability and _selected of every row. One pass counts the cells,
    one joins them back; the side of the cells is broadcast by its size on disk, or else the join is split by AQE."""
    targets = targets or Targets()
    rows = described(docs)
    cells = stored(rows.groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").alias("tokens")))
    known = stored(
        calibrated(raked(cells, targets), targets.keep).select(
            "_source", "_lang", "_topic", F.col("ratio").alias("_weight"), F.col("probability").alias("_probability")
        )
    )
    return rows.join(known, ["_source", "_lang", "_topic"], "left").withColumn("_selected", draw(targets.seed) < F.col("_probability"))


def sample(docs: DataFrame, targets: Targets | None = None) -> DataFrame:
    """The documents drawn, with their own columns."""
    return weighed(docs, targets).where("_selected").select("_row.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighed(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")).select(
        "_row.doc_id",
        F.col("_source").alias("source"),
        F.col("_lang").alias("lang"),
        F.col("_topic").alias("topic"),
        F.col("_tokens").alias("tokens"),
        F.round("_weight", 6).alias("weight"),
        F.round("_probability", 6).alias("probability"),
        F.col("_selected").alias("selected"),
    )


def mixing_sql(targets: Targets | None = None) -> str:
    """The same computation for DuckDB, every raking step a table of its own."""
    targets = targets or Targets()
    rules = "\n".join(
        f"    WHEN {' OR '.join(f'contains(text, {chr(39)}{m}{chr(39)})' for m in marks)} THEN '{name}'" for name, marks in TOPICS
    )
    steps = [
        f"""d AS (
  SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang,
    CASE WHEN coalesce(text, '') = '' THEN 'empty'
{rules}
    ELSE 'prose' END AS topic,
    CAST(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')), 0) AS BIGINT) AS tokens
  FROM documents)""",
        "c AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL)",
        "t AS (SELECT sum(tokens) AS whole FROM c)",
    ]
    for m in MARGINS:
        target = getattr(targets, m)
        if isinstance(target, dict):
            aim = f"CASE {m} " + " ".join(f"WHEN '{k}' THEN {float(v)!r}" for k, v in target.items()) + " ELSE own / whole END"
        else:
            aim = f"pow(own / whole, {float(target)!r})"
        steps.append(
            f"a_{m} AS (SELECT {m}, aim / sum(aim) OVER () AS aim_{m} FROM (SELECT {m}, CASE WHEN own > 0 THEN {aim} ELSE 0 END AS aim "
            f"FROM (SELECT {m}, sum(tokens) AS own FROM c GROUP BY {m}), t))"
        )
    steps.append("w0 AS (SELECT *, tokens AS weight FROM c JOIN a_source USING (source) JOIN a_lang USING (lang) JOIN a_topic USING (topic), t)")
    n = 0
    for _ in range(ITERATIONS):
        for m in MARGINS:
            steps.append(
                f"w{n + 1} AS (SELECT * REPLACE (coalesce(weight * aim_{m} * whole / nullif(sum(weight) OVER (PARTITION BY {m}), 0), 0) AS weight) FROM w{n})"
            )
            n += 1
    steps.append(f"r AS (SELECT *, coalesce(weight / nullif(tokens, 0), 0) AS ratio FROM w{n})")
    steps.append("s0 AS (SELECT CAST(0 AS DOUBLE) AS scale)")
    for k in range(SCALE_STEPS):
        steps.append(
            f"s{k + 1} AS (SELECT greatest(any_value(scale), coalesce(({targets.keep!r} * sum(tokens) - sum(CASE WHEN ratio * scale >= 1 THEN tokens ELSE 0 END)) "
            f"/ nullif(sum(CASE WHEN ratio * scale >= 1 THEN 0 ELSE weight END), 0), 0)) AS scale FROM r, s{k})"
        )
    return (
        "WITH " + ",\n".join(steps) + f"""
SELECT doc_id, source, lang, topic, d.tokens AS tokens, round(ratio, 6) AS weight,
  round(least(1.0, ratio * scale), 6) AS probability,
  CAST('0x' || substr(md5('{targets.seed}' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0
    < least(1.0, ratio * scale) AS selected
FROM d JOIN r USING (source, lang, topic), s{SCALE_STEPS}"""
    )


OP1_SQL = mixing_sql()

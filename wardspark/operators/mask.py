"""Masking: whole columns by policy, texts by detectors, known values across rows, split ids, pseudonyms."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardspark.functions import patterns as P
from wardspark.functions.checks import national_id_column
from wardspark.functions.names import label_by_name
from wardspark.functions.scan import Detectors, Scanner

#: Values of masked columns that are carried over into texts come from a capped result: at most its rows.
SHORTEST_VALUE = 3


def col(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def truthy(c: Column, kind: T.DataType) -> Column:
    """Neither null nor the empty text nor zero."""
    if isinstance(kind, T.StringType):
        return F.coalesce(c != "", F.lit(False))
    return F.coalesce(c != 0, F.lit(False)) if isinstance(kind, T.NumericType) else F.lit(False)


def mask_positions(df: DataFrame, positions: list[int]) -> DataFrame:
    """Columns at ``positions`` become the label, nulls too; names may repeat."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.select(*((F.lit(P.PII) if i in positions else F.col(f"c{i}")).alias(n) for i, n in enumerate(df.columns)))


def mask_by_name(df: DataFrame, skip: set[str] = frozenset()) -> DataFrame:
    """Columns whose name says that they are private or secret: every text or number that is not empty or zero."""
    changes = {}
    for f in df.schema:
        label = label_by_name(f.name)
        if label and f.name not in skip and isinstance(f.dataType, (T.StringType, T.NumericType)):
            changes[f.name] = F.when(truthy(col(f.name), f.dataType), label).otherwise(col(f.name).cast("string"))
    return df.withColumns(changes) if changes else df


def numeric_hit(c: Column) -> Column:
    """Whether an integer reads like an id, a phone number (10 or 11 digits) or a card (13-16 digits, checksum)."""
    text = F.abs(c).cast("decimal(38,0)").cast("string")
    n = F.length(text)
    return F.coalesce(n.isin(10, 11) | (n.between(13, 16) & F.call_function("luhn_check", text)), F.lit(False))


def numbers_with_hits(df: DataFrame) -> list[str]:
    """Integral columns of which at least one value reads like an identifier: one aggregate for all of them."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.IntegralType)]
    if not names:
        return []
    row = df.agg(*(F.max(numeric_hit(col(n))).alias(f"h{i}") for i, n in enumerate(names))).first()
    return [n for i, n in enumerate(names) if row[f"h{i}"]]


def has_text(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return has_text(kind.elementType)
    if isinstance(kind, T.MapType):
        return has_text(kind.valueType)
    if isinstance(kind, T.StructType):
        return any(has_text(f.dataType) for f in kind)
    return isinstance(kind, T.StringType)


def scan_texts(df: DataFrame, detectors: Detectors | None = None, skip: set[str] = frozenset(), counts: bool = True) -> DataFrame:
    """Every text of ``df``, nested ones too, through the detectors in one Arrow pass; dates, numbers, binary stay.

    Adds ``_masked`` (hits) and ``_classes`` (hits by operator-defined rule) unless ``counts`` is off."""
    from pyspark.sql.pandas.types import to_arrow_schema

    extra = [T.StructField("_masked", T.LongType()), T.StructField("_classes", T.MapType(T.StringType(), T.LongType()))]
    schema = T.StructType([*df.schema.fields, *(extra if counts else [])])
    target = to_arrow_schema(schema)
    texts = [i for i, f in enumerate(df.schema) if has_text(f.dataType) and f.name not in skip]
    names = [f.name for f in df.schema]
    kept: dict[str, Scanner] = {}

    def mask(scanner: Scanner, value, path: str, hits: dict[str, int]):
        if isinstance(value, str):
            text, n, classes = scanner.scan(value, path)
            hits[""] = hits.get("", 0) + n
            for k, v in classes.items():
                hits[k] = hits.get(k, 0) + v
            return text
        if isinstance(value, dict):
            return {k: mask(scanner, v, f"{path}.{k}", hits) for k, v in value.items()}
        if isinstance(value, tuple):  # entry of a map
            return value[0], mask(scanner, value[1], f"{path}.{value[0]}", hits)
        return [mask(scanner, v, path, hits) for v in value] if isinstance(value, list) else value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = kept.get("scanner") or kept.setdefault("scanner", Scanner(detectors))
        for batch in batches:
            columns = [batch.column(i) for i in range(len(names))]
            found: list[dict[str, int]] = [{} for _ in range(batch.num_rows)]
            for i in texts:
                made = [mask(scanner, v, names[i], h) for v, h in zip(columns[i].to_pylist(), found, strict=True)]
                columns[i] = pa.array(made, target.field(i).type)
            if counts:
                columns += [
                    pa.array([h.get("", 0) for h in found], pa.int64()),
                    pa.array([[(k, v) for k, v in h.items() if k] for h in found], target.field(len(names) + 1).type),
                ]
            yield pa.RecordBatch.from_arrays(columns, schema=target)

    return df.mapInArrow(run, schema)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as there are cores, if it has fewer (a file of one row group); its order goes."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def known_values(df: DataFrame, columns: list[str]) -> list[str]:
    """Distinct values of masked columns of a capped result, longest first. Bounded by the row cap of the policy."""
    parts = F.array(*(F.trim(col(c).cast("string")) for c in columns))
    rows = df.select(F.explode(parts).alias("v")).where(F.length("v") >= SHORTEST_VALUE).distinct().collect()
    return sorted((r["v"] for r in rows), key=lambda v: (-len(v), v))


class KnownValues:
    """Replaces declared values on word boundaries, longest first, without regard to case."""

    def __init__(self, values: list[str]):
        self.values = sorted({v.strip() for v in values if len(v.strip()) >= SHORTEST_VALUE}, key=lambda v: (-len(v), v))
        self.patterns: dict[str, re.Pattern] = {}
        self.automaton = None
        try:
            import ahocorasick
        except ImportError:
            return
        if self.values:
            self.automaton = ahocorasick.Automaton()
            for i, v in enumerate(self.values):
                key = v.lower()
                self.automaton.add_word(key, (*self.automaton.get(key, ()), i))
            self.automaton.make_automaton()

    def present(self, text: str) -> list[str]:
        """Values that may occur, by one pass over the text."""
        low = text.lower()
        if self.automaton is None:
            return [v for v in self.values if v.lower() in low]
        return [self.values[i] for i in sorted({i for _, found in self.automaton.iter(low) for i in found})]

    def replace(self, text: str | None) -> tuple[str | None, int]:
        count = 0
        for v in self.present(text) if text else ():
            pattern = self.patterns.get(v) or self.patterns.setdefault(v, re.compile(rf"(?<![^\W_]){re.escape(v)}(?![^\W_])", re.IGNORECASE))
            text, n = pattern.subn(P.PII, text)
            count += n
        return text, count


def carry_over(df: DataFrame, values: list[str], columns: list[str]) -> DataFrame:
    """Known values masked in ``columns``; ``_carried`` counts them."""
    kept: dict[str, KnownValues] = {}

    @F.pandas_udf("struct<text: string, n: long>")
    def replaced(texts: pd.Series) -> pd.DataFrame:
        known = kept.get("known") or kept.setdefault("known", KnownValues(values))
        found = [known.replace(None if t is None or t != t else t) for t in texts]
        return pd.DataFrame({"text": [f[0] for f in found], "n": [f[1] for f in found]})

    marked = df.withColumns({f"_k{i}": replaced(col(c)) for i, c in enumerate(columns)})
    total = sum((F.col(f"_k{i}.n") for i in range(len(columns))), F.lit(0).cast("long"))
    out = marked.withColumn("_carried", total)
    return out.withColumns({c: F.col(f"_k{i}.text") for i, c in enumerate(columns)}).drop(*(f"_k{i}" for i in range(len(columns))))


_SPLIT_KEY = re.compile(r"(?:^|[._-])(?:tckn|tc_no|tcno|tc_kimlik)(?:$|[._-])", re.IGNORECASE)
_SPLIT_END = re.compile(r"[._-]?(?:1|2|left|right|part[12]|a|b)$")


def split_ids(df: DataFrame) -> DataFrame:
    """Pairs of similarly named columns whose digits together make a valid id, in either order: both are masked.

    The pairs follow from the names; the test is an expression. ``_split`` counts masked fields."""
    keys = [c for c in df.columns if _SPLIT_KEY.search(c)]
    stem = {c: _SPLIT_END.sub("", c.lower()) for c in keys}
    digits = {c: F.coalesce(F.regexp_replace(col(c).cast("string"), r"[^0-9]", ""), F.lit("")) for c in keys}
    used, total = {c: F.lit(False) for c in keys}, F.lit(0)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if stem[a] == stem[b]:
                both = (digits[a] != "") & (digits[b] != "")
                ok = national_id_column(F.concat(digits[a], digits[b])) | national_id_column(F.concat(digits[b], digits[a]))
                hit = ~used[a] & ~used[b] & both & ok
                used[a], used[b] = used[a] | hit, used[b] | hit
                total = total + F.when(hit, 2).otherwise(0)
    changes = {c: F.when(used[c], P.PII).otherwise(col(c).cast("string")) for c in keys}
    return df.withColumns({"_split": total.cast("long"), **changes})


def pseudonyms(names: DataFrame, name: str, kind: str) -> DataFrame:
    """token and name of each distinct name: ``Kind #n``, longest names first, ties by name. Names are numbered in groups
    of equal length and beginning, and the sizes of the groups before are added."""
    from pyspark.sql import Window

    rows = names.select(F.trim(col(name)).alias("name")).where("name <> ''").distinct()
    rows = rows.select("name", F.length("name").alias("size"), F.substring("name", 1, 2).alias("head"))
    before = Window.orderBy(F.desc("size"), "head").rowsBetween(Window.unboundedPreceding, -1)
    groups = rows.groupBy("size", "head").agg(F.count("*").alias("n")).withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("size", "head").orderBy("name"))
    numbered = rows.withColumn("k", own).join(groups.drop("n"), ["size", "head"])
    return numbered.select(F.concat(F.lit(f"{kind} #"), F.col("at") + F.col("k")).alias("token"), "name")


def pseudonymise(df: DataFrame, text: str, tokens: DataFrame) -> DataFrame:
    """Names in ``text`` become their tokens in one pass, the longest at each place; what was put in is not looked at again.
    ``tokens`` is a list that a person keeps (bounded)."""
    pairs = {r["name"]: r["token"] for r in tokens.collect()}
    if not pairs:
        return df
    kept: dict[str, re.Pattern] = {}

    @F.pandas_udf("string")
    def replaced(texts: pd.Series) -> pd.Series:
        found = kept.get("found") or kept.setdefault("found", re.compile("|".join(re.escape(n) for n in sorted(pairs, key=lambda n: (-len(n), n)))))
        return texts.map(lambda t: found.sub(lambda m: pairs[m.group()], t), na_action="ignore")

    return df.withColumn(text, replaced(col(text)))


def suggested_masks(columns: DataFrame) -> DataFrame:
    """Mask rules ``*.column`` for columns (column_name) whose name hints at personal data."""
    hints = "(?i)" + "|".join(PRIVATE_HINTS)
    return columns.where(F.col("column_name").rlike(hints)).select(F.concat(F.lit("*."), F.lower("column_name")).alias("rule")).distinct()


#: Name parts that hint at personal data.
PRIVATE_HINTS = (
    "adres", "address", "name", "ad_soyad", "soyad", "mahalle", "ilce", "passport", "pasaport", "(?:^|[._-])ip(?:$|[._-])", "tckn", "email",
    "iban", "phone", "telefon", "holder", "(?:^|[._-])pan(?:$|[._-])", "cvv", "tc_no", "tcno",
)

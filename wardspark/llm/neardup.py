"""Near-duplicates by an LSH forest over MinHash signatures, with exact confirmation.

Texts with the same set of five-word shingles collapse into one class first. A signature of TREES x DEPTH minima gives
TREES sorted orders: order t reads the values from t * DEPTH on. Classes that share the first DEPTH values of an order
form a region, and depth adapts to each region. In one with at most WINDOW classes all meet. In a larger one each meets
the two that stand beside it in the sorted order, with which its common prefix is longest, and the smallest of the
region. Where these links do not make a large region one component, the classes outside its commonest component are the
ones that may still have links. If they are few (a block), they are held against the whole region exactly; if not, the
region is followed deeper: its classes form regions by the values of two orders, then of three, so that deeper regions
branch into many orders and the chance to share one stays high. What is left after that is searched exactly, in blocks.

Every candidate is confirmed on the full sets of both texts; before that only pairs go whose numbers of shingles rule
the similarity out, or which are in one component already. Two texts at the limit share a region with probability
1 - (1 - 0.75**4)**32 > 0.99999, two orders with 0.9999 and three with 0.999; the latter two count only where all the
regions that they share are large. Closer texts do with higher ones.

Defined cases: null, empty and blank texts have no shingles and link with nothing; rows with a null doc_id link with
nothing and are kept; rows that repeat a doc_id are one document, so that all their texts are linked (an empty one among
them aside); ties do not arise, as the smallest id of a component stays; extra columns are ignored by ``groups`` and
kept by ``deduplicated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.llm.common import _arrow_schema, arrow_map, slices, stored, table
from wardspark.llm.components import components
from wardspark.llm.shingles import _mix, shingle_sets

TREES, DEPTH = 32, 4
SIMILARITY = 75  # in hundredths
#: Classes of a region of which all pairs are candidates, and orders that deeper regions combine.
WINDOW, LEVELS = 32, (2, 3)

SIGNED = "doc_id long, h long, n_shingles long, fp1 long, fp2 long, sig binary"
#: first and last are the first and the last of the orders that a region combines.
ROWS = "region long, first int, last int, deep long, id long, size long"
PAIRS = "a long, b long"


def _multipliers() -> np.ndarray:
    return (_mix(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def signature(shingles: np.ndarray, multipliers: np.ndarray) -> bytes:
    """Minima of TREES x DEPTH scramblings of the set, 16 bits of each."""
    low, least = (shingles >> np.uint64(32)).astype(np.uint32), np.full(len(multipliers), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 4096):
        part = low[at : at + 4096]
        scrambled = part[None, :] * multipliers[:, None]
        scrambled ^= scrambled >> np.uint32(15)
        scrambled *= np.uint32(0x2C1B3C6D)
        np.minimum(least, scrambled.min(axis=1), out=least)
    least ^= least >> np.uint32(12)
    return (least * np.uint32(0x297A2D39) >> np.uint32(16)).astype("<u2").tobytes()


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the text, size and 128-bit fingerprint of the shingle set, and its signature (null for empty sets)."""

    def rows(x: dict) -> dict:
        multipliers, out = _multipliers(), {n: [] for n in ("n_shingles", "fp1", "fp2", "sig")}
        for s in shingle_sets([(t or "").encode() for t in x["text"]]):
            with np.errstate(over="ignore"):
                fp = np.array([_mix(s).sum(dtype=np.uint64), (_mix(s + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)], np.uint64)
            for name, v in zip(out, (len(s), *fp.view(np.int64).tolist(), signature(s, multipliers) if len(s) else None), strict=True):
                out[name].append(v)
        return {"doc_id": x["doc_id"], "h": x["h"], **out}

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h")), SIGNED, rows)


def forest(reps: DataFrame) -> DataFrame:
    """A row per class and order: region (order and first DEPTH values), the DEPTH values that follow, id and size."""
    schema = _arrow_schema(reps.sparkSession, ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 4096):
                keys = band_keys(part.column(1).to_pylist())
                with np.errstate(over="ignore"):
                    region = _mix(keys + _mix(np.arange(1, TREES + 1, dtype=np.uint64)))
                every = lambda k: np.repeat(part.column(k).to_numpy(zero_copy_only=False), TREES)  # noqa: B023, E731
                order = np.tile(np.arange(TREES, dtype=np.int32), len(keys))
                columns = (region.view(np.int64).ravel(), order, order, np.roll(keys, -1, 1).view(np.int64).ravel(), every(0), every(2))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    return reps.select("id", "sig", F.col("n_shingles").alias("size")).mapInArrow(run, ROWS)


def band_keys(signatures: list[bytes]) -> np.ndarray:
    """A row per signature: for each order its DEPTH values as one number, the first value highest, so that numbers sort
    as the values do."""
    values = np.frombuffer(b"".join(signatures), "<u2").reshape(-1, TREES, DEPTH)
    return np.ascontiguousarray(values[:, :, ::-1]).view("<u8").reshape(-1, TREES)


def living(rows: DataFrame) -> DataFrame:
    """Rows of regions that hold two components at least, with n and the smallest id of the region, its size and component."""
    stats = rows.groupBy("region").agg(
        F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high"),
        F.min("id").alias("center"), F.min_by("size", "id").alias("center_size"), F.min_by("comp", "id").alias("center_comp"),
    )
    return stored(rows.join(stats.where("low < high").drop("low", "high"), "region"))


def candidates(live: DataFrame) -> DataFrame:
    """Pairs of classes that meet in the regions of ``live``."""
    schema = _arrow_schema(live.sparkSession, PAIRS)
    columns = ("region", "id", "size", "comp", "center", "center_size", "center_comp")

    def meet(window: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, held = None, []
            for batch in batches:
                a, b = [], []
                for region, id_, size, comp, *center in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if region != last:
                        last, held = region, []
                    for other, n, c in held[-window:] if window > 1 else (*held, center):
                        if c != comp and 100 * min(n, size) >= SIMILARITY * max(n, size):
                            a.append(min(other, id_))
                            b.append(max(other, id_))
                    held = [*held, (id_, size, comp)] if window > 1 else [(id_, size, comp)]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

        return run

    small = live.where(F.col("n") <= WINDOW).repartition("region").sortWithinPartitions("region")
    # one order over all executors: a hot region spreads over many ranges, and a task remembers one row
    large = live.where(F.col("n") > WINDOW).repartitionByRange("region", "deep", "id").sortWithinPartitions("region", "deep", "id")
    met = small.select(*columns).mapInArrow(meet(WINDOW), PAIRS).unionByName(large.select(*columns).mapInArrow(meet(1), PAIRS))
    return met.distinct()


def deeper(rows: DataFrame, level: int) -> DataFrame:
    """Regions of one order more: those of classes that share two regions of ``rows``. Single orders combine with later
    ones, longer combinations with those that start with the order in which they end; so a class has at most
    TREES * (TREES - 1) / 2 regions of two orders, and as many times TREES / 3 of three."""
    left = rows.select("id", "size", "comp", F.col("first").alias("start"), F.col("last").alias("at"), F.col("region").alias("r"))
    right = rows.select("id", "first", "last", "deep", F.col("region").alias("s"))
    if level == 2:
        both = left.join(right, "id").where("first > at")
    else:
        both = left.join(right.withColumn("at", F.col("first")).drop("first"), ["id", "at"])
    return both.select(
        F.xxhash64("r", "s").alias("region"), F.col("start").alias("first"), "last", "deep", "id", "size", "comp"
    )


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs whose full shingle sets have the similarity; ``texts`` (id, text) travel, as they are smaller than their sets."""
    schema = _arrow_schema(pairs.sparkSession, PAIRS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 512):
                left, right = ([t.encode() for t in part.column(k).to_pylist()] for k in (2, 3))
                known = list(dict.fromkeys(left + right))
                sets = dict(zip(known, shingle_sets(known), strict=True))
                keep = [similar(sets[x], sets[y]) for x, y in zip(left, right, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], schema=schema).filter(pa.array(keep, pa.bool_()))

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, PAIRS).distinct()


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    return enough(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))


def enough(common, n, m):
    return (common > 0) & (100 * common >= SIMILARITY * (n + m - common))


#: Rows of a block of queries and of a block of the region in the search of large regions.
BLOCK_ROWS = 512


class Block:
    """Shingle sets of some documents as one list sorted by shingle."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(every, kind="stable")
        self.shingles, self.owner = every[order], owner[order]

    def common(self, x: np.ndarray) -> np.ndarray:
        """How many shingles each document shares with the set ``x``."""
        low, high = (np.searchsorted(self.shingles, x, side) for side in ("left", "right"))
        n = high - low
        at = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        return np.bincount(self.owner[at], minlength=len(self.sizes))


def crowded(rows: DataFrame) -> DataFrame:
    """Rows of regions that hold several components, with the commonest (main), all rows (m) and those outside it (o)."""
    per = rows.groupBy("region", "comp").agg(F.count("*").alias("n"))
    sizes = per.groupBy("region").agg(F.sum("n").alias("m"), F.max("n").alias("most"), F.max_by("comp", "n").alias("main"), F.count("*").alias("comps"))
    return stored(rows.join(sizes.where("comps > 1").select("region", "m", "main", (F.col("m") - F.col("most")).alias("o")), "region"))


def searched(placed: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between components that share a region, found exactly.

    placed: rows of ``crowded``; texts: id, text. In each region the documents outside its commonest component are
    queries against all documents of the region, in blocks of about BLOCK_ROWS; only links leave a block, never the pairs
    compared."""
    import pandas as pd

    blocks = lambda n: F.ceil(F.col(n) / BLOCK_ROWS)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), blocks(n) - 1))
    spread = lambda n, *salt: F.pmod(F.xxhash64("id", *salt), blocks(n))
    rows = placed.join(texts, "id")
    columns = ("id", "comp", "text")
    asked = rows.where("comp <> main").select("region", spread("o", F.lit(1)).alias("query_block"), each("m").alias("block"), *columns)
    again = rows.toDF(*rows.columns)  # columns of their own, as both sides come from the same rows
    against = again.select("region", each("o").alias("query_block"), spread("m").alias("block"), *columns)

    def run(queries: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        if len(queries) and len(others):
            block = Block(shingle_sets([t.encode() for t in others["text"]]))
            comps = others["comp"].to_numpy()
            root: dict[int, int] = {}

            def find(c: int) -> int:
                while root.get(c, c) != c:
                    c = root[c]
                return c

            for k, x in enumerate(shingle_sets([t.encode() for t in queries["text"]])):
                own = int(queries["comp"].iat[k])
                for j in np.flatnonzero(enough(block.common(x), len(x), block.sizes) & (comps != own)).tolist():
                    a, b = find(own), find(int(comps[j]))
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        y, z = int(queries["id"].iat[k]), int(others["id"].iat[j])
                        out.append((min(y, z), max(y, z)))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    keys = ("region", "query_block", "block")
    return asked.groupBy(*keys).cogroup(against.groupBy(*keys)).applyInPandas(run, PAIRS)


def linked(classes: DataFrame, docs: DataFrame, links: DataFrame) -> DataFrame:
    """id and root of the classes (id, doc_id, h, n_shingles, sig) that near-duplicate links or ``links`` connect."""
    names = [f.split()[0] for f in ROWS.split(", ")]
    live = living(forest(classes).withColumn("comp", F.col("id")))
    # texts of what meets anything at all, once; those of the others do not travel any more
    ids = live.select("id").distinct().join(classes.select("id", "doc_id", "h"), "id")
    found = docs.withColumn("h", F.xxhash64("text")).join(ids, ["doc_id", "h"])
    texts = stored(found.groupBy("id").agg(F.any_value("text").alias("text")))
    for level in (*LEVELS, None):
        links = stored(links.unionByName(confirmed(candidates(live), texts)))
        roots = components(links)
        large = crowded(joined(live.where(F.col("n") > WINDOW).select(*names), roots))
        if large.isEmpty():
            return roots
        wide = F.col("o") > BLOCK_ROWS if level else F.lit(False)
        links = stored(links.unionByName(searched(large.where(~wide), texts)))
        roots = components(links)
        rest = large.where(wide)
        if rest.isEmpty():
            return roots
        live = living(deeper(joined(rest.select(*names), roots), level))
    return roots


def joined(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows with the component of each id."""
    return rows.join(roots, "id", "left").withColumn("comp", F.coalesce("root", "id")).drop("root")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    every = stored(signed(docs))
    valid = every.where("n_shingles > 0 AND doc_id IS NOT NULL")
    same = ["fp1", "fp2", "n_shingles"]
    classes = valid.groupBy(*same).agg(F.min(F.struct("doc_id", "h")).alias("least"), F.any_value("sig").alias("sig"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("id"), *same, "least.doc_id", "least.h", "sig"))
    many = valid.groupBy("doc_id").agg(F.min("fp1").alias("x"), F.max("fp1").alias("y")).where("x <> y").select("doc_id")
    held = valid.select("doc_id", *same).join(many, "doc_id").join(classes.select("id", *same), same).select("doc_id", "id").distinct()
    first = held.groupBy("doc_id").agg(F.min("id").alias("a"))
    repeated = held.join(first, "doc_id").where("a <> id").select("a", F.col("id").alias("b"))
    roots = linked(classes, docs, repeated)
    named = stored(classes.join(roots, "id", "left").select(*same, F.coalesce("root", "id").alias("root"), "doc_id"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component"))
    named = named.join(least, "root").select(*same, "component")
    comparable = every.select("doc_id", *same).join(named, same, "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id"))
    return comparable.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: those of the smallest doc_id of each component."""
    gone = groups(docs).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents", "doc_id", "text"))

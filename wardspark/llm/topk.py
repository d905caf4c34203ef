"""Exact top-k by inner product with Fagin's threshold algorithm.

Vectors become integers and are dealt by row number into blocks. A block is sorted once: it is stored as one row with its
vectors and one sorted list per dimension. A query walks all lists at once from its own end (the top for positive
weights, the bottom for negative ones), scores every vector that it meets, and stops when the bound for vectors not met
yet is below its k-th best score. That score travels: from block to block of a chunk, and from the first chunk, which
every query meets first, to all others. Queries come in blocks too, so that neither side is broadcast or gathered
whole.

Defined cases: a vector that is null or has a null or non-finite component takes no part; vectors are compared with
vectors of the same length only; an empty vector scores 0; ties go to the smaller id; repeated query rows are
answered each on their own, repeated candidate rows are listed each; extra columns are ignored. Scores must fit in
64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.llm.common import _arrow_schema, stored, table

K, EVERY = 10, 100
#: Rows of a block of candidates and of a block of queries, and blocks that hand a bound on to each other in one task.
BLOCK_ROWS, QUERY_ROWS, CHUNK_BLOCKS = 2048, 256, 8
FIRST_DEPTH = 8

BLOCKS = "block long, n int, kind string, rows binary, ids binary, data binary, sorted binary"
FOUND = "query_block long, n int, floors binary, query_id array<long>, query_row array<long>, vec_id array<long>, score array<long>"


def integers(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """vec_id, v (array of long) and n (its length), of the vectors that take part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(math.inf)))
    return (
        df.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(False)))
        .select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))
        .withColumn("n", F.size("v"))
    )


class Lists:
    """Sorted lists of a block: for every dimension the rows by rising value. Rows are in order of id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, order: np.ndarray | None = None):
        if order is None:
            by_id = np.argsort(ids, kind="stable")
            ids, vectors = ids[by_id], vectors[by_id]
            order = np.argsort(vectors, axis=0, kind="stable")
        self.ids, self.vectors, self.order = ids, vectors.astype(np.int64), order.astype(np.int64)
        self.values = np.take_along_axis(self.vectors, self.order, axis=0)
        self.largest, self.floats = int(np.abs(self.vectors).max(initial=0)), self.vectors.astype(float)

    def top(self, query_id: int, query: np.ndarray, k: int, best: tuple[tuple[int, int], ...] = (), floor: int | None = None) -> list[tuple[int, int]]:
        """(id, score) of the k best of ``best`` and of the rows whose id is another, best first. Rows below ``floor``, a
        score that k others are known to reach, may be left out."""
        n, d = self.vectors.shape
        exact = self.largest * int(np.abs(query).max(initial=0)) * max(d, 1) < 2**53
        scored = self.floats if exact else self.vectors
        weights = query.astype(float) if exact else query
        ids, scores = (np.array([b[i] for b in best], np.int64) for i in (0, 1))
        rising, dims = query < 0, np.flatnonzero(query)
        seen = self.ids == query_id
        at, depth = 0, FIRST_DEPTH
        while True:
            end = min(n, at + depth)
            if len(dims):
                steps = np.arange(at, end)[:, None]
                met = seen.copy()
                met[self.order[np.where(rising[dims], steps, n - 1 - steps), dims]] = True
            else:
                met = np.ones(n, bool)
            new = np.flatnonzero(met & ~seen)
            seen = met
            got = (scored[new] @ weights).astype(np.int64)
            if floor is not None:
                new, got = new[got >= floor], got[got >= floor]
            ids, scores = np.concatenate([ids, self.ids[new]]), np.concatenate([scores, got])
            keep = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[keep], scores[keep]
            if len(scores) == k:
                floor = int(scores[-1]) if floor is None else max(floor, int(scores[-1]))
            if end == n or not len(dims):
                break
            last = self.values[np.where(rising[dims], end - 1, n - end), dims]
            bound = int((last.astype(object) * query[dims].astype(object)).sum()) if not exact else int(last @ query[dims])
            if floor is not None and floor > bound:
                break
            at, depth = end, depth * 2
        return list(zip(ids.tolist(), scores.tolist(), strict=True))


def blocks(vectors: DataFrame, rows: int, lists: bool) -> DataFrame:
    """vectors (vec_id, v, n, row) as stored blocks: one row each, with sorted lists or without."""
    number = max(1, math.ceil(vectors.count() / rows))

    def run(part: pa.Table) -> pa.Table:
        n, ids = part["n"][0].as_py(), part["vec_id"].to_numpy()
        values = part["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), n)
        by_id = np.argsort(ids, kind="stable")
        ids, values, row = ids[by_id], values[by_id], part["row"].to_numpy()[by_id]
        largest = int(np.abs(values).max(initial=0))
        kind = np.dtype("<i2" if largest < 2**15 else "<i4" if largest < 2**31 else "<i8")
        order = np.argsort(values, axis=0, kind="stable").astype(places(len(ids))) if lists else np.empty(0)
        made = [part["block"][0].as_py(), n, kind.str, row.astype("<i8").tobytes(), ids.astype("<i8").tobytes(), values.astype(kind).tobytes(), order.tobytes()]
        return pa.table({f.name: pa.array([x], f.type) for f, x in zip(schema, made, strict=True)})

    schema = _arrow_schema(vectors.sparkSession, BLOCKS)
    # by number of row, so that repeated ids do not meet in one block
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(number)))
    return stored(dealt.groupBy("block", "n").applyInArrow(run, BLOCKS))


def places(rows: int) -> str:
    """The type of row numbers in the sorted lists of a block."""
    return "<u2" if rows <= 2**16 else "<u4"


def walked(asked: DataFrame, index: DataFrame, k: int, chunks: range, floors: DataFrame | None) -> DataFrame:
    """The k best of every query in every chunk of ``chunks``: a row of arrays per block of queries, length and chunk."""
    schema = _arrow_schema(asked.sparkSession, FOUND)
    chunk = F.floor(F.col("block") / CHUNK_BLOCKS)
    left = index.withColumn("chunk", chunk).where(F.col("chunk").between(chunks.start, chunks.stop - 1))
    right = asked.select(
        F.col("block").alias("query_block"), "n", F.col("kind").alias("q_kind"), F.col("rows").alias("q_rows"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data")
    )
    right = right.join(floors, ["query_block", "n"], "left") if floors is not None else right.withColumn("floors", F.lit(None).cast("binary"))
    # every block of queries meets every block of vectors of its length once
    every = F.explode(F.sequence(F.lit(chunks.start).cast("long"), F.lit(chunks.stop - 1).cast("long")))
    pairs = right.withColumn("chunk", every).join(left, ["n", "chunk"])
    dealt = pairs.repartition("query_block", "n", "chunk").sortWithinPartitions("query_block", "n", "chunk", "block")
    columns = ("query_block", "n", "chunk", "q_kind", "q_rows", "q_ids", "q_data", "floors", "kind", "ids", "data", "sorted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                x = dict(zip(columns, (c[i].as_py() for c in batch.columns), strict=True))
                if key != (x["query_block"], x["n"], x["chunk"]):
                    if state:
                        yield written(key, *state)
                    key = (x["query_block"], x["n"], x["chunk"])
                    rows, ids = (np.frombuffer(x[c], "<i8") for c in ("q_rows", "q_ids"))
                    queries = np.frombuffer(x["q_data"], x["q_kind"]).reshape(len(ids), x["n"]).astype(np.int64)
                    known = np.frombuffer(x["floors"], "<i8") if x["floors"] else np.full(len(ids), LOWEST)
                    state = rows, ids, known, [[] for _ in ids]
                ids = np.frombuffer(x["ids"], "<i8")
                order = np.frombuffer(x["sorted"], places(len(ids))).reshape(len(ids), x["n"])
                lists = Lists(ids, np.frombuffer(x["data"], x["kind"]).reshape(len(ids), x["n"]), order)
                _, asked_ids, known, best = state
                for j, query_id in enumerate(asked_ids.tolist()):
                    floor = int(known[j])
                    best[j] = lists.top(query_id, queries[j], k, tuple(best[j]), None if floor == LOWEST else floor)
        if state:
            yield written(key, *state)

    def written(key: tuple, rows: np.ndarray, ids: np.ndarray, known: np.ndarray, best: list) -> pa.RecordBatch:
        floors = np.array([max(int(f), b[-1][1] if len(b) == k else LOWEST) for f, b in zip(known, best, strict=True)], "<i8")
        of = np.repeat(np.arange(len(best)), [len(b) for b in best])
        made = [key[0], key[1], floors.tobytes(), ids[of], rows[of], [v for b in best for v, _ in b], [s for b in best for _, s in b]]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(made, schema, strict=True)], schema=schema)

    return dealt.select(*columns).mapInArrow(run, FOUND)


LOWEST = np.iinfo(np.int64).min


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """vectors, queries: rows of ``integers``. Gives query_id, rank (from 1), vec_id, score."""
    from pyspark.sql import Window

    numbered = lambda df: stored(df.select("vec_id", "v", "n", F.monotonically_increasing_id().alias("row")))
    index, asked = blocks(numbered(vectors), block_rows, True), blocks(numbered(queries), query_rows, False)
    last = index.agg(F.max("block")).first()[0]
    chunks = 1 + (last or 0) // CHUNK_BLOCKS
    first = stored(walked(asked, index, k, range(0, 1), None))
    rest = walked(asked, index, k, range(1, chunks), first.select("query_block", "n", "floors")) if chunks > 1 else first.limit(0)
    parts = first.unionByName(rest).select(F.explode(F.arrays_zip("query_row", "query_id", "vec_id", "score")).alias("f")).select("f.*")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return (
        parts.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integers(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


OP10_SQL = """
WITH v AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS v, len(embedding) AS n
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.n = c.n AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

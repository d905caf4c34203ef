"""Sum-of-squares packing of tokenised documents into sequences of at most ``capacity`` tokens.

A document is cut only if it is longer than a sequence: the first piece takes what is left over, the others are
full. Full pieces are sequences by themselves. The others are dealt by row number into groups of about ``GROUP_PIECES``
pieces; each group is packed on its own, longest pieces first, and a piece goes where the sum over gaps g of
N(g)**2 becomes smallest, N(g) being the number of open sequences with g tokens left (ties: the smaller gap).

Defined cases: a null text is an empty document, i.e. the end token alone; repeated doc_ids and null ones are packed as
separate documents; an empty table gives no rows; rows of a group are bounded, as numbers of rows do not repeat.
"""

from __future__ import annotations

import base64
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.llm.common import arrow_map, stored, table

CAPACITY = 2048
GROUP_PIECES = 8192
END_ID = 0
SPECIAL = "<|endoftext|>"

#: The split pattern of the vocabulary with possessive runs: the same pieces, found with less backtracking.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def vocabulary_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


class Tokens:
    """Ids of the JSON tokenizer. The rank file holds the same vocabulary and gives the same ids several times faster;
    texts that spell the special token go through the JSON tokenizer itself."""

    def __init__(self, ranks_file: str, json_file: str):
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.json_file, self.full = json_file, None

    def ids(self, text: str) -> np.ndarray:
        if SPECIAL in text:
            if self.full is None:
                from tokenizers import Tokenizer

                self.full = Tokenizer.from_file(self.json_file)
            return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.fast.encode_ordinary(text), "<u4")


def pieces(docs: DataFrame, capacity: int = CAPACITY, files: tuple[str, str] | None = None) -> DataFrame:
    """Tokenise each document, append the end token, and cut documents that are longer than ``capacity``."""
    files = files or vocabulary_files()
    kept: dict[str, Tokens] = {}

    def rows(x: dict) -> dict:
        tokens = kept.get("tokens") or kept.setdefault("tokens", Tokens(*files))
        out: dict[str, list] = {n: [] for n in ("doc_id", "piece", "start", "length", "ids_crc32")}
        for doc_id, text in zip(x["doc_id"], x["text"], strict=True):
            ids = np.append(tokens.ids(text or ""), np.uint32(END_ID)).astype("<u4")
            at, piece = 0, 0
            while at < len(ids):
                end = at + (len(ids) - at - 1) % capacity + 1 if piece == 0 else at + capacity
                for name, v in zip(out, (doc_id, piece, at, end - at, zlib.crc32(ids[at:end].tobytes())), strict=True):
                    out[name].append(v)
                at, piece = end, piece + 1
        return out

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), PIECES, rows)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, taken in the order given."""
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap; gap 0 stays 0, as full bins do not count
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, n = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        # squares change by 2 * (N(g - s) - N(g)) + 2, and by 1 - 2 * N(s) if the bin becomes full
        change = 2 * (count[: capacity - s + 1] - count[s:]) + 2
        change[0] = 1 - 2 * count[s]
        change[count[s:] == 0] = np.iinfo(np.int64).max
        new = 2 * count[capacity - s] + 1 if s < capacity else 0
        k = int(change.argmin())
        if change[k] <= new:
            gap = k + s
            b = open_bins[gap].pop()
            count[gap] -= 1
        else:
            gap, b, n = capacity, n, n + 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > s:
            count[gap - s] += 1
            open_bins[gap - s].append(b)
    return bins, offsets


def pack(cut: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Rows of ``pieces`` with ``sequence_id`` and ``offset``."""
    cut = stored(cut.withColumn("row", F.monotonically_increasing_id()))
    groups = max(1, math.ceil(cut.where(F.col("length") < capacity).count() / group_pieces))
    spread = F.pmod(F.xxhash64("row"), F.lit(groups)).cast("long")

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("row", "ascending")])
        bins, offsets = sum_of_squares(rows["length"].to_numpy(), capacity)
        first = int(rows["spread"][0].as_py()) * 2**32
        rows = rows.drop_columns(["row", "spread"])
        return rows.append_column("sequence_id", pa.array(first + bins)).append_column("offset", pa.array(offsets))

    full = cut.where(F.col("length") == capacity).select(
        *(f.split()[0] for f in PIECES.split(", ")),
        # negative numbers: no group has them, and numbers of rows do not repeat
        (-1 - F.col("row")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    rest = cut.where(F.col("length") < capacity).withColumn("spread", spread)
    return full.unionByName(rest.groupBy("spread").applyInArrow(run, PACKED))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents", "doc_id", "text")))

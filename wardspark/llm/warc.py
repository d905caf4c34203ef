"""WARC archives of pages with revisit records, and their index as globally ordered capture histories.

Writing: one record per page as text that ends with an empty line pair, so that Spark's own writer (and its commit
protocol) makes the archives; pages whose payload of at least 1000 bytes occurs again are written once, as the
response with the largest page_id, and otherwise as revisits. Reading: archives are parsed record by record by
their Content-Length. Indexing: each archive gives a run sorted by URL key and time; runs are stored, dealt by
range, and the pieces of runs that meet in a range are merged by a loser tree. A range is bounded by key, time and
page, so that one URL with very many captures spreads over many ranges, and a range holds about RANGE_ROWS index entries
(never payloads), which bounds the memory of a merge. ``position`` counts bytes of the archive's text as it is after
decompression.

Defined cases: null html is an empty payload; a null url is about:blank; control characters in a url are escaped;
repeated rows are archived each (rows equal to the response in page_id too are responses); null page_ids are never
the response unless all ids of the payload are null, and sort first; an empty table gives no records.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import math
import re
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.llm.common import _arrow_schema, shared_dir, stored, table

MIN_BYTES = 1000
#: Bounds an archive, and with it a sorted run; pages of at least LONG_BYTES go into archives of fewer records.
RECORDS_PER_FILE, LONG_BYTES, LONG_RECORDS_PER_FILE = 2000, 128 << 10, 16
RANGE_ROWS = 32768
#: Rows of a payload that many pages share are dealt over so many parts.
SALTS = 32
#: Pages carry no date; captures are dated one second apart from this second on.
FIRST_SECOND = 1704067200
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
END = "\r\n\r\n"

CAPTURES = (
    "urlkey string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, archive string, position long"
)


def with_roles(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to."""
    payload = F.coalesce("html", F.lit(""))
    pages = pages.select(
        F.col("page_id").cast("long"), "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha1(payload.cast("binary")).alias("payload_digest"),
    )
    again = (
        pages.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
        .where("n > 1")
        .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        .drop("n")
    )
    salted = pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return salted.join(again, ["payload_digest", "payload_bytes", "salt"], "left").select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("last")).alias("refers_to"),
    )


def record() -> Column:
    """The record of a row of ``with_roles``, without the line pair at its end."""
    uri = F.regexp_replace(F.coalesce("url", F.lit("about:blank")), r"[\x00-\x20\x7F]", "%20")
    second = F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(4_000_000_000)) + F.lit(FIRST_SECOND)
    date = F.date_format(F.to_timestamp(F.timestamp_seconds(second)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    revisit = F.col("record_type") == "revisit"
    size = F.lit(len(HTTP)) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))),
        line("WARC-Date", date),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Payload-Length", F.col("payload_bytes")),
        F.when(
            revisit,
            F.concat(
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
            ),
        ).otherwise(""),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", size),
        F.lit("\r\n" + HTTP),
        F.when(revisit, "").otherwise(F.col("payload")),
    )


def write_archives(pages: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Archives below ``path``: short pages first, then long ones, so that no archive has many long records."""
    rows = with_roles(pages)
    for chosen, records in ((F.col("payload_bytes") < LONG_BYTES, records_per_file), (F.col("payload_bytes") >= LONG_BYTES, LONG_RECORDS_PER_FILE)):
        made = rows.where(chosen).select(record().alias("value")).write.mode("append").option("lineSep", END)
        made.option("compression", "gzip").option("maxRecordsPerFile", records).text(path)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """Headers, block and position of each record; one record at a time is in memory."""
    at = 0
    while first := stream.readline():
        if first.strip() == b"":
            at += len(first)
            continue
        if not first.startswith(b"WARC/1."):
            raise ValueError(f"no record at {at}")
        size, headers = len(first), {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            size += len(line)
            name, _, value = line.decode().partition(":")
            headers[name] = value.strip()
        block = stream.read(int(headers["Content-Length"]))
        if len(block) != int(headers["Content-Length"]):
            raise ValueError(f"record at {at} is cut off")
        yield headers, block, at
        at += size + 2 + len(block)


def urlkey(url: str) -> str:
    """Host labels from the top-level domain down, then port, path and query."""
    try:
        parts = urlsplit(url.lower())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    host = host.removeprefix("www.")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/") + ("?" + parts.query if parts.query else "")


def _page(value: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", value)
    return int(found[1]) if found else None


def captures(content: bytes, archive: str) -> list[tuple]:
    """The sorted run of an archive: a tuple in the order of CAPTURES for each record."""
    out = []
    for headers, block, at in parse(gzip.GzipFile(fileobj=io.BytesIO(content))):
        kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
        size = int(headers["WARC-Payload-Length"])
        if kind == "response":
            payload = block[block.index(b"\r\n\r\n") + 4 :]
            if hashlib.sha1(payload).hexdigest() != digest:
                raise ValueError(f"digest of the record at {at} of {archive} differs")
            size = len(payload)
        refers = _page(headers["WARC-Refers-To"]) if kind == "revisit" else None
        out.append((urlkey(headers["WARC-Target-URI"]), headers["WARC-Date"], _page(headers["WARC-Record-ID"]), size, digest, kind, refers, archive, at))
    return sorted(out, key=_key)


def _key(row: tuple) -> tuple:
    return row[0], row[1], -1 if row[2] is None else 0, row[2] or 0, row[7], row[8]


class LoserTree:
    """k-way merge: inner nodes keep the loser of a match, so each step replays one path of log2(k) matches."""

    def __init__(self, runs: Iterable[Iterable[tuple]], key=_key):
        self.runs, self.key = [iter(r) for r in runs], key
        self.heads = [self._pull(i) for i in range(len(self.runs))]
        k = len(self.runs)
        self.losers = [-1] * max(k, 1)
        for i in range(k):
            self._replay(i)

    def _pull(self, i: int):
        row = next(self.runs[i], None)
        return None if row is None else (self.key(row), row)

    def _before(self, a: int, b: int) -> bool:
        if a < 0 or b < 0:
            return a < 0  # during the build an empty seat wins, so that every run is seated once
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and (x[0], a) < (y[0], b)

    def _replay(self, winner: int) -> None:
        node = (winner + len(self.runs)) // 2
        while node > 0:
            if self._before(self.losers[node], winner):
                winner, self.losers[node] = self.losers[node], winner
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and self.heads[i := self.losers[0]] is not None:
            yield self.heads[i][1]
            self.heads[i] = self._pull(i)
            self._replay(i)


def natural_runs(rows: list[tuple], key=_key) -> list[list[tuple]]:
    """Cut where the key falls: the pieces of sorted runs that a range received, in whatever order they came."""
    runs: list[list[tuple]] = []
    for row in rows:
        if not runs or key(row) < key(runs[-1][-1]):
            runs.append([])
        runs[-1].append(row)
    return runs


def _batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 8192) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """One sorted run of captures per archive below ``path``."""
    schema = _arrow_schema(spark, CAPTURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                yield from _batches(captures(content.as_py(), name.as_py().rsplit("/", 1)[-1]), schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("path", "content").mapInArrow(run, CAPTURES)


def histories(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures ordered by URL key and time: the partitions are ranges in order, and each is merged from runs.
    ``runs`` are stored, as they are counted first."""
    schema = _arrow_schema(runs.sparkSession, CAPTURES)
    ranges = max(1, math.ceil(runs.count() / range_rows))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        yield from _batches(LoserTree(natural_runs(rows)), schema)

    return runs.repartitionByRange(ranges, "urlkey", "captured", F.asc_nulls_first("page_id"), "archive", "position").mapInArrow(merge, CAPTURES)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_archives(table(spark, sf_dir, "pages", "page_id", "url", "html"), path)
    return histories(stored(read_runs(spark, path))).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


OP8_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages
), w AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM w
"""

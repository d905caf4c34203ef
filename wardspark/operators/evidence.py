"""Access records as data: hash chains, receipts, coverage, anchors."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardspark.functions import canon
from wardspark.operators import mask

RECEIPT_SCHEMA = """
v STRING, id STRING, ts STRING, period STRUCT<start:STRING,end:STRING>,
actor STRUCT<type:STRING,id:STRING,assurance:STRING>,
model STRUCT<source:STRING,provider:STRING,name:STRING,version:STRING>,
client STRUCT<source:STRING,name:STRING,version:STRING>,
destination STRUCT<value:STRING,source:STRING>,
request STRUCT<tool:STRING,target:STRING,argsHash:STRING>,
dataRefs ARRAY<STRUCT<source:STRING,object:STRING,fieldsRequested:ARRAY<STRING>>>,
policy STRUCT<id:STRING,version:STRING,decision:STRING,rulesApplied:ARRAY<STRING>>,
flags ARRAY<STRING>,
masking STRUCT<maskedCount:BIGINT,byClass:MAP<STRING,BIGINT>,rowsReturned:BIGINT,rowCapApplied:BOOLEAN>,
disclosure STRUCT<hash:STRING,bytes:BIGINT,source:STRING>,
outcome STRUCT<status:STRING,denied:BOOLEAN>, consentRef STRING,
chain STRUCT<seq:BIGINT,prevHash:STRING,hash:STRING>,
sig STRUCT<alg:STRING,keyId:STRING,value:STRING>, anchor STRUCT<log:STRING,ref:STRING,state:STRING>
"""
#: Codes of verification, in the order in which a receipt is held against them.
OK, HASH, PREVIOUS, SEQUENCE, SIGNATURE, ANCHOR, ANCHOR_UNKNOWN, SCHEMA = 0, 10, 11, 12, 13, 14, 15, 20
#: Where model and client names may come from.
META_SOURCES = ("protocol", "measured", "operator-declared", "undeclared")


def positions(lines: DataFrame) -> DataFrame:
    """``pos`` (from 0) of each row in the order of partitions, which must be the same whenever ``lines`` is evaluated. One
    count per partition comes to the driver, no row does."""
    numbered = lines.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    counts = sorted((r["_part"], r["n"]) for r in numbered.groupBy("_part").agg(F.count("*").alias("n")).collect())
    starts, at = {}, 0
    for part, n in counts:
        starts[part], at = at, at + n
    offset = F.lit(0).cast("long")
    if starts:
        table = F.create_map(*(F.lit(v).cast("long") for pair in starts.items() for v in pair))
        offset = F.element_at(table, F.col("_part").cast("long"))
    return numbered.withColumn("pos", offset + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_row")


class UnreadableReceipts(ValueError):
    """``code`` 2: the path holds nothing that can be read as receipts; 20: a file was examined and is malformed."""

    def __init__(self, code: int, reason: str):
        super().__init__(reason)
        self.code = code


#: Endings of the files of a folder that are read.
RECEIPT_FILES = "*.{json,jsonl,receipt}"


def read_receipts(spark: SparkSession, path: str) -> DataFrame:
    """The receipts of ``load_receipts``, whatever was skipped."""
    return load_receipts(spark, path)[0]


def load_receipts(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """pos, file, value (the raw record, which the hash covers) and r (parsed), and the files of a folder that were
    skipped, by name.

    A file holds one record per line, or an array. Lines are read in parallel; only a file that begins with ``[`` or has a
    line that is no JSON is looked at as a whole. If that is JSON, it is of another shape: fatal (2) where the file was
    named itself, skipped in a folder. If it is not, it is malformed and always fatal (20)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise UnreadableReceipts(2, f"path not found: {path}")
    folder = fs.getFileStatus(at).isDirectory()
    reader = spark.read.option("pathGlobFilter", RECEIPT_FILES) if folder else spark.read
    lines = reader.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"))
    lines = lines.where(F.trim("value") != "").withColumn("_in", F.monotonically_increasing_id())
    begin = lines.groupBy("file").agg(F.min_by(F.substring(F.ltrim("value"), 1, 1), F.struct("_block", "_in")).alias("c"))
    odd = F.try_parse_json("value").isNull()
    arrays = [r["file"] for r in begin.where("c = '['").collect()]  # names of files only
    plain = lines.where(~F.col("file").isin(arrays)) if arrays else lines
    broken = [r["file"] for r in plain.where(odd).select("file").distinct().collect()]
    # only the files in question are looked at as wholes
    whole = lambda names: spark.read.text(names, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    skipped = []
    for row in whole(arrays + broken).select("file", _is_json("value").alias("ok")).orderBy("file").collect() if arrays or broken else ():
        if not row["ok"]:
            raise UnreadableReceipts(20, f"{row['file']} is not valid JSON")
        if row["file"] in broken:
            if not folder:
                raise UnreadableReceipts(2, f"{row['file']} is JSON but not one record per line")
            skipped.append(row["file"])
    plain = plain.where(~F.col("file").isin(skipped)) if skipped else plain
    if arrays:
        items = whole(arrays).select(F.posexplode(F.from_json("value", "array<string>")).alias("_in", "value"), "file")
        plain = plain.unionByName(items.select("value", "file", F.lit(0).cast("long").alias("_block"), F.col("_in").cast("long").alias("_in")))
    return _in_file_order(plain).withColumn("r", F.from_json("value", RECEIPT_SCHEMA)), skipped


@F.pandas_udf(T.BooleanType())
def _is_json(texts: pd.Series) -> pd.Series:
    """Whether a text is one JSON value and nothing else; the JVM's parser stops after the first value."""

    def one(text: str) -> bool:
        try:
            json.loads(text)
        except ValueError:
            return False
        return True

    return texts.map(one)


def _in_file_order(lines: DataFrame) -> DataFrame:
    """pos, file and value of lines (file, _block, _in): files by name, blocks by start, lines as they come in a block. A
    block is read by one task in order, so its first line and its size are enough; there is a row per block."""
    blocks = lines.groupBy("file", "_block").agg(F.min("_in").alias("_first"), F.count("*").alias("_n"))
    before = Window.orderBy("file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("_at", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return lines.join(starts, ["file", "_block"]).select((F.col("_at") + F.col("_in") - F.col("_first")).alias("pos"), "file", "value")


#: Where a chain of receipts starts.
RECEIPT_GENESIS = f"sha256:{canon.GENESIS}"


def chained(records: DataFrame, order: str, log: str, key_id: str | None = None, seed: bytes | None = None, tails: dict[str, tuple[int, str]] | None = None) -> DataFrame:
    """log, seq and value of the records (a JSON object in ``value``) of each log, linked in ``order`` and signed if there is
    a key: the writer of a chain. ``tails`` has the last seq and hash of logs that go on.

    A hash covers the one before, so a log is folded in order, in one task; the fold does no more than hash: what it hashes
    is written in canonical form before, and records are put together and signed after it, both in as many tasks as there
    are. Records stream through partitions sorted by log, and what is held is the last link. Logs are independent. A record
    that is no JSON object is an error."""
    known = tails or {}

    def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, ends, rest = [], [], []
            for name, line in zip(batch["log"].to_pylist(), batch["value"].to_pylist(), strict=True):
                body = json.loads(line)
                if not isinstance(body, dict):
                    raise ValueError(f"a record of log {name} is no object")
                rest.append(json.dumps({k: body[k] for k in canon.NOT_HASHED if k in body}))
                low = canon.canonical({k: v for k, v in body.items() if k < "chain" and k not in canon.NOT_HASHED})[:-1]
                high = canon.canonical({k: v for k, v in body.items() if k > "chain" and k not in canon.NOT_HASHED})[1:]
                heads.append((low + "," if low != "{" else low).encode())
                ends.append(("," + high if high != "}" else high).encode())
            yield pa.RecordBatch.from_arrays([batch["log"], batch["_order"], pa.array(heads, pa.binary()), pa.array(ends, pa.binary()), pa.array(rest, pa.string())], names=written.names)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seq, before = object(), 0, b""
        sha256 = hashlib.sha256
        for batch in batches:
            seqs, links, hashes = [], [], []
            for name, head, end in zip(batch["log"].to_pylist(), batch["head"].to_pylist(), batch["end"].to_pylist(), strict=True):
                if name != last:
                    last, (seq, text) = name, known.get(name, (0, RECEIPT_GENESIS))
                    before = canon.js_string(text).encode()
                seq += 1
                links.append(before)
                before = b'"sha256:%b"' % sha256(b'%b"chain":{"prevHash":%b,"seq":%d}%b' % (head, before, seq, end)).hexdigest().encode()
                seqs.append(seq)
                hashes.append(before)
            made = [pa.array(seqs, pa.int64()), pa.array(links, pa.binary()), pa.array(hashes, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch["log"], *made, batch["head"], batch["end"], batch["rest"]], names=["log", "seq", "link", "hash", "head", "end", "rest"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = []
            for seq, link, own, head, end, rest in zip(*(batch[c].to_pylist() for c in ("seq", "link", "hash", "head", "end", "rest")), strict=True):
                text = b'%b"chain":{"hash":%b,"prevHash":%b,"seq":%d}%b' % (head, own, link, seq, end)
                added = json.loads(rest)
                if seed is not None:
                    added["sig"] = canon.signature_of(own[1:-1].decode(), key_id, seed)
                lines.append(canon.canonical(json.loads(text) | added) if added else text.decode())
            yield pa.RecordBatch.from_arrays([batch["log"], batch["seq"], pa.array(lines, pa.string())], names=["log", "seq", "value"])

    rows = records.select(F.col(log).cast("string").alias("log"), F.col(order).alias("_order"), "value")
    written = T.StructType([rows.schema["log"], rows.schema["_order"]]).add("head", "binary").add("end", "binary").add("rest", "string")
    parts = mask.spread(rows).mapInArrow(parts_of, written)
    dealt = parts.repartition("log").sortWithinPartitions("log", "_order")
    linked = dealt.mapInArrow(fold, "log string, seq long, link binary, hash binary, head binary, end binary, rest string")
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return linked.repartition(tasks, "seq").mapInArrow(whole, "log string, seq long, value string")


def tails(receipts: DataFrame, log: str = "log") -> dict[str, tuple[int, str]]:
    """Last seq and hash of each log of (log, value): where ``chained`` goes on. One row per log comes to the driver."""
    chain = F.from_json("value", "chain STRUCT<seq:BIGINT,prevHash:STRING,hash:STRING>")["chain"]
    rows = receipts.select(F.col(log).alias("log"), chain.alias("c")).groupBy("log").agg(F.max(F.struct("c.seq", "c.hash")).alias("t"))
    return {r["log"]: (r["t"]["seq"], r["t"]["hash"]) for r in rows.collect()}


def with_previous(df: DataFrame, columns: dict[str, str], order: str = "pos", by: list[str] | None = None) -> DataFrame:
    """New columns that hold a column of the row before (null at the start).

    ``order`` counts without gaps, so the neighbour is joined by equality and no partition holds the whole log;
    ``by`` names separate logs."""
    keys = by or []
    before = df.select(*keys, (F.col(order) + 1).alias("_at"), *(F.col(c).alias(n) for n, c in columns.items()))
    out = df.withColumn("_at", F.col(order)).join(before, [*keys, "_at"], "left")
    return out.drop("_at")


def chain_breaks(log: DataFrame, stated: str = "hash", previous: str = "prev_hash", computed: str | None = None, genesis: str = canon.GENESIS) -> DataFrame:
    """pos and reason of every break: own hash differs, or the stated link is not the hash stated before."""
    linked = with_previous(log, {"_before": stated})
    reason = F.when(F.col(computed) != F.col(stated), "hash mismatch") if computed else F.when(F.lit(False), "")
    reason = reason.when(F.coalesce(F.col(previous), F.lit("")) != F.coalesce("_before", F.lit(genesis)), "prevHash break")
    return linked.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("pos", "reason")


def first_break(breaks: DataFrame) -> DataFrame:
    return breaks.agg(F.min("pos").alias("pos"), F.min_by("reason", "pos").alias("reason"), F.count("*").alias("breaks"))


def _json_udf(function: Callable[[dict], object], kind: str):
    @F.pandas_udf(kind)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lines in parts:
            out = []
            for line in lines:
                try:
                    value = json.loads(line)
                    out.append(function(value) if isinstance(value, dict) else None)
                except (ValueError, TypeError):
                    out.append(None)
            yield pd.Series(out, dtype=object)

    return run


def receipt_hashes(line: Column) -> Column:
    return _json_udf(canon.receipt_hash, "string")(line)


def entry_hashes(line: Column) -> Column:
    return _json_udf(canon.entry_hash, "string")(line)


def schema_fault(r: dict) -> str | None:
    """What keeps a record from being a receipt, else None."""
    chain, actor, policy = (r.get(k) if isinstance(r.get(k), dict) else {} for k in ("chain", "actor", "policy"))
    version = str(r.get("v")).rsplit("/", 1)[-1]
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool)
    rules = [
        (version in ("0.1", "0.2", "0.3", "0.4"), f"unsupported version {r.get('v')}"),
        (isinstance(r.get("id"), str) and r["id"], "missing id"),
        (isinstance(r.get("ts"), str), "missing ts"),
        (isinstance(r.get("chain"), dict), "missing chain"),
        (whole(chain.get("seq")), "chain.seq not integer"),
        (isinstance(chain.get("prevHash"), str), "missing chain.prevHash"),
        (isinstance(chain.get("hash"), str), "missing chain.hash"),
        ("consentRef" in r and r["consentRef"] is None, "consentRef must be null"),
        ("anchor" in r, "missing anchor field"),
        *((r.get(k) is not None, f"missing {k}") for k in ("period", "request", "dataRefs", "policy", "flags", "masking", "outcome")),
        (isinstance(r.get("dataRefs"), list), "dataRefs must be an array"),
        (isinstance(r.get("flags"), list), "flags must be an array"),
        (isinstance(policy.get("decision"), str), "policy.decision is required"),
    ]
    if version == "0.1":
        rules.append((actor.get("type") == "service", "actor.type must be service"))
    else:
        rules += [
            (actor.get("type") in ("service", "user"), "actor.type must be service or user"),
            (isinstance(actor.get("assurance"), str) and actor["assurance"], "actor.assurance is required"),
            (not (actor.get("type") == "user" and actor.get("assurance") == "shared-token"), "a user needs a token of their own"),
        ]
    if version in ("0.3", "0.4"):
        for name, parts in (("model", ("provider", "name", "version")), ("client", ("name", "version"))):
            m = r.get(name) if isinstance(r.get(name), dict) else {}
            rules += [
                (m.get("source") in META_SOURCES, f"{name}.source is unknown"),
                (m.get("source") != "undeclared" or all(m.get(p, 0) is None for p in parts), f"{name} is undeclared but carries values"),
            ]
    if version == "0.4":
        d, to = (r.get(k) if isinstance(r.get(k), dict) else {} for k in ("disclosure", "destination"))
        digest = isinstance(d.get("hash"), str) and len(d["hash"]) == 71 and d["hash"].startswith("sha256:") and set(d["hash"][7:]) <= set("0123456789abcdef")
        rules += [
            (d.get("source") in ("measured", "undeclared"), "disclosure.source is unknown"),
            (d.get("source") != "undeclared" or d.get("hash", 0) is None and d.get("bytes", 0) is None, "disclosure is undeclared but carries values"),
            (d.get("source") != "measured" or digest, "disclosure.hash is no digest"),
            (d.get("source") != "measured" or whole(d.get("bytes")) and d["bytes"] >= 0, "disclosure.bytes is no count"),
            (to.get("source") in ("operator-declared", "undeclared"), "destination.source is unknown"),
            (to.get("source") != "undeclared" or to.get("value", 0) is None, "destination is undeclared but carries a value"),
            (to.get("source") != "operator-declared" or isinstance(to.get("value"), str) and to["value"], "destination.value is required"),
        ]
    return next((reason for holds, reason in rules if not holds), None)


def signature_fault(r: dict, keys: dict[str, bytes]) -> str | None:
    sig = r.get("sig")
    if not isinstance(sig, dict):
        return "missing sig"
    if sig.get("alg") != "Ed25519":
        return f"unsupported sig.alg {sig.get('alg')}"
    if sig.get("keyId") not in keys:
        return f"unknown keyId {sig.get('keyId')}"
    raw = canon.canonical_base64(sig.get("value"))
    if raw is None:
        return "signature is not canonical base64"
    return None if canon.ed25519_ok(keys[sig["keyId"]], r["chain"]["hash"].encode(), raw) else "signature cryptographically invalid"


def verified(receipts: DataFrame, keys: dict[str, bytes] | None = None, seq_from: int | None = None, anchors: DataFrame | None = None) -> DataFrame:
    """pos, seq, hash, anchored and code of every receipt: schema, hash, link, sequence, signature, anchor, in this order; 0
    is sound.

    receipts: pos (from 0) and value (raw line). Without ``keys`` signatures are not looked at. anchors: hash, proof and
    outcome of an anchor log, of which the last row of a hash counts (by seq): without a row or a proof the anchor does not
    hold (14), nor if the outcome of its proof is ``failed``; an outcome that is neither that nor ``verified`` nor
    ``pending`` means that it could not be checked (15). Receipts without an anchor pass, as anchoring is periodic."""
    def look(r: dict) -> str:
        schema = schema_fault(r)
        return json.dumps([schema, None if schema else canon.receipt_hash(r), None if keys is None or schema else signature_fault(r, keys)])

    found = F.from_json(_json_udf(look, "string")("value"), "array<string>")
    r = F.from_json("value", "chain STRUCT<seq:BIGINT,prevHash:STRING,hash:STRING>, anchor STRING")
    rows = receipts.select("pos", found.alias("f"), r.alias("r")).select(
        "pos", F.col("f").isNotNull().alias("read"), F.col("f")[0].alias("schema"), (F.col("f")[1] != F.col("r.chain.hash")).alias("altered"), F.col("f")[2].alias("signature"),
        "r.chain.seq", "r.chain.prevHash", "r.chain.hash", "r.anchor",
    )
    rows = with_previous(rows, {"_hash": "hash", "_seq": "seq"})
    first = F.col("pos") == 0
    genesis = [RECEIPT_GENESIS, canon.GENESIS]
    linked = F.when(first, F.col("prevHash").isin(genesis)).otherwise(F.coalesce(F.col("prevHash") == F.col("_hash"), F.lit(False)))
    start = F.lit(True) if seq_from is None else F.col("seq") == seq_from
    stepped = F.when(first, start).otherwise(F.coalesce(F.col("seq") == F.col("_seq") + 1, F.lit(False)))
    code = (
        F.when(~F.col("read") | F.col("schema").isNotNull(), SCHEMA)
        .when(F.col("altered"), HASH)
        .when(~linked, PREVIOUS)
        .when(~stepped, SEQUENCE)
        .when(F.col("signature").isNotNull(), SIGNATURE)
    )
    anchored = F.col("anchor").isNotNull()
    if anchors is not None:
        a = F.from_json("anchor", "log STRING, ref STRING")
        ref = F.coalesce(F.when(a["ref"] != "", a["ref"]), F.col("hash"))
        last = latest_by_ref(anchors).select(F.col("hash").alias("_ref"), F.col("proof").alias("_proof"), F.col("outcome").alias("_outcome"))
        rows = rows.withColumn("_log", a["log"]).join(last, ref == F.col("_ref"), "left")
        lost = F.col("_log").isNull() | F.col("_ref").isNull() | F.coalesce(F.col("_proof") == "", F.lit(True)) | F.coalesce(F.col("_outcome") == "failed", F.lit(False))
        code = code.when(anchored & lost, ANCHOR).when(anchored & ~F.coalesce(F.col("_outcome").isin("verified", "pending"), F.lit(False)), ANCHOR_UNKNOWN)
    return rows.select("pos", "seq", "hash", anchored.alias("anchored"), code.otherwise(OK).alias("code"))


def latest_by_ref(anchors: DataFrame) -> DataFrame:
    """The last row (by seq) of an anchor log for each hash that it anchors."""
    others = [c for c in anchors.columns if c not in ("hash", "seq")]
    last = anchors.groupBy("hash").agg(F.max_by(F.struct("seq", *others), "seq").alias("_last"))
    return last.select("hash", "_last.*")


def verdict(
    codes: DataFrame, count: int | None = None, last_hash: str | None = None, anchors: bool = False, head_anchor: bool = False
) -> DataFrame:
    """One row: receipts, code (that of the first unsound receipt) and its position. Then pins are held against the end: a
    wrong count or last hash gives 11; a head without an anchor, where one is required, 14; an anchor check that met no
    anchor at all, 15, as nothing was compared."""
    bad = F.when(F.col("code") != OK, F.struct("pos", "code"))
    out = codes.agg(
        F.count("*").alias("receipts"), F.min(bad).alias("bad"), F.max_by("hash", "pos").alias("last_hash"),
        F.count_if("anchored").alias("anchored"), F.coalesce(F.max_by("anchored", "pos"), F.lit(False)).alias("head_anchored"),
    )
    pins = F.lit(False)
    if count is not None:
        pins = pins | (F.col("receipts") != count)
    if last_hash is not None:
        pins = pins | (F.lower("last_hash") != last_hash.lower())
    code = F.when(F.col("bad").isNotNull(), F.col("bad.code")).when(pins, PREVIOUS)
    code = code.when(~F.col("head_anchored") & F.lit(head_anchor), ANCHOR).when((F.col("anchored") == 0) & (F.col("receipts") > 0) & F.lit(anchors), ANCHOR_UNKNOWN)
    return out.select("receipts", code.otherwise(OK).alias("code"), F.col("bad.pos").alias("pos"), "last_hash", "anchored", "head_anchored")


def unsigned_after_signed(log: DataFrame, signature: str = "signature", by: list[str] | None = None) -> DataFrame:
    """Rows without a signature at a position after the first signed one: signatures cannot be taken away again."""
    has = F.coalesce(F.col(signature) != "", F.lit(False))
    keys = by or ["_all"]
    log = log if by else log.withColumn("_all", F.lit(0))
    first = log.where(has).groupBy(*keys).agg(F.min("pos").alias("_first"))
    return log.join(F.broadcast(first) if not by else first, keys).where(~has & (F.col("pos") > F.col("_first"))).drop("_first", "_all")


def undeclared(receipts: DataFrame) -> DataFrame:
    return receipts.agg(
        F.count_if(F.col("r.model.source") == "undeclared").alias("undeclared_model"),
        F.count_if(F.col("r.client.source") == "undeclared").alias("undeclared_client"),
    )


def decision(denied: Column, masked: Column) -> Column:
    return F.when(denied, "deny").when(masked > 0, "partial").otherwise("allow")


def objects(receipts: DataFrame) -> DataFrame:
    """seq and object of everything that a receipt names: its data references, and the target of describe_table."""
    target = F.when((F.col("r.request.tool") == "describe_table") & (F.col("r.request.target") != ""), F.array("r.request.target"))
    named = F.concat(F.coalesce(F.col("r.dataRefs.object"), F.array().cast("array<string>")), F.coalesce(target, F.array().cast("array<string>")))
    return receipts.select(F.col("r.chain.seq").alias("seq"), F.explode(named).alias("object"))


#: Bits of the numbers of a block, and numbers of a piece of a gap that is written out at once.
BLOCK_BITS, PIECE = 16, 100_000


def next_numbers(numbers: DataFrame) -> DataFrame:
    """s and n: each number (s, distinct) with the next one. Neighbours meet in blocks; the edges of blocks meet in blocks of
    blocks, twice; so the last window sees no more than 2**63 / 2**48 rows, whatever the table."""
    rows, found = numbers.select(F.col("s").alias("low"), F.col("s").alias("high")), None
    for level in range(1, 4):
        rows = rows.withColumn("b", F.shiftright("low", BLOCK_BITS * level))
        pairs = rows.select(F.col("high").alias("s"), F.lead("low").over(Window.partitionBy("b").orderBy("low")).alias("n")).where("n IS NOT NULL")
        found = pairs if found is None else found.unionByName(pairs)
        rows = rows.groupBy("b").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    last = rows.select(F.col("high").alias("s"), F.lead("low").over(Window.orderBy("low")).alias("n")).where("n IS NOT NULL")
    return found.unionByName(last)


def gap_ranges(seqs: DataFrame, seq: str = "seq", pinned: int | None = None) -> DataFrame:
    """first, last and found_seq of each run of missing numbers between the first and the last: one row per gap, however
    long; ``pinned`` is the number at which the sequence should start, if it does not."""
    numbers = seqs.select(F.col(seq).cast("long").alias("s")).where("s IS NOT NULL").distinct()
    gaps = next_numbers(numbers).where("n > s + 1").select((F.col("s") + 1).alias("first"), (F.col("n") - 1).alias("last"), F.col("n").alias("found_seq"))
    if pinned is not None:
        begin = numbers.agg(F.min("s").alias("found_seq")).where(F.col("found_seq") != pinned)
        gaps = gaps.unionByName(begin.select(F.lit(pinned).cast("long").alias("first"), F.lit(pinned).cast("long").alias("last"), "found_seq"))
    return gaps


def sequence_gaps(seqs: DataFrame, seq: str = "seq", pinned: int | None = None) -> DataFrame:
    """expected_seq and found_seq of each missing number of ``gap_ranges``, written out in pieces."""
    starts = F.explode(F.sequence("first", "last", F.lit(PIECE).cast("long")))
    pieces = gap_ranges(seqs, seq, pinned).select(starts.alias("at"), "last", "found_seq")
    each = F.explode(F.sequence("at", F.least(F.col("at") + PIECE - 1, "last")))
    return pieces.select(each.alias("expected_seq"), "found_seq")


def decisions(receipts: DataFrame, column: str = "decision") -> DataFrame:
    """Counts of allow, partial and deny; an unknown decision is an error."""
    known = F.when(F.col(column).isin("allow", "partial", "deny"), F.col(column)).otherwise(
        F.raise_error(F.concat(F.lit("unknown policy decision "), F.coalesce(F.col(column), F.lit("null"))))
    )
    d = receipts.select(known.alias("d"))
    return d.agg(*(F.count_if(F.col("d") == k).alias(k) for k in ("allow", "partial", "deny")))


def scope(declared: DataFrame, recorded: DataFrame) -> DataFrame:
    """object and recorded (boolean) of each declared object. Not recorded does not mean not accessed."""
    seen = recorded.select("object").distinct().withColumn("recorded", F.lit(True))
    return declared.select("object").distinct().join(seen, "object", "left").withColumn("recorded", F.coalesce("recorded", F.lit(False)))


def unassigned(receipts: DataFrame) -> DataFrame:
    """Receipts of query and search that name no object."""
    return receipts.where((F.coalesce(F.size("r.dataRefs"), F.lit(0)) <= 0) & F.col("r.request.tool").isin("query", "search"))


def coverage(receipts: DataFrame, declared: DataFrame, pinned: int | None = None) -> DataFrame:
    """One row: period, sequence, decisions, and how much of the declared scope has a recorded access."""
    rows = receipts.select("r.chain.seq", "r.period.start", "r.period.end", F.col("r.policy.decision").alias("decision"))
    summary = rows.agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("count"),
        F.min("start").alias("start"), F.max("end").alias("end"),
    )
    gaps = gap_ranges(rows, pinned=pinned).agg(F.coalesce(F.sum(F.col("last") - F.col("first") + 1), F.lit(0)).cast("long").alias("gaps"))
    inside = scope(declared, objects(receipts)).agg(F.count("*").alias("declared"), F.count_if("recorded").alias("accessed"))
    loose = unassigned(receipts).agg(F.count("*").alias("unassigned"))
    out = summary.crossJoin(decisions(rows)).crossJoin(gaps).crossJoin(inside).crossJoin(loose)  # one row each
    return out.withColumn("contiguous", F.col("gaps") == 0).withColumn("not_recorded", F.col("declared") - F.col("accessed"))


#: Fields of a declaration in the order in which they are held against the receipts.
DECLARED = ("first_seq", "last_seq", "count", "contiguous", "start", "end", "allow", "partial", "deny", "declared", "accessed", "unassigned")


def cross_check(stated: DataFrame, found: DataFrame) -> DataFrame:
    """One row: the first field in which a declaration differs from the receipts (null if none) and the code."""
    both = stated.select(F.struct(*DECLARED).alias("a")).crossJoin(found.select(F.struct(*DECLARED).alias("b")))
    first = F.coalesce(*(F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in DECLARED))
    out = both.select(first.alias("field"), F.col("b.contiguous").alias("ok"))
    return out.select("field", F.when(F.col("field").isNotNull(), 30).when(~F.col("ok"), 12).otherwise(0).alias("code"))


def tail_pin(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("count"), F.max_by("hash", "pos").alias("last_hash"))


def newest_first(receipts: DataFrame, *columns: str) -> DataFrame:
    return receipts.select("pos", *columns).orderBy(F.desc("pos"))


def anchor_faults(log: DataFrame) -> DataFrame:
    """seq and reason of the rows of an anchor log (seq, prev_hash, hash, value) whose number, link or hash is wrong."""
    rows = with_previous(log.withColumn("computed", entry_hashes(F.col("value"))), {"_before": "hash"}, order="seq")
    reason = (
        F.when(F.col("prev_hash") != F.coalesce("_before", F.lit(canon.GENESIS)), "prevHash mismatch")
        .when(F.col("hash").isNull(), "missing entry hash")
        .when(F.col("hash") != F.col("computed"), "entry hash mismatch")
    )
    return rows.withColumn("reason", reason).where("reason IS NOT NULL").select("seq", "reason")


def inclusion(log: DataFrame, seq: int) -> DataFrame:
    """The proof that a record is in a log: seq, hash and prev_hash from it to the head."""
    return log.where(F.col("seq") >= seq).select("seq", "hash", "prev_hash")


def inclusion_holds(path: DataFrame, seq: int, hash_: str, head: str) -> DataFrame:
    """One row: whether a path starts at the record, links up and ends at the head."""
    linked = with_previous(path, {"_before": "hash"}, order="seq")
    return linked.agg(
        (
            (F.min("seq") == seq)
            & (F.min_by("hash", "seq") == hash_)
            & (F.max_by("hash", "seq") == head)
            & (F.count("*") == F.max("seq") - F.min("seq") + 1)
            & F.every((F.col("seq") == seq) | F.coalesce(F.col("prev_hash") == F.col("_before"), F.lit(False)))
        ).alias("holds")
    )


def latest_view(log: DataFrame) -> DataFrame:
    """Submitted records with the state of their last upgrade."""
    last = log.where("type = 'upgrade'").groupBy(F.col("upgrades_seq").alias("seq")).agg(F.max_by("state", "seq").alias("upgraded"))
    submits = log.where("type = 'submit'")
    return submits.join(last, "seq", "left").select("seq", "id", "digest", F.coalesce("upgraded", "state").alias("state"))


def once_per_digest(submits: DataFrame) -> DataFrame:
    """The first submission of each owner and digest."""
    return submits.groupBy("owner", "digest").agg(F.min("seq").alias("seq"))


def anchor_due(receipts: DataFrame, every: int = 100, seconds: int = 3600, by: str = "log") -> DataFrame:
    """Rows (log, seq) after which an anchor is due: ``every`` receipts or ``seconds`` since the last one.

    The last anchor depends on all before, so each log is folded in order; its rows stream through a sorted partition, and
    a count and a time are all that is held."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, n, since = object(), 0, None
        for pdf in parts:
            due = []
            for name, ts in zip(pdf["log"], pdf["ts"], strict=True):
                if name != last:
                    last, n, since = name, 0, None
                n, since = n + 1, ts if since is None else since
                due.append(n >= every or ts - since >= seconds)
                if due[-1]:
                    n, since = 0, ts
            yield pdf.loc[due, ["log", "seq"]]

    rows = receipts.select(F.col(by).cast("string").alias("log"), F.col("seq").cast("long").alias("seq"), F.col("ts").cast("long").alias("ts"))
    dealt = rows.repartition("log").sortWithinPartitions("log", "seq")
    return dealt.mapInPandas(run, "log string, seq long").withColumnRenamed("log", by)


def declaration_hash(declaration: dict) -> str:
    """Digest of a coverage declaration without its signature, in canonical form."""
    body = {k: v for k, v in declaration.items() if k != "sig"}
    return "sha256:" + hashlib.sha256(canon.canonical(body).encode()).hexdigest()


def signed_declaration(found: DataFrame, scope_: list[str], key_id: str, seed: bytes, id_: str, ts: str) -> dict:
    """The row of ``coverage`` as a signed declaration; an error if there are no receipts or nothing is declared."""
    row = found.first()
    if not row["count"] or not scope_:
        raise ValueError("nothing to declare coverage over")
    body = {
        "v": "coverage/1", "id": id_, "ts": ts, "period": {"start": row["start"], "end": row["end"]}, "declaredScope": sorted(scope_),
        "chain": {"firstSeq": row["first_seq"], "lastSeq": row["last_seq"], "count": row["count"], "contiguous": row["contiguous"]},
        "decisions": {k: row[k] for k in ("allow", "partial", "deny")},
        "coverage": {k: row[k] for k in ("declared", "accessed", "unassigned", "not_recorded")},
    }
    return body | {"sig": canon.signature_of(declaration_hash(body), key_id, seed)}


def declaration_holds(declaration: dict, keys: dict[str, bytes]) -> bool:
    """Whether the signature of a declaration is one of the known keys and covers all of it."""
    sig = declaration.get("sig")
    if not isinstance(sig, dict) or sig.get("alg") != "Ed25519" or sig.get("keyId") not in keys:
        return False
    raw = canon.canonical_base64(sig.get("value"))
    return raw is not None and canon.ed25519_ok(keys[sig["keyId"]], declaration_hash(declaration).encode(), raw)

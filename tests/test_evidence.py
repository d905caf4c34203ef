"""Chains, receipts, coverage, reconciliation, client state and streams."""

import json

import pytest
from pyspark.sql import functions as F

from wardspark.functions import canon
from wardspark.operators import clients, evidence, reconcile, records
from wardspark.sources import catalog, files
from wardspark.streaming import stateful


def receipts(n, change=lambda i, r: r):
    out, before = [], f"sha256:{canon.GENESIS}"
    for i in range(n):
        r = {
            "v": "receipt/0.4", "id": f"id{i}", "ts": f"2026-01-01T00:00:{i:02d}Z", "period": {"start": "a", "end": "b"},
            "actor": {"type": "service", "id": "s", "assurance": "shared-token"}, "request": {"tool": "query", "target": None, "argsHash": "h"},
            "dataRefs": [{"source": "db", "object": f"shop.t{i}", "fieldsRequested": []}], "policy": {"id": "p", "version": "1", "decision": "allow", "rulesApplied": []},
            "flags": [], "masking": {"maskedCount": 0, "byClass": {}, "rowsReturned": 1, "rowCapApplied": False}, "outcome": {"status": "complete", "denied": False},
            "model": {"source": "undeclared", "provider": None, "name": None, "version": None}, "client": {"source": "protocol", "name": "c", "version": "1"},
            "disclosure": {"source": "undeclared", "hash": None, "bytes": None}, "destination": {"source": "undeclared", "value": None},
            "consentRef": None, "chain": {"seq": i + 1, "prevHash": before}, "sig": None, "anchor": None,
        }
        r["chain"]["hash"] = before = canon.receipt_hash(r)
        out.append(change(i, json.loads(json.dumps(r))))
    return [json.dumps(r) for r in out if r is not None]


def lines(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "pos long, value string")


def _set(where, **values):
    def change(i, r):
        if i == where:
            for path, v in values.items():
                at = r
                *up, last = path.split("__")
                for k in up:
                    at = at[k]
                at[last] = v
        return r

    return change


@pytest.mark.parametrize(
    "change,code,pos",
    [
        (lambda i, r: r, 0, None),
        (_set(2, masking__maskedCount=5), 10, 2),
        (lambda i, r: None if i == 1 else r, 11, 1),
        (_set(1, v="receipt/9"), 20, 1),
        (_set(0, actor__type="user"), 20, 0),
        (_set(3, disclosure={"source": "undeclared"}), 20, 3),
        (_set(1, chain__seq="x"), 20, 1),
    ],
)
def test_receipt_codes(spark, change, code, pos):
    out = evidence.verdict(evidence.verified(lines(spark, receipts(5, change)))).first()
    assert (out["code"], out["pos"]) == (code, pos)


def test_pins_and_sequence(spark):
    good = receipts(4)
    codes = evidence.verified(lines(spark, good))
    assert evidence.verdict(codes, count=5).first()["code"] == 11 and evidence.verdict(codes, count=4).first()["code"] == 0
    assert evidence.verdict(codes, last_hash="sha256:x").first()["code"] == 11
    assert evidence.verdict(evidence.verified(lines(spark, good), seq_from=2)).first()["code"] == 12
    assert evidence.verdict(evidence.verified(lines(spark, [*good, "no json"]))).first()["code"] == 20
    assert evidence.verdict(evidence.verified(lines(spark, good), keys={})).first()["code"] == 13


def test_ed25519_vectors():
    """The first three tests of RFC 8032."""
    for public, message, signature in (
        ("d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
        ("3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
        ("fc51cd8e6218a1a38da47ed00230f0580816ed13ba3303ac5deb911548908025", "af82", "6291d657deec24024827e69c3abe01a30ce548a284743a445e3680d7db5ac3ac18ff9b538d16f290ae67f760984dc6594a7c15e9716ed28dc027beceea1ec40a"),
    ):
        args = [bytes.fromhex(x) for x in (public, message, signature)]
        assert canon.ed25519_ok(*args) and not canon.ed25519_ok(args[0], args[1] + b"x", args[2])
        assert not canon.ed25519_ok(args[0], args[1], args[2][:32] + bytes(32))


def test_canonical_numbers_and_keys():
    for number, text in ((1.0, "1"), (1e21, "1e+21"), (1e-7, "1e-7"), (0.000001, "0.000001"), (-0.0, "0"), (123456789012345680000, "123456789012345680000"), (5e-324, "5e-324"), (0.1, "0.1")):
        assert canon.js_number(number) == text
    assert canon.canonical({"b": 1, "a": [None, True], "😀": 0, "דּ": 0}) == '{"a":[null,true],"b":1,"\U0001f600":0,"דּ":0}'
    assert canon.canonical_base64("YQ==") == b"a" and canon.canonical_base64("YR==") is None
    a = {"x": 1, "chain": {"seq": 1, "hash": "h"}, "y": [2]}
    assert canon.receipt_hash(a) == canon.receipt_hash({"y": [2], "chain": {"hash": "other", "seq": 1}, "x": 1, "sig": 5})


def test_positions_follow_the_file(spark, tmp_path):
    path = str(tmp_path / "r.jsonl")
    with open(path, "w") as f:
        f.write("\n".join(receipts(50)) + "\n\n")
    read = evidence.read_receipts(spark, path)
    assert [r["s"] for r in read.orderBy("pos").select("r.chain.seq").toDF("s").collect()] == list(range(1, 51))
    assert evidence.verdict(evidence.verified(read)).first()["code"] == 0
    assert evidence.undeclared(read).first()[0] == 50


def test_gaps_across_blocks_and_pins(spark):
    df = spark.createDataFrame([(s,) for s in (3, 4, 7, 65534, 65538, 200000)], "seq long").where("seq < 65600")
    gaps = {tuple(r) for r in evidence.sequence_gaps(df, pinned=1).collect()}
    assert (5, 7) in gaps and (6, 7) in gaps and (65536, 65538) in gaps and (1, 3) in gaps and (8, 65534) in gaps


def test_unknown_decisions_are_an_error(spark):
    with pytest.raises(Exception, match="unknown policy decision"):
        evidence.decisions(spark.createDataFrame([("maybe",)], "decision string")).collect()


def test_inclusion_proofs(spark):
    log = spark.createDataFrame([(1, "h1", canon.GENESIS), (2, "h2", "h1"), (3, "h3", "h2")], "seq long, hash string, prev_hash string")
    path = evidence.inclusion(log, 2)
    assert evidence.inclusion_holds(path, 2, "h2", "h3").first()[0]
    assert not evidence.inclusion_holds(path, 2, "h2", "h2").first()[0]
    broken = path.withColumn("prev_hash", F.when(F.col("seq") == 3, "x").otherwise(F.col("prev_hash")))
    assert not evidence.inclusion_holds(broken, 2, "h2", "h3").first()[0]


def test_reconcile_inputs_are_checked(spark):
    frame = lambda rows: spark.createDataFrame(rows, "queryid string, query string, calls long")
    with pytest.raises(Exception, match="counter reset"):
        reconcile.deltas(frame([("a", "q", 5)]), frame([("a", "q", 4)])).collect()
    with pytest.raises(Exception, match="counter reset"):
        reconcile.deltas(frame([("a", "q", 5)]), frame([("b", "q", 4)])).collect()
    with pytest.raises(reconcile.SnapshotError):
        reconcile.check_snapshot(frame([("a", "q", 1), ("a", "q", 2)]))
    with pytest.raises(reconcile.SnapshotError):
        reconcile.check_window({"role": "a", "source": "s", "ts": 2}, {"role": "a", "source": "s", "ts": 2})
    with pytest.raises(reconcile.SnapshotError):
        reconcile.Profile.of({"clocks": {"skew": "5s"}}, flag_skew="6s")
    assert reconcile.Profile.of({"clocks": {"skew": "5s"}}, flag_skew="5000ms").skew_ms == 5000


def test_declared_skew_bounds_the_boundary(spark):
    patterns = spark.createDataFrame([("a", "SELECT * FROM s.t", 1)], "queryid string, query string, delta long")
    ledger = spark.createDataFrame([(1, 105, "query", None, ["x.t"])], "id long, ts_ms long, tool string, target string, objects array<string>")
    verdict = lambda skew: reconcile.verdicts(patterns, ledger, 0, 100, skew).first()["verdict"]
    assert (verdict(None), verdict(5), verdict(4)) == ("indeterminate", "indeterminate", "unreconciled")


def test_limiters(spark):
    rows = spark.createDataFrame([("a", t, i) for i, t in enumerate((0, 1, 2, 10, 11, 12))] + [("b", 0, 9)], "c string, t long, k long")
    got = {r["key"]: (r["allowed"], r["retry_after"]) for r in clients.sliding_limit(rows, "c", "t", "k", 2, 10).collect()}
    assert got == {0: (True, 0), 1: (True, 0), 2: (False, 8), 3: (True, 0), 4: (True, 0), 5: (False, 8), 9: (True, 0)}
    fixed = {r["key"]: (r["bucket"], r["allowed"]) for r in clients.fixed_buckets(rows, "c", "t", "k", 2, 10).collect()}
    assert fixed[2] == (0, False) and fixed[3] == (10, True) and fixed[5] == (10, False)


def _run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("a", f"2026-01-01 00:{m:02d}:00", m) for m in (0, 1, 2, 50)] + [("a", "2026-01-02 00:00:00", 99)], "c string, t string, k long")
    rows = rows.select("c", F.to_timestamp("t").alias("t"), "k")
    rows.write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    _run(stateful.sessions(source(), "c", "t"), "sessions")
    assert {r["requests"] for r in spark.table("sessions").collect()} <= {3, 1}
    _run(stateful.tumbling(source(), "t", "1 hour", "c"), "tumbling", "complete")
    assert sorted(r["n"] for r in spark.table("tumbling").collect()) == [1, 4]
    _run(stateful.sliding_limit(source(), "c", "t", "k", 2, 3600), "limits")
    assert {r["key"]: r["allowed"] for r in spark.table("limits").collect()} == {0: True, 1: True, 2: False, 50: False, 99: True}
    _run(stateful.masked(source().select("c", F.lit("mail a@b.co").alias("x"))), "masked")
    assert {r["x"] for r in spark.table("masked").collect()} == {"mail [MASKED_PII]"}


def test_sources(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/A.md").write_text("hello é")
    (tmp_path / "d/b.bin").write_text("no")
    (tmp_path / "d/big.txt").write_text("x" * 300_000)
    got = files.read_docs(spark, str(tmp_path / "d")).collect()
    assert [(r["content"], r["_table"]) for r in got] == [("hello é", "docs.a")]
    memory = catalog.make_source("memory", frames={"t": spark.createDataFrame([(1, "Hello")], "id int, x string")})
    assert memory.search("hell").count() == 1 and memory.tables() == ["t"]
    with pytest.raises(ValueError):
        catalog.make_source("files")
    spec = {"paths": {"/a/{id}": {"get": {}}, "/b": {"post": {}}}}
    assert files.api_request(spec, 'SELECT * FROM api."GET /a/5"') == "/a/5" and len(files.endpoints(spec)) == 2
    for bad in ('SELECT * FROM api."POST /b"', 'SELECT * FROM api."GET /c"', "SELECT 1"):
        with pytest.raises(Exception):
            files.api_request(spec, bad)
    assert files.shaped(spark, '[{"a": 1}, {"a": 2}, {"a": 3}]', 2).count() == 2 and files.shaped(spark, "5", 9).first()["value"] == 5
    files.append_records(spark.range(3), str(tmp_path / "log"))
    files.append_records(spark.range(2), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 5


def test_identifiers_and_briefs(spark):
    ids = [r[0] for r in spark.range(200).select(records.ulid(F.lit(1469918176385).cast("long"))).collect()]
    assert len(set(ids)) == 200 and all(len(i) == 26 and i.startswith("01ARYZ6S41") for i in ids)
    text = records.brief({"A": spark.createDataFrame([(1, "x", None)], "id int, user_email string, n string"), "B": spark.range(0)})
    assert text.splitlines() == ["## A", "| id | n |", "| --- | --- |", "| 1 |  |", "", "## B", "_empty_", ""][:7] and "x" not in text
    assert records.args_hash({"b": 1, "a": 2}) == records.args_hash('{"a":2,"b":1}')


def test_countersignatures(spark):
    log = spark.createDataFrame([(1, "h1", canon.GENESIS)], "seq long, hash string, prev_hash string")
    record = {"seq": 1, "x": 1, "sig": {"alg": "Ed25519", "keyId": "k", "value": "AA=="}}
    record["hash"] = canon.entry_hash(record)
    assert records.countersigned(record, log, {"k": bytes(32)}) == 13
    assert records.countersigned(record | {"x": 2}, log, {}) == 14 and records.countersigned({"seq": 1}, log, {}) == 20


SEED = bytes(range(32))


def test_signing_vectors():
    """Secret keys of the first three tests of RFC 8032."""
    for seed, public, message in (
        ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", ""),
        ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72"),
        ("c5aa8df43f9f837bedb7442f31dcb7b166d38535076f094b85ce3a2e0b4458f7", "fc51cd8e6218a1a38da47ed00230f0580816ed13ba3303ac5deb911548908025", "af82"),
    ):
        secret, text = bytes.fromhex(seed), bytes.fromhex(message)
        assert canon.ed25519_public(secret).hex() == public
        assert canon.ed25519_ok(bytes.fromhex(public), text, canon.ed25519_sign(secret, text))


def bodies(n):
    drop = lambda r: {k: v for k, v in r.items() if k not in ("chain", "sig")}
    return [json.dumps(drop(json.loads(r))) for r in receipts(n)]


def test_a_written_chain_verifies_and_goes_on(spark, tmp_path):
    rows = spark.createDataFrame([(log, k, b) for log in ("a", "b") for k, b in enumerate(bodies(6))], "log string, k int, value string")
    made = evidence.chained(rows.where("k < 4"), "k", "log", "key", SEED)
    path, keys = str(tmp_path / "chain"), {"key": canon.ed25519_public(SEED)}
    assert files.append_chain(made.where("log = 'a'"), path) == 4
    more = evidence.chained(rows.where("k >= 4"), "k", "log", "key", SEED, evidence.tails(made))
    with pytest.raises(ValueError, match="go on"):
        files.append_chain(more.where("log = 'a' AND seq > 5"), path)
    with pytest.raises(ValueError, match="go on"):
        files.append_chain(made.where("log = 'b'"), path)
    assert files.append_chain(more.where("log = 'a'"), path) == 6 and files.append_chain(more.limit(0), path) == 6
    lines_ = spark.read.text(path).withColumn("pos", F.get_json_object("value", "$.chain.seq").cast("long") - 1)
    assert evidence.verdict(evidence.verified(lines_, keys), count=6).first()["code"] == 0
    forged = lines_.withColumn("value", F.regexp_replace("value", '"rowsReturned":1', '"rowsReturned":2'))
    assert evidence.verdict(evidence.verified(forged, keys)).first()["code"] == 10
    assert evidence.verdict(evidence.verified(lines_, {"key": bytes(32)})).first()["code"] == 13


def test_receipts_are_read_in_every_shape(spark, tmp_path):
    good = receipts(5)
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "a.jsonl").write_text("\n\n".join(good[:2]) + "\n")
    (folder / "b.json").write_text("[" + ",\n".join(good[2:4]) + "]")
    (folder / "c.receipt").write_text(good[4])
    (folder / "d.json").write_text(json.dumps({"not": "receipts"}, indent=1))
    (folder / "e.txt").write_text("no receipts")
    read, skipped = evidence.load_receipts(spark, str(folder))
    assert [r["pos"] for r in read.orderBy("pos").collect()] == list(range(5)) and [s.rsplit("/", 1)[-1] for s in skipped] == ["d.json"]
    assert evidence.verdict(evidence.verified(read)).first()["code"] == 0
    assert evidence.load_receipts(spark, str(folder / "b.json"))[0].count() == 2
    for name, code in (("d.json", 2), ("gone.json", 2)):
        with pytest.raises(evidence.UnreadableReceipts) as error:
            evidence.load_receipts(spark, str(folder / name))
        assert error.value.code == code
    (folder / "b.json").write_text("[" + good[2])
    (folder / "f.jsonl").write_text(good[0] + "\n" + good[1][:-3] + "\n")
    for path in (folder, folder / "b.json", folder / "f.jsonl"):
        with pytest.raises(evidence.UnreadableReceipts) as error:
            evidence.load_receipts(spark, str(path))
        assert error.value.code == 20


def test_anchor_codes(spark):
    ref = [json.loads(r)["chain"]["hash"] for r in receipts(4)]
    held = lambda **at: receipts(4, lambda i, r: r | {"anchor": at[f"r{i}"]} if f"r{i}" in at else r)
    log = lambda *rows: spark.createDataFrame(list(rows), "seq long, hash string, proof string, outcome string")
    code = lambda rows, held_in, **k: tuple(evidence.verdict(evidence.verified(lines(spark, rows), anchors=held_in), **k).first()[c] for c in ("code", "pos"))
    mark = {"log": "calendar", "ref": ref[1], "state": "pending"}
    one = held(r1=mark)
    assert code(one, log((1, ref[1], "p", "pending"))) == (0, None) == code(one, None)
    assert code(one, log((1, ref[0], "p", "verified"))) == (14, 1)
    assert code(one, log((1, ref[1], "", "verified"))) == (14, 1)
    assert code(one, log((1, ref[1], "p", "failed"))) == (14, 1)
    assert code(one, log((1, ref[1], "p", "failed"), (2, ref[1], "p", "verified"))) == (0, None)
    assert code(one, log((1, ref[1], "p", None))) == (15, 1)
    assert code(held(r1={"ref": ref[1]}), log((1, ref[1], "p", "verified"))) == (14, 1)
    assert code(held(r1={"log": "calendar", "ref": ""}), log((1, ref[1], "p", "verified"))) == (0, None)
    assert code(receipts(4), log((1, "x", "p", "verified")), anchors=True) == (15, None)
    assert code(one, log((1, ref[1], "p", "verified")), anchors=True, head_anchor=True) == (14, None)
    assert code(held(r3={"log": "c", "ref": ref[3]}), log((1, ref[3], "p", "verified")), anchors=True, head_anchor=True) == (0, None)


def test_signed_declarations(spark):
    df = spark.createDataFrame([(i, json.loads(r)["id"]) for i, r in enumerate(receipts(3))], "i int, id string")
    found = df.agg(*(F.lit(v).alias(k) for k, v in dict(start="a", end="b", first_seq=1, last_seq=3, count=3, contiguous=True, allow=3, partial=0, deny=0, declared=2, accessed=1, unassigned=0, not_recorded=1).items()))
    made = evidence.signed_declaration(found, ["shop.b", "shop.a"], "k", SEED, "id", "t")
    keys = {"k": canon.ed25519_public(SEED)}
    assert evidence.declaration_holds(made, keys) and not evidence.declaration_holds(made, {})
    assert not evidence.declaration_holds(made | {"ts": "later"}, keys) and not evidence.declaration_holds(made, {"k": bytes(32)})
    with pytest.raises(ValueError):
        evidence.signed_declaration(found, [], "k", SEED, "id", "t")


def test_long_gaps_are_ranges(spark):
    far = [-(2**62), -5, 0, 1, 2**40, 2**40 + 250_001, 2**62]
    df = spark.createDataFrame([(s,) for s in [*far, 1, 0]], "seq long")
    got = sorted(tuple(r) for r in evidence.gap_ranges(df).collect())
    want = [(a + 1, b - 1, b) for a, b in zip(far, far[1:], strict=False) if b > a + 1]
    assert got == want
    few = df.where(F.col("seq").between(2**40, 2**40 + 250_001))
    assert [r["expected_seq"] for r in evidence.sequence_gaps(few).orderBy("expected_seq").collect()] == list(range(2**40 + 1, 2**40 + 250_001))


def test_anchors_due_against_a_plain_fold(spark):
    import random

    rng, rows, want = random.Random(3), [], set()
    for log in "ab":
        t, n, since = 0, 0, None
        for seq in range(300):
            t += rng.choice([0, 1, 5, 40])
            rows.append((log, seq, t))
            n, since = n + 1, t if since is None else since
            if n >= 7 or t - since >= 90:
                want.add((log, seq))
                n, since = 0, t
    rng.shuffle(rows)
    got = evidence.anchor_due(spark.createDataFrame(rows, "log string, seq long, ts long"), 7, 90)
    assert {tuple(r) for r in got.collect()} == want


def test_prompts_and_limits_of_whole_tables_against_plain_loops(spark):
    from pathlib import Path

    from wardspark import catalogue
    from wardspark.functions.scan import Detectors, Scanner

    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("test tables are absent")
    scanner = Scanner(Detectors(names=False))
    turns = spark.read.parquet(f"{folder}/conversations.parquet").collect()
    want = sorted((r["conv_id"], r["turn"], len(r["text"]), scanner.scan(r["text"], "text")[1]) for r in turns if r["text"] is not None)
    got = catalogue.QUERIES["mask_conversations"](spark, folder).where("prompt_chars IS NOT NULL").collect()
    assert sorted((r["conv_id"], r["turn"], r["prompt_chars"], r["masked_count"]) for r in got) == want
    passed, want = {}, {}
    events = spark.read.parquet(f"{folder}/events.parquet").withColumn("s", F.unix_seconds(F.col("ts").cast("timestamp")))
    for r in sorted(events.collect(), key=lambda r: (r["s"], r["event_id"])):
        last = [t for t in passed.get(r["user_id"], []) if t > r["s"] - 86400]
        want[r["event_id"]] = len(last) < 3
        passed[r["user_id"]] = last + [r["s"]] * want[r["event_id"]]
    assert {r["key"]: r["allowed"] for r in catalogue.QUERIES["rate_limit_decisions"](spark, folder).collect()} == want


def test_pseudonyms_are_put_in_once(spark):
    from wardspark.operators import mask

    names = spark.createDataFrame([(n,) for n in ("Ann", "Ann Lee", "Person", "Bo", " Bo ", "", None)], "n string")
    tokens = mask.pseudonyms(names, "n", "Person")
    assert {r["name"]: r["token"] for r in tokens.collect()} == {"Ann Lee": "Person #1", "Person": "Person #2", "Ann": "Person #3", "Bo": "Person #4"}
    rows = spark.createDataFrame([("Ann Lee and Ann met Person and Bo",), (None,)], "t string")
    assert [r["t"] for r in mask.pseudonymise(rows, "t", tokens).collect()] == ["Person #1 and Person #3 met Person #2 and Person #4", None]


def test_result_documents(spark):
    items = spark.createDataFrame([("q1", "matched", None), ("q2", "indeterminate", "unattributed")], "item string, outcome string, reason string")
    texts = dict.fromkeys(("start", "end", "receipts", "profile"), "x")
    profile = reconcile.Profile.of({"v": 1, "version": "7", "multiplicity": {"maxStatementsPerReceipt": 3}})
    made = reconcile.projected(items, profile, texts, (0, 9), "db")
    assert made["counts"]["matched"] == 1 and made["outcome"] == "exceptions" and made["items"] == [{"item": "q2", "outcome": "indeterminate", "reason": "unattributed"}]
    assert made["bounds"] == {"multiplicity": "operator-declared", "skew": "undeclared", "exclusion": "undeclared"} and made["profile"]["version"] == "7"
    assert reconcile.projected(items.where("outcome = 'matched'"), None, texts, (0, 9), "db")["outcome"] == "no-exceptions"


def test_session_gate_against_a_plain_fold(spark):
    import random

    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(900), k, rng.choice(["s", "t", "u", "v", None]), rng.choice(["me", "me", "you", None]), rng.random() < 0.3) for k in range(600)]
    want, live = {}, {}
    for where, at, key, name, who, new in sorted(rows, key=lambda r: r[1:3]):
        mine = live.setdefault(where, {})
        if new:
            mine = live[where] = {n: s for n, s in mine.items() if at - s[1] <= 40}
            code = 429 if len(mine) >= 3 and name not in mine else 201
        elif name not in mine:
            code = 404
        elif mine[name][0] != who:
            code = 403
        else:
            code = 404 if at - mine[name][1] > 40 else 200
            mine.pop(name)
        if code in (200, 201):
            mine[name] = (who, at)
        want[key] = (where, at, name, who, code)
    df = spark.createDataFrame(rows, "w string, at long, k long, code string, owner string, server boolean")
    got = clients.session_gate(df, "w", "at", "k", "code", "owner", F.col("server"), 3, 40).collect()
    assert {r["key"]: (r["server"], r["ts"], r["session"], r["owner"], r["code"]) for r in got} == want
    assert {c for *_, c in want.values()} == {200, 201, 403, 404, 429}
    assert clients.session_gate(df.limit(0), "w", "at", "k", "code", "owner", F.col("server")).count() == 0


def test_documents_have_scopes_of_their_paths(spark, tmp_path):
    from wardspark.operators import search

    for name, text in (("b/Read Me.md", "Long " * 40), ("a/read-me.md", "short one"), ("--.txt", "long"), ("a/x.bin", "long")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    docs = files.read_docs(spark, str(tmp_path)).select(F.col("relative").alias("path"), "file", "scope", "content")
    assert {r["path"]: (r["file"], r["scope"]) for r in docs.collect()} == {
        "a/read-me.md": ("read-me.md", "a_read_me_md"), "b/Read Me.md": ("Read Me.md", "b_read_me_md"), "--.txt": ("--.txt", "txt"),
    }
    found = {r["path"]: r["contentSnippet"] for r in search.search_docs(docs, "LONG").collect()}
    assert found == {"--.txt": "long", "b/Read Me.md": ("Long " * 30) + "..."}
    assert [r["_table"] for r in search.search_docs(docs, "read", tables=["docs.a_read_me_md"]).collect()] == ["docs.a_read_me_md"]
    assert search.search_docs(docs, "read", budget=10).count() == 0
    odd = docs.limit(0).unionByName(spark.createDataFrame([("read", "f", "s", None)], docs.schema))
    assert search.search_docs(odd, "read").first()["contentSnippet"] is None


def test_masks_of_whole_documents_against_the_scanner(spark):
    import hashlib
    from pathlib import Path

    from wardspark import catalogue
    from wardspark.functions.scan import Detectors, Scanner

    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("test tables are absent")
    scanner = Scanner(Detectors())
    want = {}
    for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").where("text IS NOT NULL").collect():
        text, hits, *_ = scanner.scan(r["text"], "text")
        want[r["doc_id"]] = (hashlib.md5(text.encode()).hexdigest(), hits)
    got = catalogue.QUERIES["mask_pipeline_documents"](spark, folder).where("masked IS NOT NULL").collect()
    assert {r["doc_id"]: (r["masked"], r["hits"]) for r in got} == want


def test_one_log_is_written_by_many_tasks_as_if_by_one(spark):
    odd = [{"chain": {"seq": 9}, "a": 1.50, "z": "é", "n": 2**60, "sig": {"x": 1}, "anchor": None, "hash": "h"}, {}, {"b": "c"}, {"d": [":1.5", 1e21], "": 1, "\U0001f600": 2}]
    records_ = [odd[k] if k < len(odd) else {"k": k, "anchor": {"log": "x"}} for k in range(60)]
    want, before = [], evidence.RECEIPT_GENESIS
    for k, record in enumerate(records_):
        body = record | {"chain": {"seq": k + 1, "prevHash": before}}
        before = body["chain"]["hash"] = canon.receipt_hash(body)
        want.append((k + 1, canon._write(body, True)))
    rows = spark.createDataFrame([("a", k, json.dumps(r)) for k, r in enumerate(records_)], "log string, k int, value string")
    made = evidence.chained(rows, "k", "log").withColumn("part", F.spark_partition_id()).collect()
    assert sorted((r["seq"], r["value"]) for r in made) == want
    assert len({r["part"] for r in made}) > 1  # only the fold is one task for each log


@pytest.mark.parametrize("value", [
    1, -0.0, 2.0, 1e21, 2**60, [1.5, 10**16], {"b": 1, "a": [-(10**15), 10**15]}, {"": 1, "\U0001f600": 2, "é": ":1.5"}, 'x":1.5,2e3', "sha256:" + "0" * 64, "\x7f\x01",
])
def test_canonical_text_is_the_same_by_both_ways(value):
    assert canon.canonical(value) == canon._write(value, True) and canon._fast(value, False) == canon._write(value, False)

"""Per-client state in batch form: rate limits, fixed buckets, sessions, keys and tokens.

A limiter's answer depends on all answers before it, so a client's requests are read in order. They stream through a
sorted partition; what is held is at most ``limit`` times per client, however many requests one client has.
"""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _in_order(df: DataFrame, client: str, ts: str, key: str) -> DataFrame:
    rows = df.select(F.col(client).alias("client"), F.col(ts).cast("long").alias("ts"), F.col(key).alias("key"))
    return rows.repartition("client").sortWithinPartitions("client", "ts", "key")


def sliding_limit(df: DataFrame, client: str, ts: str, key: str, limit: int, window: int) -> DataFrame:
    """client, ts, key, allowed and retry_after: a request passes if fewer than ``limit`` passed in the last ``window``
    units of ``ts``; refused requests do not count."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, passed = object(), deque()
        for pdf in parts:
            allowed, wait = [], []
            for who, at in zip(pdf["client"], pdf["ts"], strict=True):
                if who != last:
                    last, passed = who, deque()
                while passed and passed[0] <= at - window:
                    passed.popleft()
                ok = len(passed) < limit
                if ok:
                    passed.append(at)
                allowed.append(ok)
                wait.append(0 if ok else max(1, passed[0] + window - at))
            yield pdf.assign(allowed=allowed, retry_after=wait)

    rows = _in_order(df, client, ts, key)
    kinds = dict(rows.dtypes)
    return rows.mapInPandas(run, f"client {kinds['client']}, ts long, key {kinds['key']}, allowed boolean, retry_after long")


def fixed_buckets(df: DataFrame, client: str, ts: str, key: str, limit: int, window: int) -> DataFrame:
    """client, ts, key, bucket (its first time) and allowed: a bucket starts at the first request after the last one
    ended, and lets ``limit`` requests pass."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, start, n = object(), 0, 0
        for pdf in parts:
            bucket, allowed = [], []
            for who, at in zip(pdf["client"], pdf["ts"], strict=True):
                if who != last or at - start >= window:
                    last, start, n = who, at, 0
                n += 1
                bucket.append(start)
                allowed.append(n <= limit)
            yield pdf.assign(bucket=bucket, allowed=allowed)

    rows = _in_order(df, client, ts, key)
    kinds = dict(rows.dtypes)
    return rows.mapInPandas(run, f"client {kinds['client']}, ts long, key {kinds['key']}, bucket long, allowed boolean")


def sessions(df: DataFrame, client: str, ts: str, order: str, idle_seconds: int = 1800) -> DataFrame:
    """client, session (from 1), start, end and requests: a pause of more than ``idle_seconds`` ends a session."""
    own = Window.partitionBy(client).orderBy(ts, order)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    new = F.coalesce(micros - F.lag(micros).over(own) > idle_seconds * 1_000_000, F.lit(True))
    numbered = df.withColumn("_new", new.cast("int")).withColumn("session", F.sum("_new").over(own))
    return numbered.groupBy(client, "session").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("requests"))


#: Answers to a request that names or opens a session.
OPENED, SPOKE, FOREIGN, GONE, FULL = 201, 200, 403, 404, 429


def session_gate(
    df: DataFrame, server: str, ts: str, key: str, session: str, owner: str, opens: Column, most: int = 100, idle_seconds: int = 1800
) -> DataFrame:
    """server, ts, key, session, owner and code: what a server answers to each request, in order of ``ts`` and ``key``.

    An opening request gets 201, or 429 if ``most`` sessions are open (0: no limit); sessions idle for more than
    ``idle_seconds`` (0: never) are swept before they are counted. Opening a session that is open starts it anew. Any
    other request gets 404 if its session is not open, 403 if another owner opened it, 404 if it was idle for too long,
    which closes it, else 200. ``ts`` and ``key`` are whole numbers; rows without ``ts`` are left out, null names are names
    of their own. A server's requests stream through one sorted partition; what is held is its open sessions."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, live = object(), OrderedDict()
        for pdf in parts:
            codes = []
            for where, at, name, who, new in zip(*(pdf[c] for c in ("server", "ts", "session", "owner", "_opens")), strict=True):
                if where != last:
                    last, live = where, OrderedDict()
                if new:
                    while idle_seconds and live and at - next(iter(live.values()))[1] > idle_seconds:
                        live.popitem(last=False)
                    if most and name not in live and len(live) >= most:
                        codes.append(FULL)
                        continue
                    codes.append(OPENED)
                elif name not in live:
                    codes.append(GONE)
                    continue
                elif live[name][0] != who:
                    codes.append(FOREIGN)
                    continue
                elif idle_seconds and at - live[name][1] > idle_seconds:
                    del live[name]
                    codes.append(GONE)
                    continue
                else:
                    codes.append(SPOKE)
                live[name] = (who, at)
                live.move_to_end(name)
            yield pdf.drop(columns="_opens").assign(code=codes)

    text = lambda c: F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("-"))
    rows = df.select(
        text(server).alias("server"), F.col(ts).cast("long").alias("ts"), F.col(key).cast("long").alias("key"), text(session).alias("session"),
        text(owner).alias("owner"), F.coalesce(opens, F.lit(False)).alias("_opens"),
    ).where("ts IS NOT NULL")
    dealt = rows.repartition("server").sortWithinPartitions("server", "ts", "key")
    out = dealt.mapInPandas(run, "server string, ts long, key long, session string, owner string, code int")
    bare = lambda c: F.when(F.startswith(c, F.lit("+")), F.substr(c, F.lit(2)))
    return out.withColumns({c: bare(F.col(c)) for c in ("server", "session", "owner")})


def client_key(forwarded: Column) -> Column:
    """The last named hop of a forwarding header, else ``unknown``."""
    hops = F.filter(F.transform(F.split(forwarded, ","), lambda h: F.trim(h)), lambda h: h != "")
    return F.coalesce(F.try_element_at(hops, F.lit(-1)), F.lit("unknown"))


def actors(requests: DataFrame, tokens: DataFrame) -> DataFrame:
    """Requests with actor and assurance, by the digest of their token; an unknown token is the shared service."""
    known = tokens.select(F.col("digest").alias("_digest"), F.col("actor").alias("_actor"))
    out = requests.join(known, F.sha2("token", 256) == F.col("_digest"), "left")
    own = F.col("_actor").isNotNull()
    return out.withColumn("actor", F.coalesce("_actor", F.lit("service"))).withColumn(
        "assurance", F.when(own, "per-user-token").otherwise("shared-token")
    ).drop("_digest", "_actor")

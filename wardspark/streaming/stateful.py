"""The per-client operators on streams: state with a time limit, watermarks, session windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wardspark.functions.scan import Detectors
from wardspark.operators.mask import scan_texts


def sliding_limit(stream: DataFrame, client: str, ts: str, key: str, limit: int, window: int) -> DataFrame:
    """client, ts, key and allowed, as in the batch form; a client's state holds ``limit`` times at most and ends when
    it has been quiet for ``window`` seconds."""

    def step(who: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        passed = list(state.get[0]) if state.exists else []
        if state.hasTimedOut:
            state.remove()
            return
        for pdf in parts:
            pdf = pdf.sort_values(["ts", "key"])
            allowed = []
            for at in pdf["ts"]:
                passed = [p for p in passed if p > at - window]
                allowed.append(len(passed) < limit)
                if allowed[-1]:
                    passed.append(int(at))
            yield pd.DataFrame({"client": [who[0]] * len(pdf), "ts": pdf["ts"], "key": pdf["key"], "allowed": allowed})
        state.update((passed,))
        state.setTimeoutDuration(window * 1000)

    rows = stream.select(F.col(client).alias("client"), F.col(ts).cast("long").alias("ts"), F.col(key).alias("key"))
    kinds = dict(rows.dtypes)
    return rows.groupBy("client").applyInPandasWithState(
        step,
        f"client {kinds['client']}, ts long, key {kinds['key']}, allowed boolean",
        "passed array<long>",
        "append",
        GroupStateTimeout.ProcessingTimeTimeout,
    )


def sessions(stream: DataFrame, client: str, ts: str, idle: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """client, start, end and requests of sessions that the watermark has closed."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    out = timed.groupBy(client, F.session_window("_ts", idle).alias("w")).agg(F.count("*").alias("requests"))
    return out.select(client, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "requests")


def tumbling(stream: DataFrame, ts: str, width: str, *keys: str, late: str = "10 minutes") -> DataFrame:
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    out = timed.groupBy(F.window("_ts", width).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), *keys, "n")


def masked(stream: DataFrame, detectors: Detectors | None = None) -> DataFrame:
    """The text detectors on a stream: no state, one Arrow pass."""
    return scan_texts(stream, detectors)

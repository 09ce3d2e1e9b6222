"""Streams of cost records: totals per window, and the state of each provider's circuit breaker."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_costs(stream: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Cost and records per window and provider; records delivered twice within the watermark count once, later ones than it are dropped."""
    timed = stream.withColumn("recorded_at", F.col("recorded_at").cast("timestamp"))  # times without zone are in the session's zone
    unique = timed.withWatermark("recorded_at", late).dropDuplicatesWithinWatermark(["id"])
    sums = unique.groupBy(F.window("recorded_at", window), "provider").agg(F.count(F.lit(1)).alias("records"), F.sum("cost_usd").alias("cost"))
    return sums.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "provider", "records", "cost")


def sessions(stream: DataFrame, key: str, time: str, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of events per key: begin, end and number of events with no pause longer than ``gap``."""
    out = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.session_window(time, gap).alias("s"), key).agg(F.count(F.lit(1)).alias("events"))
    return out.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events")


def spend_alerts(costs: DataFrame, limit: float, window: str = "1 day") -> DataFrame:
    """(provider, start, cost): windows in which a provider's cost is above ``limit``. Works on tables and, with a watermark set
    before, on streams; negative amounts lower the sum, null ones count as 0."""
    timed = costs.withColumn("recorded_at", F.col("recorded_at").cast("timestamp"))
    sums = timed.groupBy(F.window("recorded_at", window).alias("w"), "provider").agg(F.sum(F.coalesce("cost_usd", F.lit(0.0))).alias("cost"))
    return sums.where(F.col("cost") > limit).select("provider", F.col("w.start").alias("start"), F.round("cost", 6).alias("cost"))


def breaker_step(failures: int, open_until: float, events: list[tuple[float, bool]], limit: int, pause: float) -> tuple[int, float, int]:
    """(failures in a row, end of the pause, refused calls) after more (time, failed) events in order of time."""
    refused = 0
    for at, failed in events:
        if at < open_until:
            refused += 1
        elif failed:
            failures += 1
            if failures >= limit:
                failures, open_until = 0, at + pause
        else:
            failures = 0
    return failures, open_until, refused


def breaker_states(stream: DataFrame, limit: int = 3, pause: float = 900.0) -> DataFrame:
    """(provider, failures, open_until, refused) after each batch; stream has provider, at (seconds) and failed.

    ``limit`` failures in a row open the breaker for ``pause`` seconds, during which calls are refused and change nothing.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        failures, open_until, refused = state.get if state.exists else (0, 0.0, 0)
        events = sorted((float(t), bool(f)) for batch in batches for t, f in zip(batch["at"], batch["failed"], strict=True))
        failures, open_until, more = breaker_step(failures, open_until, events, limit, pause)
        state.update((failures, open_until, refused + more))
        yield pd.DataFrame({"provider": [key[0]], "failures": [failures], "open_until": [open_until], "refused": [refused + more]})

    schema = "provider string, failures int, open_until double, refused int"
    return stream.groupBy("provider").applyInPandasWithState(update, schema, "failures int, open_until double, refused int", "update", "NoTimeout")

"""Streaming form of the tag join: sender and receiver evidence meet within a time bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_tag_pairs(senders: DataFrame, receivers: DataFrame, within: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Pairs with an equal tag, different parties and times at most ``within`` apart.

    Both inputs have (tag, party, tx, ts). Watermarks and the time bound let the join's state be dropped, so it
    stays as large as the traffic of the bound, not of the whole stream. Rows meet by tag and time slot: a sender
    has the slot of its time, a receiver all that its bound touches, so that a row is not held against all of its tag.
    """
    micros = lambda ts: f"unix_micros(cast({ts} as timestamp))"
    width = f"greatest(1L, {micros(f"timestamp'2000-01-01 00:00:00' + interval {within}")} - {micros("timestamp'2000-01-01 00:00:00'")})"
    slot = lambda ts: f"cast(floor({micros(ts)} / {width}) as bigint)"
    s = senders.withWatermark("ts", late).select(F.col("tag"), F.col("party").alias("party_s"), F.col("tx").alias("tx_s"), F.col("ts").alias("ts_s"), F.expr(slot("ts")).alias("slot"))
    slots = F.explode(F.expr(f"sequence({slot(f'ts - interval {within}')}, {slot(f'ts + interval {within}')})"))
    r = receivers.withWatermark("ts", late).select(F.col("tag").alias("tag_r"), F.col("party").alias("party_r"), F.col("tx").alias("tx_r"), F.col("ts").alias("ts_r"), slots.alias("slot_r"))
    near = F.expr(f"tag = tag_r AND slot = slot_r AND party_s <> party_r AND ts_r BETWEEN ts_s - INTERVAL {within} AND ts_s + INTERVAL {within}")
    return s.join(r, near).drop("tag_r", "slot", "slot_r")


def windowed_event_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and value sums per event type and tumbling window, with late rows up to ``late``."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))

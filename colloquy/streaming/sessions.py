"""Sessions over a stream of messages: clusters are told once no message can still join them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cluster import GAP_SECONDS, with_channel


def gap_sessions(messages: DataFrame, gap_seconds: int = GAP_SECONDS, late: str = "1 hour") -> DataFrame:
    """``channel, start_ts, end_ts, message_count, participant_count`` of main-timeline sessions; rows later than ``late`` are not waited for.

    Pauses of exactly the gap join, as they do in a batch. The participant count is approximate.
    """
    main = with_channel(messages).where("thread_id is null").withWatermark("ts", late)
    window = F.session_window("ts", f"{gap_seconds} seconds")
    return main.groupBy("channel", window.alias("w")).agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("message_count"), F.approx_count_distinct("sender").alias("participant_count")
    ).drop("w")

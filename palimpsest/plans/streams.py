"""Streaming form of a batch query, held to the same oracle."""

from palimpsest.plans.events import _M3
from palimpsest.plans.registry import query
from palimpsest.streaming.policies import stream_upsert_noop


@query(_M3)
def stream_state_m3(spark, sf_dir):
    return stream_upsert_noop(spark, f"{sf_dir}/events.parquet")

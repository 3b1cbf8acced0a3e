"""Streaming: intentionally empty.

The reference reads every input once (warehouse tables, shard files,
matrices) and has no stream, watermark, event-time window or state store, so
no Structured Streaming operator is part of this library. All jobs are
batch DataFrame plans; they can be re-run on new partitions of the
year-partitioned datasets written by ``citegraph.sources``.
"""

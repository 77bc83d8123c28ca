"""Incremental runs over growing exports."""
from logbraid.streaming.incremental import ingest_events, stream_id_pairs
from logbraid.streaming.pair_store import hot_values, ingest_id_pairs, load_pairs

__all__ = ["hot_values", "ingest_events", "ingest_id_pairs", "load_pairs", "stream_id_pairs"]

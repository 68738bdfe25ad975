"""Structured Streaming forms of the incremental work."""

from .batches import stream_batch_health
from .classify import stream_classify
from .consensus import stream_consensus
from .jobs import stream_score, stream_usage
from .metrics import run_ewa, run_totals, stream_entering, stream_windows, window_metrics
from .run import append_available, latest_updates, read_table_stream, run_available, run_to_end, stream_folder

__all__ = [
    "append_available",
    "latest_updates",
    "read_table_stream",
    "run_available",
    "run_ewa",
    "run_to_end",
    "run_totals",
    "stream_batch_health",
    "stream_classify",
    "stream_consensus",
    "stream_entering",
    "stream_folder",
    "stream_score",
    "stream_usage",
    "stream_windows",
    "window_metrics",
]

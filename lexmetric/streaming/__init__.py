"""Structured Streaming operators."""

from lexmetric.streaming.accuracy import report_totals, stream_accuracy, stream_totals  # noqa: F401

"""Sinks: the JSON-lines file sink (O64) and the collector sink."""

from .files import write_json_lines
from .collector import CollectorSink, deliver_batches

__all__ = ["write_json_lines", "CollectorSink", "deliver_batches"]

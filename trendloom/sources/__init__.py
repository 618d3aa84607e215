"""Sources of events and sinks of results."""

from trendloom.sources.readers import SourceConfig, http_poll, in_memory, json_lines, json_lines_stream
from trendloom.sources.writers import to_http, to_json_lines, to_memory

__all__ = ["SourceConfig", "http_poll", "in_memory", "json_lines", "json_lines_stream", "to_http", "to_json_lines", "to_memory"]

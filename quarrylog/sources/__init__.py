"""Readers of logs, traces, schema dumps and the library's own tables, and writers."""

"""Ingest of search statistics: keyed upsert, batch and streaming."""

from .upsert import (ensure_table, flatten_landing, merge_newest, stream_sync, sync_search, sync_table,
                     upsert_window)

__all__ = ["ensure_table", "flatten_landing", "merge_newest", "stream_sync", "sync_search",
           "sync_table", "upsert_window"]

"""Incremental ingest of documents; the reference surface has no streaming operators beyond it."""

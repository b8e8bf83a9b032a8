"""Typed ingest, the import catalog, archives, downloads and JSON snapshots."""

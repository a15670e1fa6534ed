"""Readers of what ingestion lands (board pages, law pages, rulebooks, logs) and writers of results."""

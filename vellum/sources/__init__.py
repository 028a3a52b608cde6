"""Readers of parser output and of finished Markdown."""

"""Relational operators over the canonical tables; each returns one lazy DataFrame."""

"""Incremental forms of the grouped summaries, for tables that arrive as streams."""

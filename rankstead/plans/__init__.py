"""Query definitions with their SQL counterparts."""

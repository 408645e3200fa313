"""Named queries with their oracles: single operators (registry) and composed plans (composed)."""

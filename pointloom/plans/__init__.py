"""Plan-level helpers: shared scratch tables, distributed numbering, grid joins."""

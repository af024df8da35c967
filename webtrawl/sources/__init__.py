"""Page snapshots, message streams, tables, and scratch tables."""

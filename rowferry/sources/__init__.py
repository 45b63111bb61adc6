"""Reading and writing tables, feeds, contracts and snapshots."""

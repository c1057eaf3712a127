"""Event logs and where they come from."""

"""Fixed names and column helpers."""

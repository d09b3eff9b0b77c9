"""Incremental upkeep of map products over streams of changed elements."""

"""File formats that Spark doesn't read itself."""
